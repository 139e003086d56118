"""Inputs for the operators, derived from the driver's parquet tables.

The driver tables are TPC-H-like; each lotline table is a projection of them
(one vehicle sighting per lineitem, one dealer per supplier, one run per
event).  The column definitions below are SQL expression text that Spark and
the DuckDB oracle both evaluate, so both engines start from the same rows.
The operators on top of these inputs are written separately for each engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import list_files
from ..sources.tables import table

# A supplier file up to this size (some 700,000 suppliers, of which a join takes key and name) is sent to all tasks.
BROADCAST_SUPPLIERS = 16_000_000

# ---- fixed definitions of the derived inputs (shared SQL expression text) ----
MODEL_OF_SIZE = ("CASE p_size % 6 WHEN 0 THEN 'X3' WHEN 1 THEN 'X5' WHEN 2 THEN 'iX' "
                 "WHEN 3 THEN '3 Series' WHEN 4 THEN 'M4' ELSE 'i4' END")

OBS_COLUMNS = {
    "vin": "concat('VIN', lpad(cast(l_partkey AS string), 14, '0'))",
    "id": "l_partkey",
    "dealer": "s_name",
    "dealer_key": "s_suppkey",
    "dealer_platform": "CASE WHEN l_suppkey % 5 = 0 THEN 'Roadster' ELSE 'Dealer.com' END",
    "year": "1990 + p_size",
    "make": "'BMW'",
    "model": MODEL_OF_SIZE,
    "trim": "p_type",
    "title": f"concat(cast(1990 + p_size AS string), ' BMW ', {MODEL_OF_SIZE}, ' ', p_type)",
    "price": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END",
    "msrp": "p_retailprice",
    "odometer": "cast(l_quantity * 100 AS integer)",
    "ext_color": "split_part(p_name, ' ', 1)",
    "int_color": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE split_part(p_name, ' ', 2) END",
    "options": "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE concat('[\"', p_brand, '\",\"', l_returnflag, '\"]') END",
    "source_url": "concat('https://www.dealer', cast(s_suppkey AS string), '.example.com/inventory/', "
                  "concat('VIN', lpad(cast(l_partkey AS string), 14, '0')))",
    "scraped_at": "l_shipdate",
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
}

# Columns of a sighting that follow from its other columns, in this order: rows on their way through a
# shuffle go without them and get them afterwards (``captures.assign_pages``).
LATE_OBS_COLUMNS = {
    "vin": OBS_COLUMNS["vin"].replace("l_partkey", "id"),
    "dealer_platform": OBS_COLUMNS["dealer_platform"].replace("l_suppkey", "dealer_key"),
    "make": OBS_COLUMNS["make"],
    "model": MODEL_OF_SIZE.replace("p_size", "(year - 1990)"),
    "title": "concat(cast(year AS string), ' ', make, ' ', model, ' ', trim)",
}

DEALER_COLUMNS = {
    "name": "s_name",
    "city": "n_name",
    "website": "concat('https://www.dealer', cast(s_suppkey AS string), '.example.com')",
    "phone": "concat('(555) ', lpad(cast(s_suppkey % 10000 AS string), 4, '0'))",
    "ord": "s_suppkey",
}

PLATFORM_MAP_WHERE = "s_suppkey % 7 <> 3"
PLATFORM_MAP_COLUMNS = {
    "name": "s_name",
    "platform": "CASE WHEN s_suppkey % 5 = 0 THEN 'roadster' WHEN s_suppkey % 11 = 0 THEN 'cargurus' "
                "ELSE 'dealercom' END",
    "inventory_url": "CASE WHEN s_suppkey % 17 = 0 THEN NULL "
                     "WHEN s_suppkey % 5 = 0 THEN concat('https://express.dealer', cast(s_suppkey AS string), "
                     "'.example.com/inventory') "
                     "ELSE concat('https://www.dealer', cast(s_suppkey AS string), "
                     "'.example.com/new-inventory/index.htm') END",
}

RUN_STATUS = ("CASE WHEN event_type = 'error' THEN 'failed' "
              "WHEN event_type IN ('click', 'purchase') THEN 'completed' ELSE 'running' END")
RUN_COLUMNS = {
    "id": "event_id",
    "platform": "CASE event_type WHEN 'view' THEN 'roadster' WHEN 'purchase' THEN 'all' "
                "WHEN 'error' THEN 'roadster' ELSE 'dealercom' END",
    "status": RUN_STATUS,
    "vehicles_scraped": "cast(floor(value) AS integer)",
    "dealers_scraped": "cast(user_id % 7 AS integer)",
    "error_message": "CASE WHEN event_type = 'error' THEN concat('run ', cast(event_id AS string), ' failed') END",
    "started_at": "ts",
    "completed_at": f"CASE WHEN ({RUN_STATUS}) = 'running' THEN NULL ELSE ts + INTERVAL '30' MINUTE END",
    "pid": "CASE WHEN user_id % 10 = 0 THEN NULL ELSE cast(user_id + 1000 AS integer) END",
}
LIVE_WHERE = "user_id % 3 = 0"
LIVE_COLUMNS = {"pid": "cast(user_id + 1000 AS integer)"}

# A run-event stream (start / complete / fail) derived from events, for the run fold.
RUN_EVENT_COLUMNS = {
    "run_id": "cast(user_id AS bigint)",
    "kind": "CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'error' THEN 'failed' "
            "WHEN event_type = 'purchase' THEN 'completed' ELSE 'progress' END",
    "ts": "ts",
    "platform": "CASE WHEN user_id % 2 = 0 THEN 'dealercom' ELSE 'roadster' END",
    "message": "CASE WHEN event_type = 'error' THEN concat('error event ', cast(event_id AS string)) END",
    "pid": "cast(user_id + 1000 AS integer)",
}


def _select(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(k) for k, e in cols.items()])


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sighting of a vehicle: lineitem joined to its part and supplier.

    The part side is joined by key without a hint: adaptive execution turns
    the join into a broadcast when the measured side is under the threshold
    and keeps a shuffled join for the large scales where part grows with data.
    The suppliers, key and name of each, are broadcast as long as they are few, so
    the wide rows that come out of the join with part are not shuffled for them.
    """
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part")
    su = table(spark, sf_dir, "supplier")
    path = f"{sf_dir.rstrip('/')}/supplier.parquet"
    if sum(size for _, size, _ in list_files(spark, path)) <= BROADCAST_SUPPLIERS:
        su = F.broadcast(su)
    j = (li.join(pa, li.l_partkey == pa.p_partkey)
           .join(su, li.l_suppkey == su.s_suppkey))
    return _select(j, OBS_COLUMNS)


def dealers(spark: SparkSession, sf_dir: str) -> DataFrame:
    su = table(spark, sf_dir, "supplier")
    na = table(spark, sf_dir, "nation")
    return _select(su.join(na, su.s_nationkey == na.n_nationkey, "left"), DEALER_COLUMNS)


def platform_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    su = table(spark, sf_dir, "supplier").where(PLATFORM_MAP_WHERE)
    return _select(su, PLATFORM_MAP_COLUMNS)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "events"), RUN_COLUMNS)


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "events").where(LIVE_WHERE), LIVE_COLUMNS).distinct()


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "events"), RUN_EVENT_COLUMNS)
