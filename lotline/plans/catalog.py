"""Registered queries: one Spark plan per operator plus the equivalent DuckDB SQL.

Each query reads the driver tables (or tables Spark derives from them) in
full.  ``QUERIES[key](spark, sf_dir) -> DataFrame``; ``ORACLE[key]`` is SQL
over the pre-registered parquet views, with the derived inputs as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived, inputs
from .oracle_views import with_views
from ..operators import dealers as dealer_ops
from ..operators import runs as run_ops
from ..operators import search as S
from ..operators.upsert import duplicate_vins, first_seen, last_per_key, last_rows
from ..sources.schemas import API_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = "2026-01-01 00:00:00"
API_SQL = ", ".join(API_COLUMNS)


def register(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = with_views(sql, *views)
        return fn
    return deco


def _v(spark, sf):
    return inputs.vehicles(spark, sf)


def _search_sql(text: str) -> str:
    return "(" + " OR ".join(f"{c} ILIKE '%{text}%'" for c in S.SEARCHED) + ")"


# ---------------------------------------------------------------- listing
@register("vehicles_all", f"SELECT {API_SQL} FROM vehicles", ("vehicles",))
def q_vehicles_all(spark, sf):
    return S.search_vehicles(_v(spark, sf), limit=-1)


@register("filter_dealer", f"SELECT {API_SQL} FROM vehicles WHERE dealer = 'Supplier#000000007'", ("vehicles",))
def q_filter_dealer(spark, sf):
    return S.search_vehicles(_v(spark, sf), dealer="Supplier#000000007", limit=-1)


@register("filter_model", f"SELECT {API_SQL} FROM vehicles WHERE model = 'iX'", ("vehicles",))
def q_filter_model(spark, sf):
    return S.search_vehicles(_v(spark, sf), model="iX", limit=-1)


@register("filter_min_price", f"SELECT {API_SQL} FROM vehicles WHERE price >= 50000", ("vehicles",))
def q_filter_min_price(spark, sf):
    return S.search_vehicles(_v(spark, sf), min_price=50000, limit=-1)


@register("filter_max_price", f"SELECT {API_SQL} FROM vehicles WHERE price <= 20000", ("vehicles",))
def q_filter_max_price(spark, sf):
    return S.search_vehicles(_v(spark, sf), max_price=20000, limit=-1)


@register("search_text", f"SELECT {API_SQL} FROM vehicles WHERE {_search_sql('red')}", ("vehicles",))
def q_search_text(spark, sf):
    return S.search_vehicles(_v(spark, sf), search="red", limit=-1)


@register("search_wildcard",
          f"SELECT {API_SQL} FROM vehicles WHERE {_search_sql('BMW_i4%ECO')}", ("vehicles",))
def q_search_wildcard(spark, sf):
    # '_' and '%' typed by the user act as wildcards.
    return S.search_vehicles(_v(spark, sf), search="BMW_i4%ECO", limit=-1)


@register("filter_combined",
          f"SELECT {API_SQL} FROM vehicles WHERE model = 'X5' AND price >= 10000 AND price <= 60000 "
          f"AND {_search_sql('e')}", ("vehicles",))
def q_filter_combined(spark, sf):
    return S.search_vehicles(_v(spark, sf), dealer="", model="X5", min_price=10000, max_price=60000,
                             search="e", limit=-1)


@register("top_price",
          f"SELECT {API_SQL} FROM vehicles ORDER BY price DESC NULLS LAST, vin LIMIT 100", ("vehicles",))
def q_top_price(spark, sf):
    return S.search_vehicles(_v(spark, sf))  # the API default limit of 100


@register("model_like", f"SELECT {API_SQL} FROM vehicles WHERE model ILIKE '%x%'", ("vehicles",))
def q_model_like(spark, sf):
    return S.model_like(_v(spark, sf), "x")


@register("vehicles_envelope",
          "SELECT CAST(to_json(list(struct_pack(vin := vin, dealer := dealer, title := title) "
          "ORDER BY price DESC NULLS LAST, vin)) AS VARCHAR) AS vehicles, count(*) AS count FROM ("
          "SELECT * FROM vehicles WHERE dealer = 'Supplier#000000003' "
          "ORDER BY price DESC NULLS LAST, vin LIMIT 10)", ("vehicles",))
def q_vehicles_envelope(spark, sf):
    page = S.search_vehicles(_v(spark, sf), dealer="Supplier#000000003", limit=10)
    return S.envelope(page, 10)


def _sort_sql(column: str, direction: str) -> str:
    key = f"lower({column})" if column in ("dealer", "title", "ext_color") else column
    return (f"SELECT *, row_number() OVER (ORDER BY {key} {direction} NULLS LAST, position) AS sort_rank FROM ("
            f"SELECT {API_SQL}, row_number() OVER (ORDER BY price DESC NULLS LAST, vin) AS position FROM ("
            f"SELECT * FROM vehicles ORDER BY price DESC NULLS LAST, vin LIMIT 100))")


@register("sort_asc_ci", _sort_sql("title", "ASC"), ("vehicles",))
def q_sort_asc_ci(spark, sf):
    page = S.with_position(S.search_vehicles(_v(spark, sf)))
    return S.sort_rows(page, "title", ascending=True)


@register("sort_desc_ci", _sort_sql("ext_color", "DESC"), ("vehicles",))
def q_sort_desc_ci(spark, sf):
    page = S.with_position(S.search_vehicles(_v(spark, sf)))
    return S.sort_rows(page, "ext_color", ascending=False)


# ---------------------------------------------------------------- aggregates
@register("stats", "SELECT count(id) AS total_vehicles, count(DISTINCT dealer) AS total_dealers FROM vehicles",
          ("vehicles",))
def q_stats(spark, sf):
    return S.stats(_v(spark, sf))


@register("count_by_dealer", "SELECT dealer, count(*) AS n FROM vehicles GROUP BY dealer", ("vehicles",))
def q_count_by_dealer(spark, sf):
    return S.count_by_dealer(_v(spark, sf))


@register("dealers_distinct", "SELECT DISTINCT dealer FROM vehicles ORDER BY dealer", ("vehicles",))
def q_dealers_distinct(spark, sf):
    return S.dealers_distinct(_v(spark, sf))


_MODELS_SQL = ", ".join(f"('{m}')" for m in S.STATIC_MODELS)


@register("models_union",
          f"SELECT model FROM (SELECT model FROM vehicles WHERE model IS NOT NULL AND model <> '' "
          f"UNION SELECT * FROM (VALUES {_MODELS_SQL}) t(model)) ORDER BY model", ("vehicles",))
def q_models_union(spark, sf):
    return S.models_union(_v(spark, sf))


@register("stats_full",
          "SELECT s.total_vehicles, s.total_dealers, r.started_at AS last_run_started_at, "
          "r.status AS last_run_status, r.vehicles_scraped AS last_run_vehicles_scraped FROM "
          "(SELECT count(id) AS total_vehicles, count(DISTINCT dealer) AS total_dealers FROM vehicles) s "
          "LEFT JOIN (SELECT * FROM runs ORDER BY started_at DESC, id DESC LIMIT 1) r ON true", ("vehicles", "runs"))
def q_stats_full(spark, sf):
    return S.stats_with_last_run(_v(spark, sf), derived.runs(spark, sf))


@register("dedup_vin",
          "SELECT vin, dealer, price, scraped_at FROM (SELECT *, row_number() OVER (PARTITION BY vin "
          "ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM obs) WHERE rn = 1", ("obs",))
def q_dedup_vin(spark, sf):
    o = derived.obs(spark, sf).select("vin", "dealer", "price", "scraped_at", "l_orderkey", "l_linenumber")
    return last_per_key(o, "vin", inputs.SEQ).select("vin", "dealer", "price", "scraped_at")


@register("last_rows",
          "SELECT vin, dealer, price, scraped_at FROM (SELECT *, row_number() OVER (PARTITION BY vin "
          "ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM obs) WHERE rn = 1", ("obs",))
def q_last_rows(spark, sf):
    """The last sighting of each VIN by a packed order key."""
    o = derived.obs(spark, sf).select("vin", "dealer", "price", *inputs.SEQ)
    return last_rows(o, "vin", inputs.SEQ).select("vin", "dealer", "price", "scraped_at")


@register("first_seen", "SELECT vin, min(scraped_at) AS first_seen FROM obs GROUP BY vin", ("obs",))
def q_first_seen(spark, sf):
    return first_seen(derived.obs(spark, sf))


@register("duplicate_vins", "SELECT vin, count(*) AS n FROM vehicles GROUP BY vin HAVING count(*) > 1",
          ("vehicles",))
def q_duplicate_vins(spark, sf):
    return duplicate_vins(_v(spark, sf))


# ---------------------------------------------------------------- dealers
_CONFIG_SQL = ("SELECT d.name, d.city, d.website, d.phone, d.ord, m.platform, m.inventory_url, "
               "coalesce(m.platform IN ('roadster', 'dealercom') AND m.inventory_url IS NOT NULL, false) "
               "AS supported FROM dealers d LEFT JOIN platform_map m ON d.name = m.name")


def _config(spark, sf):
    return dealer_ops.dealer_config(derived.dealers(spark, sf), derived.platform_map(spark, sf))


@register("dealer_config", _CONFIG_SQL, ("dealers", "platform_map"))
def q_dealer_config(spark, sf):
    return _config(spark, sf)


@register("dealers_supported", f"SELECT * FROM ({_CONFIG_SQL}) WHERE supported", ("dealers", "platform_map"))
def q_dealers_supported(spark, sf):
    return dealer_ops.supported(_config(spark, sf))


@register("dealers_unsupported", f"SELECT * FROM ({_CONFIG_SQL}) WHERE NOT supported",
          ("dealers", "platform_map"))
def q_dealers_unsupported(spark, sf):
    return dealer_ops.unsupported(_config(spark, sf))


@register("support_counts",
          f"SELECT count(*) FILTER (WHERE supported) AS supported, count(*) FILTER (WHERE NOT supported) "
          f"AS unsupported, count(*) AS total FROM ({_CONFIG_SQL})", ("dealers", "platform_map"))
def q_support_counts(spark, sf):
    return dealer_ops.support_counts(_config(spark, sf))


@register("platform_counts",
          f"SELECT count(*) AS total_dealers, count(*) FILTER (WHERE platform = 'roadster') AS roadster_count, "
          f"count(*) FILTER (WHERE platform = 'dealercom') AS dealercom_count FROM ({_CONFIG_SQL})",
          ("dealers", "platform_map"))
def q_platform_counts(spark, sf):
    return dealer_ops.platform_counts(_config(spark, sf))


@register("dealers_first_n", "SELECT * FROM dealers ORDER BY ord LIMIT 5", ("dealers",))
def q_dealers_first_n(spark, sf):
    return dealer_ops.first_n(derived.dealers(spark, sf), 5)


@register("dealer_by_name", f"SELECT * FROM ({_CONFIG_SQL}) WHERE name = 'Supplier#000000042'",
          ("dealers", "platform_map"))
def q_dealer_by_name(spark, sf):
    return dealer_ops.by_name(_config(spark, sf), "Supplier#000000042")


# ---------------------------------------------------------------- runs
@register("runs_last", "SELECT * FROM runs ORDER BY started_at DESC, id DESC LIMIT 1", ("runs",))
def q_runs_last(spark, sf):
    return run_ops.latest(derived.runs(spark, sf))


@register("runs_recent", "SELECT * FROM runs ORDER BY started_at DESC, id DESC LIMIT 10", ("runs",))
def q_runs_recent(spark, sf):
    return run_ops.recent(derived.runs(spark, sf), 10)


@register("runs_by_status", "SELECT * FROM runs WHERE status = 'failed'", ("runs",))
def q_runs_by_status(spark, sf):
    return run_ops.with_status(derived.runs(spark, sf), "failed")


@register("runs_pid_null", "SELECT * FROM runs WHERE pid IS NULL", ("runs",))
def q_runs_pid_null(spark, sf):
    return run_ops.without_pid(derived.runs(spark, sf))


_CHECKABLE = "status = 'running' AND pid IS NOT NULL AND pid <> 0"


@register("runs_dead", f"SELECT * FROM runs WHERE {_CHECKABLE} AND pid NOT IN (SELECT pid FROM live)",
          ("runs", "live"))
def q_runs_dead(spark, sf):
    return run_ops.dead(derived.runs(spark, sf), derived.live(spark, sf))


@register("runs_alive", f"SELECT * FROM runs WHERE {_CHECKABLE} AND pid IN (SELECT pid FROM live)",
          ("runs", "live"))
def q_runs_alive(spark, sf):
    return run_ops.alive(derived.runs(spark, sf), derived.live(spark, sf))


def _recover_sql(scope_pred: str) -> str:
    dead = f"({scope_pred}) AND {_CHECKABLE} AND pid NOT IN (SELECT pid FROM live)"
    return (f"SELECT id, platform, CASE WHEN {dead} THEN 'failed' ELSE status END AS status, "
            f"vehicles_scraped, dealers_scraped, "
            f"CASE WHEN {dead} THEN 'Process ' || pid || ' terminated unexpectedly' ELSE error_message END "
            f"AS error_message, started_at, "
            f"CASE WHEN {dead} THEN TIMESTAMP '{AS_OF}' ELSE completed_at END AS completed_at, pid FROM runs")


@register("run_recover", _recover_sql("true"), ("runs", "live"))
def q_run_recover(spark, sf):
    return run_ops.recover(derived.runs(spark, sf), derived.live(spark, sf), AS_OF, scope="all")


@register("run_recover_latest", _recover_sql("started_at = (SELECT max(started_at) FROM runs)"),
          ("runs", "live"))
def q_run_recover_latest(spark, sf):
    return run_ops.recover(derived.runs(spark, sf), derived.live(spark, sf), AS_OF, scope="latest")


_PLATFORMS_SQL = "SELECT DISTINCT platform FROM platform_map UNION SELECT 'all'"


def _platforms(spark, sf):
    pm = derived.platform_map(spark, sf).select("platform")
    return pm.unionByName(spark.createDataFrame([("all",)], "platform string")).distinct()


@register("run_status",
          f"SELECT p.platform, coalesce(r.status, 'idle') AS status, r.id AS run_id, r.pid, r.started_at, "
          f"r.completed_at, r.vehicles_scraped, r.dealers_scraped, r.error_message FROM ({_PLATFORMS_SQL}) p "
          f"LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY started_at DESC, id DESC) "
          f"AS rn FROM runs) WHERE rn = 1) r ON p.platform = r.platform", ("runs", "platform_map"))
def q_run_status(spark, sf):
    return run_ops.status_report(derived.runs(spark, sf), _platforms(spark, sf))


@register("run_health",
          f"SELECT platform, coalesce(status = 'running' AND pid IS NOT NULL AND pid <> 0 "
          f"AND pid IN (SELECT pid FROM live), false) AS scraper_running, "
          f"CASE WHEN status = 'running' AND pid IS NOT NULL AND pid <> 0 THEN pid END AS scraper_pid, "
          f"id AS last_id, started_at AS last_started_at, status AS last_status, pid AS last_pid, "
          f"TIMESTAMP '{AS_OF}' AS checked_at FROM (SELECT *, row_number() OVER (PARTITION BY platform "
          f"ORDER BY started_at DESC) AS rn FROM runs) WHERE rn = 1", ("runs", "live"))
def q_run_health(spark, sf):
    return run_ops.health_report(derived.runs(spark, sf), derived.live(spark, sf), AS_OF)


@register("run_fold",
          "SELECT run_id, arg_max(platform, (ts, platform)) AS platform, "
          "coalesce(arg_max(kind, (ts, kind)) FILTER (WHERE kind IN ('failed', 'completed')), 'running') AS status, "
          "min(ts) AS started_at, max(ts) FILTER (WHERE kind IN ('failed', 'completed')) AS completed_at, "
          "arg_max(message, (ts, message)) FILTER (WHERE kind = 'failed') AS error_message, "
          "arg_max(pid, (ts, pid)) AS pid, count(*) AS n_events FROM run_events GROUP BY run_id", ("run_events",))
def q_run_fold(spark, sf):
    return run_ops.fold_events(derived.run_events(spark, sf))


@register("run_totals",
          "SELECT CAST(year(scraped_at) * 100 + month(scraped_at) AS bigint) AS run_id, "
          "count(DISTINCT vin) AS vehicles_scraped, count(DISTINCT dealer) AS dealers_scraped "
          "FROM obs GROUP BY 1", ("obs",))
def q_run_totals(spark, sf):
    o = derived.obs(spark, sf).withColumn(
        "run_id", (F.year("scraped_at") * 100 + F.month("scraped_at")).cast("bigint"))
    return run_ops.totals(o)


# Queries over the capture table register themselves on import.
from . import capture_catalog  # noqa: E402,F401
from . import upsert_catalog  # noqa: E402,F401
from . import misc_catalog  # noqa: E402,F401
from . import store_catalog  # noqa: E402,F401


_CSV_COLS = ["name", "city", "website", "phone"]


@register("dealers_csv_first_n", "SELECT name, city, website, phone FROM dealers ORDER BY ord LIMIT 5",
          ("dealers",))
def q_dealers_csv_first_n(spark, sf):
    """Registry written as CSV files (header, UTF-8) in registry order, read
    back with the declared schema; the first five lines of the files."""
    from ..sources.store import materialize_csv
    from ..sources.tables import read_dealers_csv
    path = materialize_csv(spark, "dealers_csv",
                           lambda: derived.dealers(spark, sf).repartitionByRange(4, "ord")
                           .sortWithinPartitions("ord").select(*_CSV_COLS)
                           .toDF("Dealer", "City", "Website", "Phone"), inputs.key(spark, sf))
    return dealer_ops.first_n(read_dealers_csv(spark, path), 5).select(*_CSV_COLS)


@register("run_complete",
          "SELECT r.id, r.platform, CASE WHEN r.status = 'running' AND t.run_id IS NOT NULL THEN 'completed' "
          "ELSE r.status END AS status, CASE WHEN r.status = 'running' AND t.run_id IS NOT NULL "
          "THEN CAST(t.v AS INTEGER) ELSE r.vehicles_scraped END AS vehicles_scraped, "
          "CASE WHEN r.status = 'running' AND t.run_id IS NOT NULL THEN CAST(t.d AS INTEGER) "
          "ELSE r.dealers_scraped END AS dealers_scraped, r.error_message, r.started_at, "
          f"CASE WHEN r.status = 'running' AND t.run_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' "
          "ELSE r.completed_at END AS completed_at, r.pid FROM runs r LEFT JOIN "
          "(SELECT l_orderkey % 997 AS run_id, count(DISTINCT vin) AS v, count(DISTINCT dealer) AS d FROM obs "
          "GROUP BY 1) t ON r.id = t.run_id", ("runs", "obs"))
def q_run_complete(spark, sf):
    o = derived.obs(spark, sf).withColumn("run_id", F.col("l_orderkey") % 997)
    return run_ops.complete(derived.runs(spark, sf), run_ops.totals(o), AS_OF)
