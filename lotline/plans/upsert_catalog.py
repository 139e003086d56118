"""Registered upsert / constraint / streaming / title-parse queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import derived, inputs
from .catalog import AS_OF, register
from .oracle_views import register as register_view
from ..functions.titles import DEFAULT_MAKE, DEFAULT_MODEL, MAKE_RE, MODEL_RE, YEAR_RE, parse_title
from ..operators.upsert import bulk_insert, conform, create_tables, insert_violations, latest_vehicles, merge, upsert_into
from ..session import work_dir
from ..sources.buckets import BucketTable
from ..sources.store import bucket_count, build_once, materialize_dir
from ..sources.schemas import ITEM_COLUMNS, RUNS, VEHICLES
from ..streaming.upsert_stream import run_stream_upsert

CUTOFF = "1998-01-01"
ITEM_SEQ = ["scraped_at", "l_orderkey", "l_linenumber"]


def _items(spark, sf):
    """Sightings after the cutoff as listing items; every 41st has no title
    (breaks NOT NULL: rejected, the VIN's previous valid item stands)."""
    o = derived.obs(spark, sf).where(F.col("scraped_at") >= F.lit(CUTOFF).cast("timestamp_ntz"))
    m = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    o = o.withColumn("title", F.when(m % 41 == 0, F.lit(None)).otherwise(F.col("title")))
    return o.select("id", *ITEM_COLUMNS, *ITEM_SEQ)


def _target(spark, sf):
    o = derived.obs(spark, sf).where(F.col("scraped_at") < F.lit(CUTOFF).cast("timestamp_ntz"))
    return latest_vehicles(o, ITEM_SEQ)


# ---- oracle: title parse and the merge, written directly in SQL
def title_sql(t: str) -> dict[str, str]:
    ym = f"regexp_extract(coalesce({t}, ''), '{YEAR_RE}', 1)"
    yall = f"regexp_extract(coalesce({t}, ''), '{YEAR_RE}', 0)"
    mk = f"regexp_extract(coalesce({t}, ''), '{MAKE_RE}', 1)"
    md = f"regexp_extract(coalesce({t}, ''), '{MODEL_RE}', 1)"
    s1 = f"(CASE WHEN {ym} <> '' THEN substr(coalesce({t}, ''), length({yall}) + 1) ELSE coalesce({t}, '') END)"
    s2 = f"(CASE WHEN {mk} <> '' THEN regexp_replace({s1}, '(?i)BMW\\s*', '') ELSE {s1} END)"
    pos = f"instr({s2}, {md})"
    s3 = (f"(CASE WHEN {md} <> '' AND {pos} > 0 THEN substr({s2}, 1, {pos} - 1) || "
          f"substr({s2}, {pos} + length({md})) ELSE {s2} END)")
    tr = f"regexp_replace({s3}, '^\\s+|\\s+$', '', 'g')"
    return {
        "year": f"CASE WHEN {ym} <> '' THEN CAST({ym} AS INTEGER) END",
        "make": f"CASE WHEN {mk} <> '' THEN {mk} ELSE '{DEFAULT_MAKE}' END",
        "model": f"CASE WHEN {md} <> '' THEN {md} ELSE '{DEFAULT_MODEL}' END",
        "trim": f"nullif({tr}, '')",
    }


_T = title_sql("title")
register_view("up_items", ["obs"], (
    "SELECT id, vin, dealer, dealer_platform, source_url, "
    "CASE WHEN (l_orderkey * 8 + l_linenumber) % 41 = 0 THEN NULL ELSE title END AS title, "
    "price, msrp, ext_color, int_color, odometer, options, scraped_at, l_orderkey, l_linenumber "
    f"FROM obs WHERE scraped_at >= TIMESTAMP '{CUTOFF}'"))
register_view("up_last", ["up_items"], (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY scraped_at DESC, l_orderkey DESC, "
    "l_linenumber DESC) AS rn FROM up_items WHERE title IS NOT NULL) WHERE rn = 1"))
register_view("up_target", ["obs"], (
    "SELECT id, dealer, title, year, make, model, trim, vin, msrp, price, odometer, ext_color, int_color, "
    "options, dealer_platform, source_url, scraped_at, scraped_at AS updated_at, created_at FROM ("
    "SELECT *, row_number() OVER (PARTITION BY vin ORDER BY scraped_at DESC, l_orderkey DESC, "
    "l_linenumber DESC) AS rn, min(scraped_at) OVER (PARTITION BY vin) AS created_at FROM obs "
    f"WHERE scraped_at < TIMESTAMP '{CUTOFF}') WHERE rn = 1"))

_TS = f"TIMESTAMP '{AS_OF}'"
_MERGED = (
    "SELECT coalesce(t.id, s.id) AS id, "
    "CASE WHEN s.vin IS NOT NULL THEN s.dealer ELSE t.dealer END AS dealer, "
    "CASE WHEN s.vin IS NOT NULL THEN s.title ELSE t.title END AS title, "
    f"CASE WHEN s.vin IS NOT NULL THEN {title_sql('s.title')['year']} ELSE t.year END AS year, "
    f"CASE WHEN s.vin IS NOT NULL THEN {title_sql('s.title')['make']} ELSE t.make END AS make, "
    f"CASE WHEN s.vin IS NOT NULL THEN {title_sql('s.title')['model']} ELSE t.model END AS model, "
    f"CASE WHEN s.vin IS NOT NULL THEN {title_sql('s.title')['trim']} ELSE t.trim END AS trim, "
    "coalesce(s.vin, t.vin) AS vin, "
    + ", ".join(f"CASE WHEN s.vin IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}"
                for c in ["msrp", "price", "odometer", "ext_color", "int_color", "options", "dealer_platform",
                          "source_url"]) +
    f", CASE WHEN s.vin IS NOT NULL THEN {_TS} ELSE t.scraped_at END AS scraped_at, "
    f"CASE WHEN s.vin IS NOT NULL THEN {_TS} ELSE t.updated_at END AS updated_at, "
    f"CASE WHEN s.vin IS NOT NULL THEN coalesce(t.created_at, {_TS}) ELSE t.created_at END AS created_at "
    "FROM up_last s FULL OUTER JOIN up_target t ON s.vin = t.vin")


register_view("up_merged", ["up_last", "up_target"], _MERGED)


def stored_target(spark, sf) -> BucketTable:
    """The vehicle table as stored before the new items arrive, in buckets by VIN (written once)."""
    buckets = bucket_count(spark)
    root = build_once(spark, f"vehicles_before-{buckets}", inputs.key(spark, sf),
                      lambda path: BucketTable(spark, path, VEHICLES, buckets=buckets).replace(_target(spark, sf)))
    return BucketTable(spark, root, VEHICLES)


def _upsert(spark, sf):
    table, rejects = merge(stored_target(spark, sf).read(), _items(spark, sf), AS_OF, seq=ITEM_SEQ, identity="title")
    return table, rejects


@register("upsert_vehicles", _MERGED, ("up_last", "up_target"))
def q_upsert_vehicles(spark, sf):
    return _upsert(spark, sf)[0]


def _cloned(spark, sf) -> BucketTable:
    """A table of its own that begins with the stored buckets."""
    return stored_target(spark, sf).clone(f"{work_dir(spark)}/upserts/{uuid.uuid4().hex}")


@register("upsert_store", _MERGED, ("up_last", "up_target"))
def q_upsert_store(spark, sf):
    """The items merged into the stored table bucket by bucket, and the next version read."""
    table = _cloned(spark, sf)
    upsert_into(table, _items(spark, sf), AS_OF, seq=ITEM_SEQ, identity="title")
    return table.read()


@register("upsert_store_rejects",
          "SELECT vin, 'title' AS violations FROM up_items WHERE title IS NULL", ("up_items",))
def q_upsert_store_rejects(spark, sf):
    """What the stored upsert turned down, as written next to the table."""
    rejects = upsert_into(_cloned(spark, sf), _items(spark, sf), AS_OF, seq=ITEM_SEQ, identity="title")
    return rejects.select("vin", F.array_join("violations", ",").alias("violations"))


@register("insert_store",
          "SELECT * FROM up_target UNION ALL SELECT id, dealer, title, year, make, model, trim, vin, msrp, price, odometer, "
          "ext_color, int_color, options, dealer_platform, source_url, scraped_at, scraped_at AS updated_at, "
          "scraped_at AS created_at FROM (SELECT *, count(*) OVER (PARTITION BY vin) AS n FROM obs) "
          "WHERE n = 1 AND vin NOT IN (SELECT vin FROM up_target)", ("obs", "up_target"))
def q_insert_store(spark, sf):
    """VINs sighted once and not stored yet, inserted under the unique-key rule; then the table."""
    table = _cloned(spark, sf)
    o = derived.obs(spark, sf)
    once = o.groupBy("vin").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("vin")
    new = conform(o.join(once, "vin", "left_semi").withColumn("updated_at", F.col("scraped_at"))
                  .withColumn("created_at", F.col("scraped_at")))
    table.insert(new.join(table.read().select("vin"), "vin", "left_anti"))
    return table.read()


@register("constraint_rejects",
          "SELECT vin, 'title' AS violations FROM up_items WHERE title IS NULL", ("up_items",))
def q_constraint_rejects(spark, sf):
    rej = _upsert(spark, sf)[1]
    return rej.select("vin", F.array_join("violations", ",").alias("violations"))


@register("upsert_null_overwrite",
          "SELECT t.id, t.dealer, t.title, t.year, t.make, t.model, t.trim, t.vin, t.msrp, "
          "CASE WHEN s.vin IS NOT NULL THEN s.price ELSE t.price END AS price, "
          "CASE WHEN s.vin IS NOT NULL THEN s.odometer ELSE t.odometer END AS odometer, "
          "t.ext_color, t.int_color, t.options, t.dealer_platform, t.source_url, "
          f"CASE WHEN s.vin IS NOT NULL THEN {_TS} ELSE t.scraped_at END AS scraped_at, "
          f"CASE WHEN s.vin IS NOT NULL THEN {_TS} ELSE t.updated_at END AS updated_at, t.created_at "
          "FROM up_target t LEFT JOIN (SELECT vin, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE price END AS price, "
          "odometer FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY scraped_at DESC, "
          "l_orderkey DESC, l_linenumber DESC) AS rn FROM up_items) WHERE rn = 1) s ON s.vin = t.vin "
          "WHERE t.vin IS NOT NULL", ("up_items", "up_target"))
def q_upsert_null_overwrite(spark, sf):
    """Items that carry only price and odometer: a supplied NULL price
    overwrites, every absent column keeps the stored value.  A VIN that is
    not stored lacks required columns and is turned down after the join."""
    return _price_update(spark, sf)[0]


def _price_update(spark, sf):
    items = _items(spark, sf).withColumn(
        "price", F.when(F.col("l_orderkey") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("price")))
    partial = items.select("vin", "price", "odometer", *ITEM_SEQ)
    return merge(_target(spark, sf), partial, AS_OF, seq=ITEM_SEQ, identity="payload")


@register("upsert_late_rejects",
          "SELECT DISTINCT vin, 'dealer,title,make,model,dealer_platform,source_url' AS violations FROM up_items "
          "WHERE vin NOT IN (SELECT vin FROM up_target)", ("up_items", "up_target"))
def q_upsert_late_rejects(spark, sf):
    """Inserts turned down after the join: one row for each new VIN."""
    return _price_update(spark, sf)[1].select("vin", F.array_join("violations", ",").alias("violations"))


def _stream(spark, sf):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = materialize_dir(spark, f"stream_items-{parts}", lambda: _items(spark, sf).repartition(parts, "vin"),
                             inputs.key(spark, sf))
    initial = _target(spark, sf).withColumn("_seq", F.lit(None).cast(
        "struct<scraped_at:timestamp_ntz,l_orderkey:bigint,l_linenumber:int>"))
    schema = spark.read.parquet(folder).schema
    # three micro-batches, whatever the size
    return run_stream_upsert(spark, folder, schema, initial, AS_OF, ITEM_SEQ, identity="title",
                             files_per_batch=-(-parts // 3))


@register("stream_upsert", _MERGED, ("up_last", "up_target"))
def q_stream_upsert(spark, sf):
    return _stream(spark, sf).read().drop("_seq")


@register("stream_rejects", "SELECT vin, 'title' AS violations FROM up_items WHERE title IS NULL", ("up_items",))
def q_stream_rejects(spark, sf):
    return _stream(spark, sf).rejects().select("vin", F.array_join("violations", ",").alias("violations"))


@register("bulk_insert", "SELECT * FROM up_target", ("up_target",))
def q_bulk_insert(spark, sf):
    """Vehicles inserted into freshly created tables, under their rules, and read back."""
    paths = create_tables(spark, f"{work_dir(spark)}/inserts/{uuid.uuid4().hex}")
    bulk_insert(_target(spark, sf), paths["vehicles"])
    return spark.read.schema(VEHICLES).parquet(paths["vehicles"])


@register("runs_insert", "SELECT * FROM runs", ("runs",))
def q_runs_insert(spark, sf):
    """The run log written into its freshly created table and read back."""
    paths = create_tables(spark, f"{work_dir(spark)}/inserts/{uuid.uuid4().hex}")
    derived.runs(spark, sf).select(*[f.name for f in RUNS.fields]).write.mode("append").parquet(paths["scrape_runs"])
    return spark.read.schema(RUNS).parquet(paths["scrape_runs"])


@register("bulk_insert_violations",
          "SELECT vin, 'repeated vin' AS reason FROM obs GROUP BY vin HAVING count(*) > 1 UNION ALL "
          "SELECT DISTINCT vin, 'stored vin' FROM obs WHERE vin IN (SELECT vin FROM up_target)", ("obs", "up_target"))
def q_bulk_insert_violations(spark, sf):
    """All sightings offered as rows: what the unique-VIN rule turns down."""
    o = derived.obs(spark, sf).drop("id").withColumn("id", F.lit(None).cast("bigint"))
    return insert_violations(o, _target(spark, sf))


_PT = title_sql("title")


@register("parse_title",
          f"SELECT source, key, title, {_PT['year']} AS year, {_PT['make']} AS make, {_PT['model']} AS model, "
          f"{_PT['trim']} AS trim FROM (SELECT 'vehicle' AS source, vin AS key, title FROM vehicles UNION ALL "
          "SELECT 'page', CAST(page_id AS VARCHAR), regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages)",
          ("vehicles",))
def q_parse_title(spark, sf):
    v = inputs.vehicles(spark, sf).select(F.lit("vehicle").alias("source"), F.col("vin").alias("key"), "title")
    pages = spark.read.parquet(f"{sf.rstrip('/')}/pages.parquet").select(
        F.lit("page").alias("source"), F.col("page_id").cast("string").alias("key"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    t = v.unionByName(pages)
    p = parse_title(F.col("title"))
    return t.select("source", "key", "title", p["year"].alias("year"), p["make"].alias("make"),
                    p["model"].alias("model"), p["trim"].alias("trim"))
