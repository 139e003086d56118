"""VIN-keyed merge of listing items into the vehicle table.

Set-based form of a per-item "update if present, else insert":

1. items that break a NOT NULL rule on their own go to the rejects;
2. the remaining items are reduced to the last write per VIN (``max_by`` over
   the sequence, a partial aggregate: a hot VIN is combined map-side before
   the shuffle instead of being sorted in one task);
3. one full outer join on ``vin`` with the current table: a supplied column
   (even NULL) overwrites, a column absent from the item schema keeps the
   stored value; audit timestamps are stamped with ``as_of``;
4. ``upsert_into`` writes the result as a new version of a table in buckets
   (``sources.buckets``): only buckets that hold an incoming VIN are read and
   written; the table being read is never overwritten in place.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.titles import parse_title
from ..session import path_exists
from ..sources.buckets import BucketTable
from ..sources.schemas import VEHICLES, VEHICLES_REQUIRED

ITEM_FIELDS = ["dealer", "title", "msrp", "price", "odometer", "ext_color", "int_color", "options",
               "dealer_platform", "source_url"]
IDENTITY_FIELDS = ["year", "make", "model", "trim"]


def last_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Last write wins: per key, the row with the greatest ``order`` tuple.

    Uses ``max_by(struct(row), struct(order))`` so the reduction is a partial
    aggregate (skew-safe) rather than a window sort of each key's rows."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    agg = F.max_by(F.struct(*others), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(agg).select(*keys, *[F.col("_last." + c).alias(c) for c in others])


def packed_order(df: DataFrame, order: list[str]) -> Column | None:
    """The order of the whole-number, date and time columns ``order`` as one
    fixed-width number, nulls first; None if 38 digits do not hold it.

    One aggregate finds each column's range, and the columns are the digits of a
    number with these ranges as bases, so it compares as the columns do."""
    kinds = dict(df.dtypes)

    def whole(c: str) -> Column | None:
        t = kinds[c]
        if t in ("timestamp", "timestamp_ntz"):
            return F.unix_micros(F.col(c).cast("timestamp"))
        if t == "date":
            return F.unix_date(c).cast("long")
        return F.col(c).cast("long") if t in ("tinyint", "smallint", "int", "bigint") else None
    parts = [whole(c) for c in order]
    if any(p is None for p in parts):
        return None
    ends = df.agg(*[F.min(p) for p in parts], *[F.max(p) for p in parts]).first()
    wide = "decimal(38,0)"
    ranges = [(p, lo, 1 if lo is None else hi - lo + 2)          # digit 0: null
              for p, lo, hi in zip(parts, ends[: len(parts)], ends[len(parts):])]
    if math.prod(base for *_, base in ranges) >= 10 ** 38:
        return None
    zero = out = F.lit(0).cast(wide)
    for p, lo, base in ranges:
        digit = zero if lo is None else F.coalesce(p.cast(wide) - F.lit(str(lo)).cast(wide) + 1, zero)
        out = (out * F.lit(str(base)).cast(wide) + digit).cast(wide)
    return out


def last_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """As ``last_per_key``, for an order without ties: the greatest packed order of
    each key, found by a hash aggregate of two narrow columns, picks its rows by a
    join.  Rows that lose are not sorted and, if few keys fit a broadcast, not even
    shuffled.  Orders that do not pack are left to ``last_per_key``."""
    packed = packed_order(df, order)
    if packed is None:
        return last_per_key(df, key, order)
    rows = df.withColumn("_order", packed)
    top = rows.groupBy(F.col(key).alias("_key")).agg(F.max("_order").alias("_top"))
    return rows.join(top, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_order") == F.col("_top")), "left_semi").drop("_order")


def first_seen(df: DataFrame, key: str = "vin", ts: str = "scraped_at") -> DataFrame:
    """Earliest sighting time per key (kept as created_at)."""
    return df.groupBy(key).agg(F.min(ts).alias("first_seen"))


def latest_vehicles(obs: DataFrame, order: list[str]) -> DataFrame:
    """Vehicle table from a history of sightings: last sighting per VIN with
    created_at = first sighting and updated_at = last sighting."""
    cols = [c for c in obs.columns if c != "vin"]
    agg = obs.groupBy("vin").agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"),
        F.min("scraped_at").alias("created_at"))
    out = agg.select("vin", "_last.*", "created_at").withColumn("updated_at", F.col("scraped_at"))
    return conform(out)


def conform(df: DataFrame) -> DataFrame:
    """Project / cast to the declared vehicle schema (missing columns NULL)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in VEHICLES.fields])


def constraint_violations(df: DataFrame, required: list[str] | None = None) -> Column:
    """Array of the required columns that are NULL in the row (empty = valid)."""
    required = [c for c in (required or VEHICLES_REQUIRED) if c in df.columns]
    flags = [F.when(F.col(c).isNull(), F.lit(c)) for c in required]
    if not flags:
        return F.array().cast("array<string>")
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def identity_columns(items: DataFrame, identity: str = "title") -> dict[str, Column]:
    """year / make / model / trim of the stored row.

    identity='title' (the reference rule): parsed from the item title, NULLs
    included, defaults make BMW and model X3.  identity='payload': the item's
    own values where present, the parsed title filling the gaps."""
    parsed = parse_title(F.col("title") if "title" in items.columns else F.lit(""))
    out = {c: parsed[c] for c in IDENTITY_FIELDS}
    if identity == "payload" and "title" not in items.columns:
        # nothing to parse: identity fields are supplied only if present
        return {c: F.col(c) for c in IDENTITY_FIELDS if c in items.columns}
    if identity == "payload":
        for c in ("year", "model", "trim"):
            if c in items.columns:
                out[c] = F.coalesce(F.col(c).cast(VEHICLES[c].dataType), parsed[c])
    elif identity != "title":
        raise ValueError("identity must be 'title' or 'payload'")
    return out


def merge(target: DataFrame, items: DataFrame, as_of, seq: list[str] | None = None,
          identity: str = "title", keep_seq: bool = False, cut=None) -> tuple[DataFrame, DataFrame]:
    """Upsert ``items`` into ``target``; returns (new table, rejects).

    ``seq``: item columns giving the arrival order (last wins).  When absent
    the items must already be one per VIN.  ``as_of``: the write time
    (a literal, so reruns give the same table).  ``keep_seq``: carry the
    winning sequence in a ``_seq`` column so later merges are order-aware
    (an item older than the stored one does not replace it); a target that
    has ``_seq`` is always merged order-aware.  ``cut``: applied to the joined
    rows that both results are taken from, e.g. a checkpoint, so a caller that
    uses both runs the join once.  Rejects carry vin, violations and, with
    ``seq``, the item's ``_seq``."""
    as_of = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    seq = seq or []
    supplied = [c for c in ITEM_FIELDS if c in items.columns]
    ident = identity_columns(items, identity)
    ident_fields = [c for c in IDENTITY_FIELDS if c in ident]
    staged = items.select(
        F.col("vin"),
        *[F.col(c).cast(VEHICLES[c].dataType).alias(c) for c in supplied],
        *[ident[c].cast(VEHICLES[c].dataType).alias(c) for c in ident_fields],
        *([F.col("id").cast("bigint").alias("_new_id")] if "id" in items.columns else []),
        *([F.struct(*seq).alias("_seq")] if seq else []))
    # 1. rows invalid on their own (a supplied NULL in a required column).
    present_cols = set(["vin"] + supplied + ident_fields)
    required = [c for c in VEHICLES_REQUIRED if c in present_cols]
    checked = staged.withColumn("violations", constraint_violations(staged, required))
    rejects = checked.where(F.size("violations") > 0)
    valid = checked.where(F.size("violations") == 0).drop("violations")
    # 2. last write per VIN.
    if seq:
        valid = last_per_key(valid, "vin", ["_seq"])
    # 3. merge.
    s = valid.alias("s")
    t = target.alias("t")
    j = s.join(t, F.col("s.vin") == F.col("t.vin"), "full_outer")
    take = F.col("s.vin").isNotNull()
    order_aware = seq and "_seq" in target.columns
    if order_aware:
        take = take & (F.col("t._seq").isNull() | (F.col("s._seq") >= F.col("t._seq")))
    cols = []
    for f in VEHICLES.fields:
        c = f.name
        if c == "vin":
            cols.append(F.coalesce(F.col("s.vin"), F.col("t.vin")).alias("vin"))
        elif c == "id":
            new_id = F.col("s._new_id") if "id" in items.columns else F.lit(None).cast("bigint")
            cols.append(F.coalesce(F.col("t.id"), new_id,
                                   F.xxhash64(F.col("s.vin")).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))).alias("id"))
        elif c in supplied or c in ident_fields:
            cols.append(F.when(take, F.col("s." + c)).otherwise(F.col("t." + c)).alias(c))
        elif c in ("scraped_at", "updated_at"):
            cols.append(F.when(take, as_of).otherwise(F.col("t." + c)).alias(c))
        elif c == "created_at":
            cols.append(F.when(take, F.coalesce(F.col("t.created_at"), as_of))
                        .otherwise(F.col("t.created_at")).alias(c))
        else:  # column absent from the items: keep the stored value
            cols.append(F.col("t." + c).alias(c))
    extra = []
    if keep_seq and seq:
        old_seq = F.col("t._seq") if "_seq" in target.columns else F.lit(None)
        extra.append(F.when(take, F.col("s._seq")).otherwise(old_seq).alias("_seq"))
    if seq:
        extra.append(F.col("s._seq").alias("_item_seq"))
    merged = j.select(*cols, *extra, take.alias("_touched"), F.col("t.vin").isNotNull().alias("_existed"))
    # An insert of an item that lacks a required column breaks NOT NULL too.
    merged = merged.withColumn("violations", constraint_violations(merged))
    if cut is not None:
        merged = cut(merged)
    bad_insert = F.col("_touched") & ~F.col("_existed") & (F.size("violations") > 0)
    late_rejects = merged.where(bad_insert)
    table = merged.where(~bad_insert).drop("_touched", "_existed", "violations")
    late = [F.col("_item_seq").alias("_seq")] if seq else []
    all_rejects = rejects.select("vin", "violations", *(["_seq"] if seq else [])).unionByName(
        late_rejects.select("vin", "violations", *late))
    if keep_seq and seq:
        return _conform_with_seq(table), all_rejects
    return conform(table), all_rejects


def upsert_into(table: BucketTable, items: DataFrame, as_of, seq: list[str] | None = None,
                identity: str = "title", rejects_to: str | None = None, name: str | None = None) -> DataFrame:
    """Upsert ``items`` into a stored table: the buckets of their VINs are read,
    merged and written anew, all others carried over.  Returns the rejects
    (``merge``), written to the folder ``rejects_to`` (default: next to the table).

    The items and the merged rows are used several times and kept (``persist``)
    meanwhile; what a lost executor kept is worked out again."""
    spark = items.sparkSession
    version = table.next(name)
    items = items.persist()
    kept = [items]

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist())
        return kept[-1]
    try:
        touched = table.touched(items)
        merged, rejects = merge(table.read(touched), items, as_of, seq=seq, identity=identity, cut=keep)
        path = rejects_to or f"{table.root}/_rejects/{version.name}-{uuid.uuid4().hex[:8]}"
        rejects.write.parquet(path)
        table.replace(merged, touched, version=version)
        return spark.read.schema(rejects.schema).parquet(path)
    finally:
        for df in kept:
            df.unpersist()


def _conform_with_seq(df: DataFrame) -> DataFrame:
    """Declared vehicle columns plus the hidden ``_seq`` state column."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in VEHICLES.fields], "_seq")


def duplicate_vins(vehicles: DataFrame) -> DataFrame:
    """Post-condition of the unique-VIN rule: VINs stored more than once."""
    return vehicles.groupBy("vin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def create_tables(spark: SparkSession, base: str) -> dict[str, str]:
    """Create the empty ``vehicles`` and ``scrape_runs`` tables (declared
    schemas) under ``base``; existing tables are left as they are."""
    from ..sources.schemas import RUNS
    paths = {"vehicles": f"{base.rstrip('/')}/vehicles", "scrape_runs": f"{base.rstrip('/')}/scrape_runs"}
    for name, schema in (("vehicles", VEHICLES), ("scrape_runs", RUNS)):
        if not path_exists(spark, paths[name] + "/_SUCCESS"):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(paths[name])
    return paths


def insert_violations(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(vin, reason) of rows a plain insert may not add: a required column is
    NULL ('null: ...'), the VIN is there twice ('repeated vin'), or it is
    stored already ('stored vin')."""
    rows = conform(rows)
    empty = rows.withColumn("v", constraint_violations(rows)).where(F.size("v") > 0).select(
        "vin", F.concat(F.lit("null: "), F.array_join("v", ",")).alias("reason"))
    vins = rows.where(F.col("vin").isNotNull()).groupBy("vin").agg(F.count(F.lit(1)).alias("n"))
    out = empty.unionAll(vins.where("n > 1").select("vin", F.lit("repeated vin").alias("reason")))
    if stored is not None:
        out = out.unionAll(vins.join(stored.select("vin"), "vin", "left_semi").select("vin", F.lit("stored vin").alias("reason")))
    return out


def bulk_insert(rows: DataFrame, path: str) -> DataFrame:
    """Append rows to the table at ``path`` under its rules (NOT NULL columns,
    unique VIN).  All or nothing: if any row breaks a rule, nothing is written
    and the violations (vin, reason) are returned; else none are."""
    spark = rows.sparkSession
    stored = spark.read.schema(VEHICLES).parquet(path) if path_exists(spark, path) else None
    bad = insert_violations(rows, stored)
    if bad.limit(1).count() == 0:
        conform(rows).write.mode("append").parquet(path)
    return bad
