"""Capture payload -> one row per vehicle record.

The payload is parsed to VARIANT once (its own projection, below every field
read), the vehicle list is chosen by the platform's path rules, and the list
is exploded with its position.  Diagnostics (attempted paths, presence of
the vendor objects, page completeness) are plain projections of the same
parsed value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variant as V
from .platforms import PlatformSpec

PAGE_SIZE = 18


def parse_payload(captures: DataFrame, col: str = "payload") -> DataFrame:
    """Parse the JSON text once; invalid JSON gives NULL (no rows later)."""
    return captures.withColumn("v", F.try_parse_json(F.col(col)))


def chosen_list(spec: PlatformSpec, v: Column) -> tuple[Column, Column]:
    """(the chosen list as a VARIANT or NULL, its path).  Only a non-empty
    array is ever chosen, so exploding it yields exactly its members."""
    ok = V.is_object_cheap(v)
    if spec.object_parent:
        ok = ok & (V.object_at(v, spec.object_parent) | V.get(v, spec.object_parent).isNull())
    lst = None
    path = None
    for p in spec.paths:
        hit = V.nonempty_array_at(v, p)
        val = V.get_path(v, p)
        lst = F.when(hit, val) if lst is None else lst.when(hit, val)
        path = F.when(hit, F.lit(p)) if path is None else path.when(hit, F.lit(p))
    if spec.gate:
        gated = V.exists_at(v, spec.gate)
        prim_hit = V.nonempty_array_at(v, spec.primary)
        lst = F.when(ok, F.when(gated, F.when(prim_hit, V.get_path(v, spec.primary))).otherwise(lst))
        path = F.when(ok & gated & prim_hit, F.lit(spec.primary)).when(ok & ~gated, path)
    else:
        lst = F.when(ok, lst)
        path = F.when(ok, path)
    return lst, path


def explode_records(spec: PlatformSpec, parsed: DataFrame, keep=("dealer", "page_no", "source_url")) -> DataFrame:
    """One row per list member: (keep..., path, pos, rec VARIANT).

    The chosen list stays a VARIANT and is exploded by the ``variant_explode``
    table function in a lateral join (no ARRAY<VARIANT> copy of the list)."""
    spark = parsed.sparkSession
    lst, path = chosen_list(spec, F.col("v"))
    staged = parsed.select(*keep, path.alias("path"), lst.alias("_lst"))
    out = staged.lateralJoin(spark.tvf.variant_explode(F.col("_lst").outer()))
    return out.select(*keep, "path", "pos", F.col("value").alias("rec"))


def extract(spec: PlatformSpec, captures: DataFrame, keep=("dealer", "page_no", "source_url")) -> DataFrame:
    caps = captures.where(F.col("platform") == spec.name) if "platform" in captures.columns else captures
    return explode_records(spec, parse_payload(caps), keep)


def key_column(key: str) -> str:
    """Column of a record's key in the stored records.  Keys may differ by case
    alone, which column names may not: capitals are written with a dash."""
    return "k_" + "".join("-" + c.lower() if c.isupper() else c for c in key)


def shredded_records(spec: PlatformSpec, captures: DataFrame, keys: list[str],
                     keep=("dealer", "page_no", "source_url", "captured_at")) -> DataFrame:
    """Records of one platform as they are stored: (keep..., path, pos, kind, rec, a column for each of ``keys``).

    ``kind`` is the record's type (OBJECT, STRING, ...); ``rec``, the whole record, is
    null unless it is an object, and a list of one: Spark does not shred what is in a list, and all
    its fields would be shredded a second time.  Each key is a VARIANT column of its own, which Spark
    writes shredded by the type it mostly has, so whoever reads the table later reads
    the keys that are asked for, and parses nothing.  (Fields of one shredded column
    would be pushed into the scan as well, but the scan reads the whole column.)"""
    recs = extract(spec, captures, keep)
    keys = list(dict.fromkeys(keys))
    recs = recs.select("*", V.fields(F.col("rec"), keys).alias("_k"))
    is_object = F.col("_k").isNotNull()
    # the schema of an object is not worked out to learn that it is one
    kind = F.when(is_object, F.lit("OBJECT")).otherwise(
        F.regexp_extract(F.schema_of_variant("rec"), "^[A-Z]+", 0))
    return recs.select(*keep, "path", "pos", kind.alias("kind"), F.when(is_object, F.array("rec")).alias("rec"),
                       *[F.col(f"_k._{i}").alias(key_column(k)) for i, k in enumerate(keys)])


# ---------------------------------------------------------------- diagnostics
def _py_type(v: Column, path: str, n: Column, default_missing: str) -> Column:
    """Type of what is at ``path``; ``n``: members of the array there.  Only a value
    that is no container is copied to look at it."""
    val = V.get_path(v, path)
    t = V.vtype(val)
    return (F.when(n.isNotNull(), F.lit("list"))
            .when(V.object_at(v, path), F.lit("dict"))
            .when(val.isNull(), F.lit(default_missing))
            .when(F.is_variant_null(val), F.lit("NoneType"))
            .when(t == "STRING", F.lit("str"))
            .when(t == "BOOLEAN", F.lit("bool"))
            .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("int"))
            .otherwise(F.lit("float")))


def path_diagnostics(spec: PlatformSpec, captures: DataFrame) -> DataFrame:
    """For each capture, each attempted list path with its type and length,
    up to and including the first path that yields a non-empty list.  A
    missing path reads as an empty list when the platform reads it with an
    empty-list default, else as ``NoneType``.  Captures whose payload is not
    an object, whose parent container is present but not an object, or whose
    gate path exists (the primary list is read instead) have no attempted
    fallback paths."""
    parsed = parse_payload(captures.where(F.col("platform") == spec.name))
    v = F.col("v")
    # one look at each path; a payload is a whole page, so nothing of it is copied
    parsed = parsed.select("*", *[V.size_at(v, p).alias(f"_n{i}") for i, p in enumerate(spec.paths)])
    ok = V.is_object_cheap(v)
    if spec.object_parent:
        ok = ok & (V.object_at(v, spec.object_parent) | V.get(v, spec.object_parent).isNull())
    if spec.gate:
        ok = ok & ~V.exists_at(v, spec.gate)
    missing = "list" if spec.object_parent else "NoneType"
    entries = []
    for i, p in enumerate(spec.paths):
        n = F.col(f"_n{i}")
        typ = _py_type(v, p, n, missing)
        ln = F.when(n.isNotNull(), n.cast("string"))
        if missing == "list":
            ln = ln.when(V.get_path(v, p).isNull(), F.lit("0"))
        ln = ln.otherwise(F.lit("N/A"))
        found_before = F.greatest(F.lit(0), F.lit(0), *[F.col(f"_n{q}") for q in range(i)]) > 0
        entries.append(F.when(~found_before, F.struct(F.lit(i + 1).alias("step"), F.lit(p).alias("path"),
                                                      typ.alias("path_type"), ln.alias("path_len"))))
    arr = F.filter(F.array(*entries), lambda x: x.isNotNull())
    out = parsed.select("dealer", "page_no", "capture_kind", F.when(ok, arr).alias("_a"))
    # outer: of a plain explode Spark infers a filter that works out the array, parse and all, once more below
    return out.select("dealer", "page_no", "capture_kind", F.explode_outer("_a").alias("d")).where("d IS NOT NULL").select(
        "dealer", "page_no", "capture_kind", "d.step", "d.path", "d.path_type", "d.path_len")


def presence(captures: DataFrame) -> DataFrame:
    """Vendor-object presence flags of a Dealer.com page: DDC and its keys,
    InvData and its keys, inventory (its type and keys), and whether
    inventory.inventory is an array (length)."""
    parsed = parse_payload(captures.where(F.col("platform") == "dealercom"))
    v = F.col("v")
    inv_path = "DDC.InvData.inventory"
    inv = V.get_path(v, inv_path)
    inv_object = V.object_at(v, inv_path)

    def keys_of(path: str) -> Column:
        k = F.map_keys(F.try_variant_get(v, "$." + path, "map<string,struct<>>"))
        return F.coalesce(F.array_join(F.sort_array(k), ","), F.lit(""))

    t = V.vtype(inv)
    inv_type = (F.when(inv_object | V.size_at(v, inv_path).isNotNull(), F.lit("object"))
                .when(inv.isNull(), F.lit("undefined"))
                .when(F.is_variant_null(inv), F.lit("object"))
                .when(t == "STRING", F.lit("string")).when(t == "BOOLEAN", F.lit("boolean"))
                .otherwise(F.lit("number")))
    inner = V.size_at(v, inv_path + ".inventory")
    return parsed.select(
        "dealer", "page_no", "capture_kind",
        V.exists_at(v, "DDC").alias("has_ddc"),
        keys_of("DDC").alias("ddc_keys"),
        V.exists_at(v, "DDC.InvData").alias("has_invdata"),
        keys_of("DDC.InvData").alias("invdata_keys"),
        V.exists_at(v, inv_path).alias("has_inventory"),
        inv_type.alias("inventory_type"),
        F.when(inv_object, keys_of(inv_path)).otherwise(F.lit("")).alias("inventory_keys"),
        inner.isNotNull().alias("inventory_is_array"),
        inner.alias("inventory_length"))


def completeness(spec: PlatformSpec, captures: DataFrame) -> DataFrame:
    """Whether a page signals more pages: a full page (>= 18 records) that also
    carries a next link."""
    parsed = parse_payload(captures.where((F.col("platform") == spec.name)))
    lst, _ = chosen_list(spec, F.col("v"))
    n = F.coalesce(V.size_at(lst, ""), F.lit(0))
    return parsed.select("dealer", "page_no", "capture_kind", n.alias("n_records"),
                         ((n >= PAGE_SIZE) & F.col("next_url").isNotNull()).alias("has_more"))
