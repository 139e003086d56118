"""Inventory queries over the vehicle table: filters, search, sort, limit,
counts, distinct lists and the result envelope."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import API_COLUMNS

# Escape character for the search pattern: one that never appears in input,
# so '%' and '_' typed by the user stay wildcards and no character escapes.
NO_ESCAPE = "\u0001"

# Columns the listing table can be sorted on by the user.
SORTABLE = ("dealer", "title", "year", "price", "odometer", "ext_color")

# The model list always offered, whether stocked or not.
STATIC_MODELS = ['2 Series', '3 Series', '4 Series', '5 Series', '7 Series', '8 Series',
                 'i4', 'i5', 'i7', 'iX', 'M2', 'M3', 'M4', 'M5', 'M8',
                 'X1', 'X2', 'X3', 'X3 M', 'X4', 'X4 M', 'X5', 'X5 M', 'X6', 'X6 M', 'X7', 'XM', 'Z4']

SEARCHED = ("title", "vin", "dealer", "ext_color")


def _check_price(name: str, v) -> float | None:
    if v is None:
        return None
    if isinstance(v, bool):
        raise ValueError(f"{name} must be a number, got {v!r}")
    try:
        return float(v)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a number, got {v!r}") from None


def search_predicate(text: str) -> Column:
    """Case-insensitive substring match over title, vin, dealer and ext_color."""
    pattern = F.lit(f"%{text}%")
    esc = F.lit(NO_ESCAPE)
    return functools.reduce(operator.or_, [F.ilike(F.col(c), pattern, esc) for c in SEARCHED])


def vehicle_predicates(dealer: str | None = None, model: str | None = None,
                       min_price=None, max_price=None, search: str | None = None) -> list[Column]:
    """Only supplied filters take part.  Text filters are skipped when empty;
    price bounds only when None, so 0 is a live bound."""
    lo = _check_price("min_price", min_price)
    hi = _check_price("max_price", max_price)
    preds: list[Column] = []
    if dealer:
        preds.append(F.col("dealer") == F.lit(dealer))
    if model:
        preds.append(F.col("model") == F.lit(model))
    if lo is not None:
        preds.append(F.col("price") >= F.lit(lo))
    if hi is not None:
        preds.append(F.col("price") <= F.lit(hi))
    if search:
        preds.append(search_predicate(search))
    return preds


def filter_vehicles(vehicles: DataFrame, **filters) -> DataFrame:
    preds = vehicle_predicates(**filters)
    if not preds:
        return vehicles
    return vehicles.where(functools.reduce(operator.and_, preds))


def apply_limit(df: DataFrame, limit: int | None) -> DataFrame:
    """limit < 0 or None means no limit; larger than the data returns all."""
    if limit is None or limit < 0:
        return df
    return df.limit(int(limit))


def search_vehicles(vehicles: DataFrame, dealer=None, model=None, min_price=None, max_price=None,
                    search=None, limit: int | None = 100) -> DataFrame:
    """Filtered listing ordered by price (highest first, unpriced last), VIN as tie-break,
    cut to ``limit`` and projected to the 16 API columns.  Sort + limit plans as
    TakeOrderedAndProject: each partition keeps its own top ``limit`` rows."""
    df = filter_vehicles(vehicles, dealer=dealer, model=model, min_price=min_price,
                         max_price=max_price, search=search)
    df = df.orderBy(F.col("price").desc_nulls_last(), F.col("vin").asc())
    return apply_limit(df, limit).select(*API_COLUMNS)


def _ci(df: DataFrame, column: str) -> Column:
    dtype = dict(df.dtypes)[column]
    return F.lower(F.col(column)) if dtype == "string" else F.col(column)


def _page(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows in the API order (price desc, vin): what one task may rank."""
    if limit is None or limit < 0:
        raise ValueError("a page needs a non-negative limit")
    return rows.orderBy(F.col("price").desc_nulls_last(), F.col("vin").asc()).limit(int(limit))


def with_position(rows: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` rows in the API order with their rank."""
    w = Window.orderBy(F.col("price").desc_nulls_last(), F.col("vin").asc())
    return _page(rows, limit).withColumn("position", F.row_number().over(w).cast("bigint"))


def sort_rows(rows: DataFrame, column: str, ascending: bool = True, position: str = "position",
              limit: int = 100) -> DataFrame:
    """Stable user sort of a listing page.

    ``position`` is the row's rank in the incoming order; it breaks ties so
    the sort is stable.  Adds ``sort_rank`` (1-based).  Only the first ``limit``
    positions are ranked: the rank is one global ordering."""
    if column not in SORTABLE:
        raise ValueError(f"cannot sort on {column!r}; choose one of {SORTABLE}")
    if limit is None or limit < 0:
        raise ValueError("a page needs a non-negative limit")
    page = rows.orderBy(F.col(position).asc()).limit(int(limit))
    key = _ci(rows, column)
    key = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    w = Window.orderBy(key, F.col(position).asc())
    return page.withColumn("sort_rank", F.row_number().over(w).cast("bigint"))


def envelope(page: DataFrame, limit: int) -> DataFrame:
    """Result envelope ``{vehicles: [...], count}`` as one row, of the first
    ``limit`` rows in the API order."""
    ranked = with_position(page, limit)
    item = F.struct(F.col("position"), F.col("vin"), F.col("dealer"), F.col("title"))
    arr = F.sort_array(F.collect_list(item))
    arr = F.transform(arr, lambda x: F.struct(x["vin"].alias("vin"), x["dealer"].alias("dealer"),
                                              x["title"].alias("title")))
    return ranked.agg(F.to_json(arr).alias("vehicles"), F.count(F.lit(1)).alias("count"))


def stats(vehicles: DataFrame, approx: bool = False) -> DataFrame:
    """Total vehicles and distinct dealers (partial + final aggregate).

    ``approx=True`` counts dealers with a HyperLogLog++ sketch (bounded
    memory, merged map-side) instead of an exact distinct."""
    dealers = F.approx_count_distinct("dealer") if approx else F.count_distinct("dealer")
    return vehicles.agg(F.count("id").alias("total_vehicles"), dealers.alias("total_dealers"))


def stats_with_last_run(vehicles: DataFrame, runs: DataFrame) -> DataFrame:
    """Stats row plus the latest run's start, status and vehicle count (NULL
    when there is no run).  Both parts are single-row aggregates, combined by
    a union and one more aggregate rather than a join."""
    st = stats(vehicles)
    pick = F.max_by(F.struct("started_at", "status", "vehicles_scraped"), F.col("started_at")).alias("_r")
    last = runs.agg(pick).select(F.col("_r.started_at").alias("last_run_started_at"),
                                 F.col("_r.status").alias("last_run_status"),
                                 F.col("_r.vehicles_scraped").alias("last_run_vehicles_scraped"))
    both = st.unionByName(last, allowMissingColumns=True)
    cols = st.columns + last.columns
    return both.agg(*[F.max(c).alias(c) for c in cols])


def count_by_dealer(vehicles: DataFrame) -> DataFrame:
    return vehicles.groupBy("dealer").agg(F.count(F.lit(1)).alias("n"))


def dealers_distinct(vehicles: DataFrame) -> DataFrame:
    return vehicles.select("dealer").distinct().orderBy("dealer")


def models_union(vehicles: DataFrame) -> DataFrame:
    """Fixed model list united with every stocked model (non-null, non-empty),
    distinct, in code-point order."""
    spark = vehicles.sparkSession
    static = spark.createDataFrame([(m,) for m in STATIC_MODELS], "model string")
    stocked = vehicles.select("model").where(F.col("model").isNotNull() & (F.col("model") != ""))
    return stocked.unionByName(static).distinct().orderBy("model")


def model_like(vehicles: DataFrame, fragment: str) -> DataFrame:
    """Documented ad-hoc query ``model LIKE '%X3%'``: LIKE ignores case, and no
    character escapes."""
    return vehicles.where(F.ilike(F.col("model"), F.lit(f"%{fragment}%"), F.lit(NO_ESCAPE))).select(*API_COLUMNS)
