"""Ranks over a whole table, and pages by the last row seen.

Rows are dealt to ranges of the order and sorted where they are; a row's rank is its
place in its partition plus the rows of all partitions before.  No task sees more than
its range, and rows of equal value are told apart by the key, so they are split too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import SORTABLE, _ci


def _order(df: DataFrame, column: str, ascending: bool, key: str) -> list[Column]:
    """User order: strings without case, missing values last either way, then the key."""
    value = _ci(df, column)
    return [value.isNull().asc(), value.asc() if ascending else value.desc(), F.col(key).asc()]


def ranked(df: DataFrame, path: str, column: str, ascending: bool = True, key: str = "vin") -> DataFrame:
    """``df`` with its 1-based ``sort_rank`` in the user order of ``column``.

    The sorted rows are written to ``path`` first: where a range begins and ends is
    found by sampling, so it is fixed once and for all by the files.  What is then
    counted and broadcast is one row a partition."""
    if column not in SORTABLE:
        raise ValueError(f"cannot sort on {column!r}; choose one of {SORTABLE}")
    order = _order(df, column, ascending, key)
    # high bits: the partition; low 33 bits: the place in it
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .withColumn("_place", F.monotonically_increasing_id()).write.parquet(path))
    rows = df.sparkSession.read.parquet(path)
    part = F.shiftright("_place", 33)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_p long, _before long")
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (rows.withColumn("_p", part).join(F.broadcast(offsets), "_p")
            .withColumn("sort_rank", F.col("_before") + place + 1).drop("_p", "_before", "_place"))


def page_after(df: DataFrame, column: str, size: int, after: tuple | None = None, ascending: bool = True,
               key: str = "vin") -> DataFrame:
    """The ``size`` rows that follow ``after`` = (value, key) in the user order (None: the first).

    The position is a filter, not an offset, so the hundredth page costs what the first
    does: each partition keeps its own first ``size`` rows beyond it."""
    if column not in SORTABLE:
        raise ValueError(f"cannot sort on {column!r}; choose one of {SORTABLE}")
    if size < 0:
        raise ValueError("a page needs a non-negative size")
    if after is not None:
        last, at = after
        value = _ci(df, column)
        if last is None:
            df = df.where(value.isNull() & (F.col(key) > at))
        else:
            bound = F.lower(F.lit(last)) if dict(df.dtypes)[column] == "string" else F.lit(last)
            further = value > bound if ascending else value < bound
            df = df.where(further | ((value == bound) & (F.col(key) > at)) | value.isNull())
    return df.orderBy(*_order(df, column, ascending, key)).limit(size)
