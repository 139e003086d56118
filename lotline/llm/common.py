"""Shared folder, session settings and small plan helpers for the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_conf, ship, work_dir
from ..sources.store import delete_dir
from ..sources.tables import table

# Rows and bytes of one Arrow batch: long texts must not meet in one batch.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
         "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
# Rows of a table that may be broadcast (after they have been counted).
BROADCAST_ROWS = 100_000


def settle(spark: SparkSession) -> None:
    """Settings every query of this subpackage relies on."""
    apply_conf(spark)
    ship(spark)
    for k, v in ARROW.items():
        spark.conf.set(k, v)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder (spark.checkpoint.dir)."""
    ship(spark)
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/llm/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application's operators have written to the shared
    folder.  Results read those files, so call it when they have been stored."""
    delete_dir(spark, _own(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the files cut the
    lineage and are where a job starts again when executors are lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        out.append(n)
        have.add(n.lower())
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``mapInArrow`` of a function from batch to batch."""
    ship(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = fn(b)
            if out is not None and out.num_rows:
                yield out
    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def join_counted(left: DataFrame, right: DataFrame, on: str | list[str], how: str,
                 limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a written ``right`` side, which is broadcast only if it has
    been counted to be small; else both sides are shuffled."""
    if right.limit(limit + 1).count() <= limit:
        right = F.broadcast(right)
    return left.join(right, on, how)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text has remainder ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))
