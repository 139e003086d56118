"""Continuous VIN upsert: listing items arriving as files are merged into the
vehicle table micro-batch by micro-batch.

``readStream`` (file source, declared schema) -> ``foreachBatch``.  The state is a
table in hash buckets of the VIN (``sources.buckets``).  A batch reads the buckets of
its own VINs, by bucket and so without a shuffle of the stored rows, merges its items
into them, and appends the rows that came out to those buckets as a delta; what is
read and written grows with the batch's buckets, not with the table.  The table is
the newest row of each VIN over a bucket's parts.  After ``compact_every`` deltas the
buckets that have any are folded, one part each; the others are carried over by name,
and parts that no kept version names are deleted.

The version that a batch makes carries the batch id, so a rerun after a failure
does nothing if its version is there and writes the same delta again if not; the
stream checkpoint records which files are done.  Rows carry the winning arrival
order in ``_seq``, so a late file never overwrites newer data and the result does not
depend on how files are grouped into batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import last_per_key, merge
from ..session import path_exists, work_dir
from ..sources.buckets import BucketTable
from ..sources.store import list_dirs

BATCH = "batch"     # the version's mark: the last batch that it holds


class StreamTable(BucketTable):
    """A stream's table below ``run_dir``: parts ``base/batch=<n>`` and ``delta/batch=<n>``,
    and ``rejects/batch=<n>``."""

    def __init__(self, spark: SparkSession, run_dir: str, schema: T.StructType, rejects_schema: T.StructType,
                 buckets: int | None = None, keep: int = 2):
        super().__init__(spark, run_dir, schema, "vin", buckets, keep)
        self.run_dir, self.rejects_schema = self.root, rejects_schema

    def _batches(self, kind: str) -> list[int]:
        parts = {p for ps in self.latest().parts.values() for p in ps}
        return sorted(int(p.split("=")[1]) for p in parts if p.startswith(f"{kind}/"))

    def base(self) -> int | None:
        """The last batch whose deltas have been folded (-1: the initial table)."""
        latest = self.latest()
        return latest.marks.get("base") if latest else None

    def deltas(self) -> list[int]:
        """Batches whose deltas have not been folded."""
        return self._batches("delta")

    def done(self) -> int:
        """The last batch that the table holds (-1: none)."""
        latest = self.latest()
        return latest.marks.get(BATCH, -1) if latest else -1

    def begin(self, initial: DataFrame) -> None:
        version = self.next()
        version.marks = {BATCH: -1, "base": -1}
        self.replace(initial, part="base/batch=-1", version=version)

    def upsert_batch(self, batch: DataFrame, batch_id: int, as_of, seq: list[str], identity: str,
                     compact_every: int) -> None:
        if batch_id <= self.done():
            return
        batch = batch.persist()             # read for the buckets, the merge and the rejects
        kept = [batch]

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]
        try:
            vins = batch.select("vin").distinct()
            stored = last_per_key(self.parts(self.touched(batch)).join(vins, "vin", "left_semi"), "vin", ["_part"])
            merged, rejects = merge(stored.drop("_part"), batch, as_of, seq=seq, identity=identity, keep_seq=True, cut=keep)
            rejects.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{self.root}/rejects/batch={batch_id}")
            version = self.next()
            version.marks[BATCH] = batch_id
            self.append(merged, f"delta/batch={batch_id}", version)
        finally:
            for df in kept:
                df.unpersist()
        if len(self.deltas()) >= compact_every:
            self.compact()

    def compact(self) -> None:
        """Fold the buckets that have deltas."""
        version = self.next()
        version.marks["base"] = version.marks[BATCH]
        self.fold(f"base/batch={version.marks[BATCH]}", version)

    def rejects(self) -> DataFrame:
        """(vin, violations, _seq, batch) of the items that were turned down."""
        done = [n for n in list_dirs(self.spark, f"{self.root}/rejects")
                if n.startswith("batch=") and path_exists(self.spark, f"{self.root}/rejects/{n}/_SUCCESS")]
        if not done:
            return self.spark.createDataFrame([], self.rejects_schema)
        return self.spark.read.schema(self.rejects_schema).parquet(*[f"{self.root}/rejects/{n}" for n in sorted(done)])


def open_stream_table(spark: SparkSession, run_dir: str, items: T.StructType, initial: DataFrame, as_of, seq: list[str],
                      identity: str = "title") -> StreamTable:
    """The table of a stream of ``items``; a new one begins with ``initial``."""
    empty = spark.createDataFrame([], items)
    table, rejects = merge(initial.limit(0), empty, as_of, seq=seq, identity=identity, keep_seq=True)
    out = StreamTable(spark, run_dir, table.schema, rejects.withColumn("batch", F.lit(0)).schema)
    if out.latest() is None:
        out.begin(initial.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields]))
    return out


def run_stream_upsert(spark: SparkSession, source_dir: str, schema: T.StructType, initial: DataFrame,
                      as_of, seq: list[str], identity: str = "title", files_per_batch: int | None = None,
                      run_dir: str | None = None, compact_every: int = 16) -> StreamTable:
    """Run the upsert stream over everything in ``source_dir`` (availableNow).

    ``files_per_batch``: files of one micro-batch (None: all that are there).
    Batches committed by an earlier run with the same ``run_dir`` are picked up."""
    table = open_stream_table(spark, run_dir or f"{work_dir(spark)}/streams/upsert-{uuid.uuid4().hex}", schema, initial,
                              as_of, seq, identity)
    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    q = (stream.parquet(source_dir).writeStream
         .foreachBatch(lambda batch, batch_id: table.upsert_batch(batch, batch_id, as_of, seq, identity, compact_every))
         .option("checkpointLocation", f"{table.run_dir}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table
