"""Statistics of a table in buckets, kept by bucket and merged when they are read.

For every bucket one row: its parts, the number of its rows, and sketches of its
distinct values.  After a write, ``refresh`` reads the buckets whose parts are others
than those the row was made from, and no more; reading the statistics reads as many
rows as there are buckets.  Counts are exact; distinct values come from HyperLogLog
sketches, which the exact query next to them can check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import path_exists
from .buckets import BUCKET, BucketTable, Version
from .store import delete_dir, list_dirs

SKETCHED = ("dealer", "model")


class BucketStats:
    def __init__(self, table: BucketTable, sketched=SKETCHED):
        self.table, self.spark, self.sketched = table, table.spark, sketched
        self.root = f"{table.root}/_stats"

    def _done(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in list_dirs(self.spark, self.root)
                      if n.startswith("v=") and path_exists(self.spark, f"{self.root}/{n}/_SUCCESS"))

    def rows(self) -> DataFrame | None:
        """(bucket, parts, n, one sketch a column) of the version the statistics are at."""
        done = self._done()
        return self.spark.read.parquet(f"{self.root}/v={done[-1]}") if done else None

    def stale(self, version: Version) -> list[int]:
        """Buckets whose statistics are not those of ``version``."""
        rows = self.rows()
        known = {r[0]: r[1] for r in rows.select("bucket", "parts").collect()} if rows is not None else {}
        return sorted(b for b, p in version.parts.items() if known.get(b) != ",".join(p))

    def refresh(self) -> list[int]:
        """Bring the statistics to the latest version; the buckets that were read for it."""
        version = self.table.latest()
        if version is None:
            return []
        done = self._done()
        if done and done[-1] == version.number:
            return []
        stale, old = self.stale(version), self.rows()
        parts = self.spark.createDataFrame([(b, ",".join(version.parts[b])) for b in stale], "bucket int, parts string")
        new = (self.table.read(stale, version).groupBy(self.table.bucket().alias("bucket"))
               .agg(F.count(F.lit(1)).alias("n"), *[F.hll_sketch_agg(c).alias(c) for c in self.sketched]))
        new = parts.join(new, "bucket")
        if old is not None:
            keep = sorted(set(version.parts) - set(stale))
            new = new.unionByName(old.where(F.col("bucket").isin(keep) if keep else F.lit(False)).select(*new.columns))
        new.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/v={version.number}")
        for n in done[:-1]:
            delete_dir(self.spark, f"{self.root}/v={n}")
        return stale

    def read(self) -> DataFrame:
        """One row: total_vehicles, and total_<column>s of each sketched column."""
        rows = self.rows()
        if rows is None:
            raise LookupError("no statistics yet: refresh() first")
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_vehicles"),
                        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(f"total_{c}s")
                          for c in self.sketched])
