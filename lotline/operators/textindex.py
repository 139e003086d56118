"""Substring search by posting lists of trigrams.

For every three characters (lower case) that occur in one of a row's searched
columns, the index holds the row's key; it is bucketed and sorted by trigram, so a
look-up reads one bucket, and there the row groups of the trigram.  A search takes
the rarest trigrams of its pattern, keeps the keys that are in all of their lists,
and checks the pattern itself on those rows, so its answer is that of the scan.

A pattern is cut at its wildcards ``%`` and ``_``.  One without three characters in
a row, or whose rarest trigram is in a ``SCAN_SHARE`` of all rows, is answered by the
scan, which then reads no more than the index would make it read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import attach_bucketed, write_bucketed
from .search import NO_ESCAPE, SEARCHED, search_predicate

RAREST = 4              # trigrams of a pattern that are looked up
SCAN_SHARE = 0.25
KEYS = 1000             # so many keys are looked up as a filter; more are joined


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of a text, in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.length(low)
    places = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3))))


def build(vehicles: DataFrame, path: str, buckets: int, columns=SEARCHED, key: str = "vin") -> str:
    """Write the index of ``vehicles`` to ``path``: postings (gram, key) and grams (gram, n, rows)."""
    spark = vehicles.sparkSession
    rows = vehicles.select(key, F.explode(F.array_distinct(F.concat(*[trigrams(F.col(c)) for c in columns]))).alias("gram"))
    write_bucketed(spark, rows.select("gram", key), f"{path}/postings", buckets, "gram")
    total = vehicles.count()
    (attach_bucketed(spark, f"{path}/postings", buckets, "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
     .withColumn("rows", F.lit(total)).sortWithinPartitions("gram").write.parquet(f"{path}/grams"))
    return path


class TextIndex:
    """A written index, for the table that it was built from."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, key: str = "vin"):
        self.spark, self.key = spark, key
        self.postings = attach_bucketed(spark, f"{path}/postings", buckets, "gram")
        self.grams = spark.read.parquet(f"{path}/grams")

    def rarest(self, text: str) -> list[tuple[str, int]] | None:
        """The pattern's rarest trigrams and how many rows hold them; None: scan; n = 0: no row matches."""
        if NO_ESCAPE in text:
            return None
        # cut and lowered by the engine that lowers the columns
        pieces = F.split(F.lit(text), "[%_]")
        row = self.spark.range(1).select(F.array_distinct(F.flatten(F.transform(pieces, trigrams))).alias("g")).first()
        if not row.g:
            return None
        found = {r.gram: (r.n, r["rows"]) for r in self.grams.where(F.col("gram").isin(row.g)).collect()}
        if len(found) < len(row.g):
            return [(next(g for g in row.g if g not in found), 0)]
        best = sorted(((n, g) for g, (n, _) in found.items()))[:RAREST]
        if best[0][0] > SCAN_SHARE * next(iter(found.values()))[1]:
            return None
        return [(g, n) for n, g in best]

    def candidates(self, grams: list[str]) -> DataFrame:
        """Keys that are in the lists of all ``grams``."""
        lists = self.postings.where(F.col("gram").isin(grams))
        return lists.groupBy(self.key).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(grams)).select(self.key)

    def search(self, vehicles: DataFrame, text: str) -> DataFrame:
        """Rows of ``vehicles`` that match, as ``where(search_predicate(text))`` gives them."""
        if not text:
            return vehicles
        best = self.rarest(text)
        if best is None:
            return vehicles.where(search_predicate(text))
        if best[0][1] == 0:
            return vehicles.where(F.lit(False))
        keys = self.candidates([g for g, _ in best])
        if best[0][1] <= KEYS:
            # the filter reaches the scan: files and row groups without these keys are left out
            some = [r[0] for r in keys.collect()]
            return vehicles.where(F.col(self.key).isin(some) if some else F.lit(False)).where(search_predicate(text))
        return vehicles.join(keys, self.key, "left_semi").where(search_predicate(text))
