"""Connected components of a link table, as repeated joins and minima.

Alternates two steps until nothing changes: every vertex links its larger
neighbours to its smallest one, then its smaller neighbours (and itself) to
the smallest.  Minima are aggregated before they are shuffled, and the joins
that follow can be split, so a hub with many links is no single task's work.
Each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _step(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b, distinct."""
    if large:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b) between longs: (id, component), for every linked id, the
    component being its smallest id.  Null ends and self-links count for
    nothing; repeated links and either direction are the same."""
    cur = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "links")
    mark = None
    while True:
        # the large step may leave equal counts, so compare a checksum too
        cur = written(_step(_step(cur, True), False), "links")
        now = cur.agg(F.count("*"), F.sum(F.hash("a", "b")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
