"""Repeated runs of lines, found by winnowing and deleted but for the first.

A line is what stands between line feeds, without white space around it; blank
lines are looked through and stay.  Of every ``run`` lines in a row the one with
the smallest hash (the last one on ties) is a fingerprint, so equal runs have
equal fingerprints at equal places.  Fingerprints that occur at one place only
are done with.  Around the others the match is extended both ways: the runs
that the fingerprint stands for are compared, line by line, and runs that occur
at an earlier place (smaller doc_id, then line) lose their lines.  Longer
repeats are unions of such runs.  If ``words`` is given, shorter runs, down to
one line, that hold as many words together are looked for as well.

DataFrame functions only.  Hot lines are counted before they are shuffled, and
the joins on them can be split.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, written

RUN = 3


def _lines(docs: DataFrame, words: int | None) -> DataFrame:
    """(rid, doc_id, h, at): hashes and places (from 0) of the lines that are not
    blank; with ``words`` also g and w: second hashes and numbers of words."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.trim(F.regexp_replace(x, r"\s+$|^\s+", "")).alias("x"), i.alias("i")))
    full = F.filter(lines, lambda s: s["x"] != "")
    more = [] if words is None else [F.transform("l", lambda s: F.xxhash64(F.lit(1), s["x"])).alias("g"),
                                     F.transform("l", lambda s: F.size(F.split(s["x"], r"\s+"))).alias("w")]
    return docs.select("rid", "doc_id", full.alias("l")).select(
        "rid", "doc_id", F.transform("l", lambda s: F.xxhash64(s["x"])).alias("h"), F.transform("l", lambda s: s["i"]).alias("at"), *more)


def _starts(run: int, words: int | None = None) -> Column:
    """Places in ``h`` where a run starts (one of ``words`` words or more)."""
    starts = F.when(F.size("h") >= run, F.sequence(F.lit(0), F.size("h") - run)).otherwise(F.array().cast("array<int>"))
    if words is None:
        return starts
    return F.filter(starts, lambda i: sum((F.get("w", i + k) for k in range(1, run)), F.get("w", i)) >= words)


def _fingerprint(run: int, i: Column) -> Column:
    """Place of the smallest hash of the run that starts at ``i``, the last on ties."""
    if run == 1:
        return i
    low = F.least(*[F.get("h", i + k) for k in range(run)])
    return F.coalesce(*[F.when(F.get("h", i + k) == low, i + k) for k in reversed(range(run))])


def remove_repeated_lines(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """Documents with the lines of later repeated runs taken out of ``text``: runs
    of ``run`` lines and, if ``words`` is given, of fewer lines that hold
    ``words`` words or more together.

    Returns the columns of ``docs`` (which has doc_id and text) with the new
    text, and n_lines and n_removed.  What is left of a text keeps its line feeds
    between lines.  Null texts stay null, with no lines.  Rows with equal id and
    text are one document.  A null id comes after all others.  Runs may repeat
    within a document; overlapping repeats are judged on the input.  Columns of
    ``docs`` named n_lines or n_removed are replaced."""
    rid = F.xxhash64("doc_id", "text")
    keyed = docs.drop("n_lines", "n_removed")
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").withColumn("rid", rid)
    sizes = [(run, None)] + [(k, words) for k in range(1, run) if words is not None]      # (lines, least words) of runs
    some = F.size("h") >= run
    for k, least in sizes[1:]:
        some |= F.size(_starts(k, least)) > 0
    lines = written(_lines(rows, words).where(some).dropDuplicates(["rid"]), "lines")

    # Arrays are cut into structs before they are exploded: a long document's
    # arrays would else be copied for each of its lines.
    places = F.array_distinct(F.concat(*[F.transform(_starts(k, least), partial(_fingerprint, k)) for k, least in sizes]))
    prints = lines.select(F.explode(F.transform(places, lambda p: F.get("h", p))).alias("key"))
    # written first, so that the joins below read plain shuffles, which can be split
    shared = written(prints.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "shared")

    # runs of fewer lines are told apart by their length and a second hash
    keys = [f"h{k}" for k in range(run)] + ["size"] * (words is not None)

    def one(size: int):
        hashes = lambda i: [F.get("h", i + k) for k in range(size)] + [F.get("g", i)] * (size < run)
        padded = lambda i: hashes(i) + [F.lit(0).cast("long")] * (run - size - 1) + [F.lit(size)] * (words is not None)
        return lambda i: F.struct(i.alias("i"), F.get("h", _fingerprint(size, i)).alias("key"),
                                  *[x.alias(n) for x, n in zip(padded(i), keys)],
                                  F.slice("at", i + 1, F.lit(size)).alias("gone"))

    runs = lines.select("doc_id", "rid", F.inline(F.concat(*[F.transform(_starts(k, least), one(k)) for k, least in sizes])))
    runs = written(runs.join(shared, "key", "left_semi").drop("key"), "runs")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "i")
    first = runs.groupBy(*keys).agg(F.min(place).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    first = written(first.select(*keys, "first.rid", "first.i").toDF(*keys, "first_rid", "first_i"), "first")
    later = runs.join(first, keys).where("rid <> first_rid or i <> first_i")
    gone = later.select("rid", F.explode("gone").alias("g")).groupBy("rid").agg(F.collect_set("g").alias("gone"))

    row, cut, text_lines = free(keyed, "rid", "gone", "lines")
    out = keyed.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), "text")).join(
        gone.select(F.col("rid").alias(row), F.col("gone").alias(cut)), row, "left")
    split = F.split("text", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(text_lines) - 1), F.col(cut))
    out = out.withColumn(text_lines, split)
    kept = F.transform(places, lambda i: F.get(text_lines, i))
    out = out.withColumn("n_lines", F.coalesce(F.when(F.col("text").isNotNull(), F.size(text_lines)), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.coalesce(F.when(F.col(cut).isNotNull(), F.size(cut)), F.lit(0)).cast("long"))
    out = out.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.select(*keyed.columns, "n_lines", "n_removed")
