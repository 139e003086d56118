"""Filter interaction audit: what each filter removes in every order of the filters.

Five conditions under which a document fails (``FILTERS``), one bit each:

A  fewer than 200 words          B  under half of its words are distinct
C  over 3 % of its code points are A-Z
D  a character of ``#$%&*|``     E  the text also stands under a smaller doc_id

Spark works out a document's mask of failures, and adds up, per part and mask,
documents, good ones and toxic ones: at most 32 rows a part whatever its size.
A part's rows become a decision diagram whose edges carry those counts, one
level a filter.  The filters' orders follow one another by swaps of adjacent
levels, and the path on which everything passes, in each order, says what every
step keeps and removes.

Defined cases: a null text is empty; a null lang is the part ``''``; a row
without an id has no labels, never fails E and makes no other row fail it;
repeated rows count once each, and do not fail E because of each other; several
labels of one id count as 1 if one of them is 1; without documents there are no
rows.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
          "unique_fails long, good_lost long, toxic_lost long, shapley long")

Weight = tuple[int, int, int]       # documents, good ones, toxic ones


def _mask(text: Column, words: Column) -> Column:
    """Failures of A to D by a document's text and words, as bits 1, 2, 4, 8."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [F.size(words) < 200,
             F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(50).cast("long"),
             capitals * F.lit(100).cast("long") > F.length(text) * F.lit(3).cast("long"),
             text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): documents of equal id, part and text together, with all five bits."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"))
    words = text.withColumn("words", F.filter(F.split("text", "[\\x09-\\x0D ]+"), lambda w: w != ""))
    # what is shuffled is a digest of the text, not the text
    rows = common.written(
        words.select("doc_id", "part", _mask(F.col("text"), F.col("words")).alias("mask"),
                     F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
        .groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "masks")
    # the key of this join is a digest with an id: a text of many copies is many keys
    first = (rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("first", F.lit(True)))
    named = rows.where("doc_id is not null").join(first, ["digest", "doc_id"], "left").withColumn(
        "mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(16))
    return named.select("doc_id", "part", "mask", "n").unionByName(
        rows.where("doc_id is null").select("doc_id", "part", "mask", "n"))


def tally(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, those of quality 1 and those of toxic 1."""
    lab = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic")))
    rows = masks(docs)
    joined = rows.where("doc_id is not null").join(lab, "doc_id", "left").unionByName(
        rows.where("doc_id is null"), allowMissingColumns=True)
    return joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"))


class Node:
    """``low``: the filter of this level passes, ``high``: it fails.  A leaf has neither."""
    __slots__ = ("high", "low", "weight")

    def __init__(self, low: Node | None, high: Node | None, weight: Weight):
        self.low, self.high, self.weight = low, high, weight


class Diagram:
    """Counts by mask as a decision diagram: equal parts of a level are one node,
    and a node's weight is the sum over all masks below it."""

    def __init__(self, names: str, counts: dict[int, Weight]):
        self.order = list(names)
        leaves: dict[Weight, Node] = {}
        row = [leaves.setdefault(w, Node(None, None, w))
               for w in (counts.get(m, (0, 0, 0)) for m in range(1 << len(names)))]
        # bit i belongs to level i, so the levels are put together from the last bit upwards
        for _ in names:
            half, level = len(row) // 2, {}
            row = [self._node(level, low, high) for low, high in zip(row[:half], row[half:])]
        self.root = row[0]

    @staticmethod
    def _node(level: dict, low: Node, high: Node) -> Node:
        key = id(low), id(high)
        if key not in level:
            level[key] = Node(low, high, tuple(a + b for a, b in zip(low.weight, high.weight)))
        return level[key]

    def level(self, k: int) -> list[Node]:
        nodes = {id(self.root): self.root}
        for _ in range(k):
            nodes = {id(c): c for n in nodes.values() for c in (n.low, n.high)}
        return list(nodes.values())

    def swap(self, k: int) -> None:
        """Exchange the filters of levels k and k + 1.  Nodes of level k stay what
        they are (their functions do not change); those below are made anew."""
        below: dict = {}
        for n in self.level(k):
            a, b, c, d = n.low.low, n.low.high, n.high.low, n.high.high
            n.low, n.high = self._node(below, a, c), self._node(below, b, d)
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> Iterator[tuple[str, Weight, Weight]]:
        """Along the path on which all pass: (filter, weight kept, weight removed)."""
        node = self.root
        for name in self.order:
            yield name, node.low.weight, node.high.weight
            node = node.low


def plain_changes(n: int) -> Iterator[int]:
    """Positions k of swaps (k, k + 1) that lead through all orders of n things:
    the last thing walks from end to end, and between two walks the others change once."""
    if n < 2:
        return
    left = True
    for k in [*plain_changes(n - 1), None]:
        yield from range(n - 2, -1, -1) if left else range(n - 1)
        if k is not None:
            yield k + 1 if left else k
        left = not left


def audit_part(counts: dict[int, Weight], names: str = FILTERS) -> list[tuple]:
    """Rows (filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    diagram = Diagram(names, counts)
    paths = {"".join(diagram.order): list(diagram.steps())}
    for k in plain_changes(len(names)):
        diagram.swap(k)
        paths["".join(diagram.order)] = list(diagram.steps())
    fails, alone, shapley = {}, {}, dict.fromkeys(names, 0)
    for path in paths.values():
        fails[path[0][0]] = path[0][2][0]       # first of all: everything that fails it
        alone[path[-1][0]] = path[-1][2][0]     # last of all: what fails nothing else
        for f, _, gone in path:
            shapley[f] += gone[0]
    return [(order, step, kept[0], gone[0], fails[f] - gone[0], alone[f], gone[1], gone[2], shapley[f])
            for order, path in sorted(paths.items()) for step, (f, kept, gone) in enumerate(path, 1)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step (``SCHEMA``); the counts are
    of documents within the part: kept after the step, removed by it, failing its
    filter but removed before (redundant), failing nothing else (unique_fails),
    removed by it with quality or toxic 1, and removed by its filter over all orders."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in
                  zip(rows["mask"], rows["n"], rows["good"], rows["toxic"])}
        out = pd.DataFrame(audit_part(counts), columns=[c.split()[0] for c in SCHEMA.split(", ")[1:]])
        out.insert(0, "part", key[0])
        return out
    common.ship(docs.sparkSession)
    return tally(docs, labels).groupBy("part").applyInPandas(run, SCHEMA)
