"""Chat logs: keep the longest snapshot of each conversation, then render it.

Logs that are written after every turn hold each conversation many times, each
time with a turn more.  Turns are numbered, and every prefix of a conversation
gets a rolling hash, in two levels (within blocks of turns and over blocks), so
no task needs a whole conversation for it.  A conversation whose full hash is
the hash of a proper prefix of another is dropped by an anti-join; of equal ones
the smallest id stays.  Only those that stay are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

BLOCK = 1024
OPEN, CLOSE, END = "<|", "|>\n", "\n<|end|>\n"


def _turns(logs: DataFrame) -> DataFrame:
    """(conv_id, block, pos, role, text, p1, p2): pos counts from 1; p1 and p2 are
    the hash of the prefix that ends here."""
    t = logs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    t = t.withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = t.groupBy("conv_id", "block").agg(F.count("*").alias("k"))
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    t = t.join(sizes, ["conv_id", "block"]).withColumn("pos", F.col("offset") + F.row_number().over(inside))
    t = t.withColumn("x1", F.xxhash64("pos", "role", "text")).withColumn("x2", F.xxhash64("text", "pos", "role", F.lit(2)))
    t = written(t.select("conv_id", "block", "pos", "role", "text", "x1", "x2"), "turns")
    blocks = t.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    upto = W.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    roll = [F.bit_xor(f"x{i}").over(upto).bitwiseXOR(F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2)]
    return t.join(blocks, ["conv_id", "block"]).select("conv_id", "pos", "role", "text", "x1", "x2", *roll)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def collapse(logs: DataFrame) -> DataFrame:
    """Maximal conversations of logs (conv_id, turn, role, text), rendered.

    Returns conv_id, n_turns, copies (equal conversations, itself included) and
    text.  Turns are ordered by (turn, role, text), a null turn first; equal rows
    of a conversation count once; null roles and texts are empty.  Rows without a
    conv_id belong to none.  Other columns are not looked at."""
    turns = _turns(logs)
    whole = turns.groupBy("conv_id").agg(F.max("pos").alias("n_turns"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    whole = whole.groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    held = turns.groupBy("pos", "p1", "p2").agg(F.count("*").alias("held")).where("held > 1")
    a, b = whole.alias("a"), held.alias("b")
    # a prefix that more conversations have than end there is a proper prefix of some
    maximal = a.join(b, (F.col("a.n_turns") == F.col("b.pos")) & (F.col("a.p1") == F.col("b.p1"))
                     & (F.col("a.p2") == F.col("b.p2")) & (F.col("b.held") > F.col("a.copies")), "left_anti")
    maximal = maximal.select("conv_id", "n_turns", "copies")
    text = turns.select("conv_id", "pos", rendered(F.col("role"), F.col("text")).alias("t")).join(maximal, "conv_id")
    lists = text.groupBy("conv_id", "n_turns", "copies").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("x"))
    return lists.select("conv_id", "n_turns", "copies", F.concat_ws("", F.col("x.t")).alias("text"))
