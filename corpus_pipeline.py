"""Corpus pipeline: from the documents table to tokens.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read back as the next
one's ``docs``.  All but the last return the columns of documents:

1. toxicity          documents scored 0.7 or more go
2. line dedup        later repeats of three lines or more, or of 50 words or more in
                     fewer lines, go; n_chars is counted anew
3. near-dedup        of each group of documents that share 80 of 100 shingles the
                     smallest doc_id stays
4. decontamination   documents that hold 80 of 100 shingles of a benchmark item go
5. BPE               token count and hashes of ids and decoded text

Rows without an id are kept by every filter that needs no id; of rows with
equal id and text one stays in stage 3, the least by its other columns.  Empty tables give empty results.
``ORACLE_SQL`` is None: SQL does not express the training of stage 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm import bpe, common, decontaminate, linededup, neardup, queries, toxicity

ORACLE_SQL = None

REPEATED_WORDS = 50     # a repeat of fewer than three lines goes from so many words on
NEAR_PERCENT = 80
NEAR_MATCHES = 35       # of 64; a pair of just that similarity has fewer with a probability of 1.2e-6


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.settle(spark)
    model = toxicity.train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                           common.table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.settle(spark)
    out = linededup.remove_repeated_lines(docs, words=REPEATED_WORDS).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.settle(spark)
    rows = common.written(neardup.near_duplicates(docs, percent=NEAR_PERCENT, matches=NEAR_MATCHES)
                          .where("n_shingles > 0 and doc_id is not null").select("rid", "doc_id", "group_id"), "near")
    first = rows.groupBy("group_id").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.count("*").alias("k"))
    # written first, so that the join reads plain shuffles, which can be split
    first = common.written(first.where("k > 1").select("group_id", F.col("first.rid").alias("first")), "first")
    gone = common.written(rows.join(first, "group_id").where("rid <> first").select("rid").distinct(), "gone")
    row, = common.free(docs, "rid")
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    out = common.join_counted(docs.withColumn(row, key), gone.withColumnRenamed("rid", row), row, "left_anti")
    if rows.groupBy("rid").count().where("count > 1").limit(1).count():
        again = rows.groupBy("rid").count().where("count > 1").select(F.col("rid").alias(row))
        # of rows equal in id and text the least by the other columns, so a run is like the next
        others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"})
        one = (out.join(again, row, "left_semi").groupBy(row).agg(F.min_by(F.struct(*docs.columns), others).alias("one"))
               .select(row, *[F.col("one")[c].alias(c) for c in docs.columns]))
        out = out.join(again, row, "left_anti").unionByName(one)
    return out.select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.settle(spark)
    row, = common.free(docs, "rid")
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    pairs = decontaminate.contaminated(keyed.select(F.col(row).alias("doc_id"), "text"),
                                       common.table(spark, sf_dir, "benchmark"))
    gone = common.written(pairs.select(F.col("doc_id").alias(row)).distinct(), "leaks")
    return common.join_counted(keyed, gone, row, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.settle(spark)
    return bpe.encode(docs, queries.vocabulary())


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near-dedup", drop_near_duplicates),
          ("decontamination", drop_benchmark), ("BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, one after the other."""
    common.settle(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
