"""Readers for the input parquet tables (explicit paths, no inference beyond parquet footers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_dealers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Dealer registry CSV (header, UTF-8, explicit schema) with file order kept.

    ``ord`` = (file, split start, row within split): sorting by it gives the
    order of the rows in the files, however the splits were spread over
    tasks, so "first N dealers" means the first N lines of the registry."""
    from pyspark.sql import functions as F
    from .schemas import DEALERS_CSV
    df = (spark.read.schema(DEALERS_CSV).option("header", True).option("encoding", "UTF-8")
          .option("mode", "PERMISSIVE").csv(path))
    return df.select(F.col("Dealer").alias("name"), F.col("City").alias("city"),
                     F.col("Website").alias("website"), F.col("Phone").alias("phone"),
                     F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"),
                              F.monotonically_increasing_id().alias("row")).alias("ord"))
