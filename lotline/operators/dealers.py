"""Dealer registry operators: platform lookup, support split, first-N, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Platforms with a normaliser.
SUPPORTED_PLATFORMS = ("roadster", "dealercom")
# Config platform name -> stored platform label.
PLATFORM_LABELS = {"dealercom": "Dealer.com", "roadster": "Roadster"}


def dealer_config(dealers: DataFrame, platform_map: DataFrame) -> DataFrame:
    """Registry left-joined to the platform map on dealer name.

    No broadcast hint: the map grows with the registry, so the planner picks
    the join from measured sizes (adaptive broadcast under the threshold,
    shuffled hash/sort-merge join above it)."""
    pm = platform_map.select("name", "platform", "inventory_url")
    out = dealers.join(pm, "name", "left")
    return out.withColumn("supported", is_supported())


def is_supported() -> Column:
    return F.coalesce(F.col("platform").isin(*SUPPORTED_PLATFORMS) & F.col("inventory_url").isNotNull(),
                      F.lit(False))


def supported(config: DataFrame) -> DataFrame:
    return config.where(is_supported())


def unsupported(config: DataFrame) -> DataFrame:
    return config.where(~is_supported())


def first_n(dealers: DataFrame, n: int | None = 5) -> DataFrame:
    """First ``n`` dealers in registry order; 0 or None means all."""
    ordered = dealers.orderBy("ord")
    return ordered.limit(n) if n else ordered


def by_name(dealers: DataFrame, name: str) -> DataFrame:
    return dealers.where(F.col("name") == F.lit(name))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when ``df`` is empty (one-row probe, not a full count)."""
    if not df.take(1):
        raise LookupError(f"no rows for {what}")
    return df


def support_counts(config: DataFrame) -> DataFrame:
    return config.agg(F.count_if(is_supported()).alias("supported"),
                      F.count_if(~is_supported()).alias("unsupported"),
                      F.count(F.lit(1)).alias("total"))


def platform_counts(config: DataFrame) -> DataFrame:
    return config.agg(F.count(F.lit(1)).alias("total_dealers"),
                      F.count_if(F.col("platform") == "roadster").alias("roadster_count"),
                      F.count_if(F.col("platform") == "dealercom").alias("dealercom_count"))
