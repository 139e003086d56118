"""Session-level access to the derived inputs, with the vehicle table written once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived
from ..operators.upsert import latest_vehicles
from ..session import at_most
from ..sources.store import build_once, list_files, materialize, materialize_partitioned

SEQ = ["scraped_at", "l_orderkey", "l_linenumber"]
# Salt for the written-table keys; a benchmark sets a fresh one to time the builds.
SALT = ""


def _code_version() -> str:
    """Hash of the package sources: written tables are rebuilt whenever the
    code that derives them changes."""
    import pathlib
    root = pathlib.Path(__file__).resolve().parent.parent
    h = hashlib.sha1()
    for f in sorted(root.rglob("*.py")):
        h.update(f.read_bytes())
    return h.hexdigest()[:12]


VERSION = _code_version()


# Of tables of a hundred columns and more: Parquet otherwise keeps counts of the levels of each value, a third of the writer's time.
WIDE_ROWS = {"parquet.size.statistics.enabled": "false"}

# Tables the written inputs are derived from.
SOURCES = ("nation", "supplier", "part", "lineitem", "events")


def key(spark: SparkSession, sf_dir: str) -> str:
    """Key of the written tables: the files they are derived from (name, length,
    modification time), the code that derives them, and the salt.  A replaced
    input file gives new written tables, never an answer from old ones."""
    base = sf_dir.rstrip("/")
    files = [x for t in SOURCES for x in list_files(spark, f"{base}/{t}.parquet")]
    return hashlib.sha1(f"{base}|{files}|{VERSION}|{SALT}".encode()).hexdigest()[:16]


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicle table (last sighting per VIN), written once to the shared
    work folder and read back as a plain parquet scan, so filters reach the
    scan (PushedFilters) instead of stopping at the per-VIN aggregate.  Rows
    are range-partitioned and sorted on (dealer, price), so each file covers a
    narrow dealer range and file / row-group statistics skip data for dealer
    and price predicates; a dealer with many vehicles is split across files
    by price rather than landing in one."""
    def build() -> DataFrame:
        v = latest_vehicles(derived.obs(spark, sf_dir), SEQ)
        return v.repartitionByRange("dealer", "price").sortWithinPartitions("dealer", "price")
    return materialize(spark, "vehicles", build, key(spark, sf_dir))


def vehicles_unwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_vehicles(derived.obs(spark, sf_dir), SEQ)


def dealer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each dealer, written once: the sightings are joined to part and supplier
    once for the counts, and once for the pages."""
    from ..sources.captures import page_counts

    return materialize(spark, "dealer_pages", lambda: page_counts(derived.obs(spark, sf_dir)), key(spark, sf_dir))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture table written once, partitioned by platform so a platform's
    normaliser scans only its own pages (partition pruning)."""
    from ..sources.captures import DEALING, build_captures

    def build() -> DataFrame:
        return build_captures(derived.obs(spark, sf_dir), counts=dealer_pages(spark, sf_dir), late=derived.LATE_OBS_COLUMNS)

    with at_most(spark, DEALING):
        return materialize_partitioned(spark, "captures", build, key(spark, sf_dir), ["platform"])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all captured pages, parsed once and stored key by key as shredded
    VARIANT columns, in folders by platform: a query on a few fields reads their keys only."""
    from ..operators.extract import key_column, shredded_records
    from ..operators.normalize import spec_keys
    from ..operators.platforms import PLATFORMS

    def write(path: str) -> None:
        # a platform's folder at a time: one write of all would sort the wide records by platform
        caps = captures(spark, sf_dir)
        columns = list(dict.fromkeys(key_column(k) for spec in PLATFORMS.values() for k in spec_keys(spec)))
        for spec in PLATFORMS.values():
            part = shredded_records(spec, caps, spec_keys(spec))
            part = part.withColumns({c: F.lit(None).cast("variant") for c in columns if c not in part.columns})
            part.write.options(compression="zstd", **WIDE_ROWS).parquet(f"{path}/platform={spec.name}")
    return spark.read.parquet(build_once(spark, "records", key(spark, sf_dir), write))


def split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted items and rejected records, written in one pass, in folders by platform and reason."""
    from ..operators.normalize import split_items as split
    from ..operators.platforms import PLATFORMS
    path = build_once(spark, "split_items", key(spark, sf_dir),
                      lambda path: split(list(PLATFORMS.values()), records(spark, sf_dir), path))
    return spark.read.parquet(path)
