"""User-level entry points, one per operation of the original application.

    store = VehicleStore(spark, "/shared/lotline/vehicles")
    table, rejects = ingest(spark, captures, store, as_of="2026-01-01 00:00:00")
    get_vehicles(store.read(), dealer="...", min_price=50000, search="x5", limit=100)
    get_stats(store.read(), runs); get_dealers(store.read()); get_models(store.read())
    get_status(runs, live, platforms, as_of); get_health(runs, live, as_of)

Everything returns DataFrames; nothing is collected.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import display as D
from .operators import runs as R
from .operators import search as S
from .operators.extract import explode_records, parse_payload
from .operators.normalize import normalize_records
from .operators.platforms import PLATFORMS
from .operators.upsert import conform, merge, upsert_into
from .session import work_dir
from .sources.schemas import ITEM_COLUMNS, VEHICLES
from .sources.buckets import BucketTable


class VehicleStore(BucketTable):
    """Versioned vehicle table at ``root``, in buckets by VIN: an upsert reads and
    writes the buckets of its own VINs, and a write never disturbs a running
    reader.  The last ``keep`` versions stay."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, keep: int = 3):
        super().__init__(spark, root, VEHICLES, "vin", buckets, keep)

    def _name(self, stamp: str | None = None) -> str:
        return f"v={stamp or _dt.datetime.now(_dt.timezone.utc).strftime('%Y%m%dT%H%M%S%f')}-b{self.buckets}"

    def write(self, table: DataFrame, stamp: str | None = None) -> str:
        """``table`` in place of all that is there; the name of the new version."""
        return self.replace(conform(table), version=self.next(self._name(stamp))).name

    def upsert(self, items: DataFrame, as_of, seq: list[str] | None = None, identity: str = "title",
               stamp: str | None = None) -> DataFrame:
        """Merge items by VIN; returns those that were turned down."""
        return upsert_into(self, items, as_of, seq, identity, name=self._name(stamp))


ARRIVAL = ["captured_at", "dealer", "page_no", "pos"]


def ingest(spark: SparkSession, captures: DataFrame, store: VehicleStore, as_of,
           platforms: list[str] | None = None, identity: str = "title",
           write: bool = True) -> tuple[DataFrame, DataFrame]:
    """Captured pages -> normalised items -> VIN merge into the store.

    Within one ingest the arrival order is (captured_at, dealer, page, position),
    so the last sighting of a VIN wins deterministically.  ``platforms``
    restricts to those configured platforms (default: all specs).  Returns
    (new table, rejects): each reject has its vin (if any), the reason or the
    violated columns, and where it was seen (captured_at, dealer, page_no, pos)."""
    specs = [PLATFORMS[p] for p in (platforms or list(PLATFORMS))]
    keep = ("dealer", "page_no", "source_url", "captured_at")
    parts = []
    for spec in specs:
        caps = captures.where(F.col("platform") == spec.name)
        recs = normalize_records(spec, explode_records(spec, parse_payload(caps), keep))
        parts.append(recs)
    allrec = parts[0]
    for p in parts[1:]:
        allrec = allrec.unionByName(p)
    # Reliable checkpoints (shared checkpoint folder): the records feed both the
    # merge and the rejects, and the joined rows both results, without being
    # worked out twice, and a lost executor starts from them again.
    work_dir(spark)
    allrec = allrec.checkpoint(eager=True)
    good = allrec.where(F.col("reject_reason").isNull()).select(*ITEM_COLUMNS, *[c for c in ARRIVAL if c not in ITEM_COLUMNS])
    if write:
        merge_rejects = store.upsert(good, as_of, seq=ARRIVAL, identity=identity)
        table = store.read()
    else:
        table, merge_rejects = merge(store.read(), good, as_of, seq=ARRIVAL, identity=identity,
                                     cut=lambda df: df.checkpoint(eager=True))
    rejects = (allrec.where(F.col("reject_reason").isNotNull())
               .select("vin", F.col("reject_reason").alias("reason"), *ARRIVAL)
               .unionByName(merge_rejects.select("vin", F.array_join("violations", ",").alias("reason"),
                                                 *[F.col(f"_seq.{c}") for c in ARRIVAL])))
    return table, rejects


def get_vehicles(vehicles: DataFrame, dealer=None, model=None, min_price=None, max_price=None, search=None,
                 limit: int | None = 100, iso_timestamps: bool = False) -> DataFrame:
    """Listing as the API returns it; ``iso_timestamps`` renders scraped_at
    as ISO-8601 text (fraction only when non-zero)."""
    out = S.search_vehicles(vehicles, dealer=dealer, model=model, min_price=min_price, max_price=max_price,
                            search=search, limit=limit)
    if iso_timestamps:
        out = out.withColumn("scraped_at", D.iso(F.col("scraped_at")))
    return out


def load_dealers(spark: SparkSession, registry_csv: str, platform_map: DataFrame) -> DataFrame:
    """Dealer registry CSV (Dealer, City, Website, Phone) joined to a platform
    map table (name, platform, inventory_url), with the ``supported`` flag."""
    from .operators.dealers import dealer_config
    from .sources.tables import read_dealers_csv
    return dealer_config(read_dealers_csv(spark, registry_csv), platform_map)


def get_vehicles_envelope(vehicles: DataFrame, limit: int = 100, **filters) -> DataFrame:
    return S.envelope(S.search_vehicles(vehicles, limit=limit, **filters), limit)


def get_stats(vehicles: DataFrame, runs: DataFrame) -> DataFrame:
    return S.stats_with_last_run(vehicles, runs)


def get_dealers(vehicles: DataFrame) -> DataFrame:
    return S.dealers_distinct(vehicles)


def get_models(vehicles: DataFrame) -> DataFrame:
    return S.models_union(vehicles)


def get_status(runs: DataFrame, live: DataFrame, platforms: DataFrame, as_of) -> DataFrame:
    """Latest run per platform after repairing dead runs; 'idle' without runs."""
    return R.status_report(R.recover(runs, live, as_of, scope="latest"), platforms)


def get_health(runs: DataFrame, live: DataFrame, as_of) -> DataFrame:
    return R.health_report(runs, live, as_of)


def listing_report(vehicles: DataFrame) -> DataFrame:
    """The listing table as displayed (see ``display.report_columns``)."""
    return vehicles.select(*D.report_columns())


def export_report(vehicles: DataFrame, path: str) -> str:
    """Write the listing report as CSV files (header, UTF-8), one per task."""
    listing_report(vehicles).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def register_views(spark: SparkSession, vehicles: DataFrame, runs: DataFrame | None = None) -> None:
    """Expose the tables to Spark SQL under their original names, so ad-hoc
    SQL such as ``SELECT dealer, count(*) FROM vehicles GROUP BY dealer`` or
    ``SELECT * FROM scrape_runs ORDER BY started_at DESC LIMIT 10`` runs as is."""
    vehicles.createOrReplaceTempView("vehicles")
    if runs is not None:
        runs.createOrReplaceTempView("scrape_runs")
