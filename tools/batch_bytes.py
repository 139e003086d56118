"""What a batch reads and writes: bytes and rows by batch, from Spark's event log.

    python tools/batch_bytes.py [/root/testdata/sf0.1]

A stored table and a stream's table of the vehicles, in 16 buckets, get batches of one
VIN, of ten and of all; then a few fields and all fields are read from the stored
records.  One line each: buckets touched, rows and MB read and written."""

from __future__ import annotations

import glob
import json
import sys
import tempfile
import time

sys.path.insert(0, "/root/repo")
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

AS_OF = "2026-01-01 00:00:00"


def measured(log_dir: str) -> dict[str, dict[str, float]]:
    """Sums of the task metrics of each job group."""
    group: dict[int, str] = {}
    out: dict[str, dict[str, float]] = {}
    for path in glob.glob(f"{log_dir}/**/*", recursive=True):
        for line in open(path, errors="replace") if "local-" in path.rsplit("/", 1)[-1] or "events_" in path else ():
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                name = e.get("Properties", {}).get("spark.jobGroup.id")
                group.update({s: name for s in e["Stage IDs"] if name})
            elif e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in group and e.get("Task Metrics"):
                m, sums = e["Task Metrics"], out.setdefault(group[e["Stage ID"]], {})
                for kind, key in (("Input Metrics", "Read"), ("Output Metrics", "Written")):
                    for what in ("Bytes", "Records"):
                        name = f"{what} {key}"
                        sums[name] = sums.get(name, 0) + m[kind][name]
    return out


def main(sf: str) -> None:
    logs, work = tempfile.mkdtemp(prefix="lotline-events-"), tempfile.mkdtemp(prefix="lotline-bytes-")
    (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
     .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{logs}").config("spark.eventLog.compress", "false")
     .config("spark.hadoop.parquet.hadoop.vectored.io.enabled", "false")        # else its reads are not counted
     .config("spark.eventLog.rolling.enabled", "false").config("spark.sql.shuffle.partitions", "16").getOrCreate())
    from lotline.operators.platforms import DEALERCOM
    from lotline.operators.normalize import normalize_records
    from lotline.operators.upsert import upsert_into
    from lotline.plans import inputs
    from lotline.session import get_spark
    from lotline.sources.buckets import BucketTable
    from lotline.sources.schemas import VEHICLES
    from lotline.streaming.upsert_stream import open_stream_table
    spark = get_spark()
    v = inputs.vehicles(spark, sf)
    all_items = v.select("vin", "dealer", "dealer_platform", "source_url", "title", "price", "odometer").withColumn("seq", F.lit(1))
    table = BucketTable(spark, f"{work}/table", VEHICLES, buckets=16)
    table.replace(v)
    stream = open_stream_table(spark, f"{work}/stream", all_items.schema, v.withColumn("_seq", F.lit(None).cast("struct<seq:int>")),
                               AS_OF, ["seq"])
    lines = []
    vins = [r.vin for r in v.orderBy("vin").limit(10).collect()]
    for n, (label, keys) in enumerate((("1 VIN", vins[:1]), ("10 VINs", vins), ("all VINs", None))):
        spark.sparkContext.setJobGroup("preparation", "")
        path = f"{work}/items-{n}"
        (all_items if keys is None else all_items.where(F.col("vin").isin(keys))).write.parquet(path)
        items = spark.read.parquet(path)
        touched = len(table.touched(items))
        for kind, run in (("stored table", lambda: upsert_into(table, items, AS_OF, seq=["seq"])),
                          ("stream", lambda: stream.upsert_batch(items, n, AS_OF, ["seq"], "title", 16))):
            name = f"{kind}, {label}"
            spark.sparkContext.setJobGroup(name, name)
            run()
            lines.append((name, touched))
    spark.sparkContext.setJobGroup("preparation", "")
    recs = inputs.records(spark, sf).where("platform = 'dealercom'")
    for name, fields in (("records, price", ("price",)), ("records, all fields", None)):
        spark.sparkContext.setJobGroup(name, name)
        normalize_records(DEALERCOM, recs, fields).write.format("noop").mode("overwrite").save()
        lines.append((name, 0))
    spark.stop()
    time.sleep(1)
    found = measured(logs)
    for name, touched in lines:
        m = found.get(name, {})
        print(f"{name}: {touched} buckets; read {m.get('Records Read', 0):.0f} rows, {m.get('Bytes Read', 0) / 1e6:.2f} MB; "
              f"wrote {m.get('Records Written', 0):.0f} rows, {m.get('Bytes Written', 0) / 1e6:.2f} MB", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
