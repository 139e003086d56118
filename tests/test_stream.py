"""Streaming upsert equals the batch upsert of the same items."""

import tempfile

from pyspark.sql import functions as F

from lotline.operators.upsert import last_per_key, merge
from lotline.sources.schemas import VEHICLES
from lotline.streaming.upsert_stream import run_stream_upsert

AS_OF = "2026-01-01 00:00:00"


def test_stream_equals_batch(spark):
    rows = [(f"V{i % 7}", "D", "Dealer.com", "https://u", f"2024 BMW X{i % 5} T{i}", float(i), i, i)
            for i in range(60)]
    items = spark.createDataFrame(rows, "vin string, dealer string, dealer_platform string, source_url string, "
                                        "title string, price double, odometer int, seq int")
    src = tempfile.mkdtemp(prefix="lotline-stream-src-")
    items.repartition(6).write.mode("overwrite").parquet(src)
    empty = spark.createDataFrame([], VEHICLES)
    batch, _ = merge(empty, items, AS_OF, seq=["seq"])
    initial = empty.withColumn("_seq", F.lit(None).cast("struct<seq:int>"))
    streamed = run_stream_upsert(spark, src, items.schema, initial, AS_OF, ["seq"], files_per_batch=1,
                                 run_dir=tempfile.mkdtemp(prefix="lotline-stream-run-"))
    key = lambda df: sorted((r.vin, r.price, r.title) for r in df.collect())
    assert key(streamed.read()) == key(batch)
    assert {r.vin: r.price for r in streamed.read().collect()}["V0"] == 56.0


def test_stream_restart_keeps_committed_state(spark):
    rows = [(f"V{i % 3}", "D", "Dealer.com", "https://u", f"2024 BMW X{i % 5} T{i}", float(i), i, i) for i in range(20)]
    items = spark.createDataFrame(rows, "vin string, dealer string, dealer_platform string, source_url string, "
                                        "title string, price double, odometer int, seq int")
    src = tempfile.mkdtemp(prefix="lotline-stream-src-")
    items.repartition(4).write.mode("overwrite").parquet(src)
    empty = spark.createDataFrame([], VEHICLES)
    initial = empty.withColumn("_seq", F.lit(None).cast("struct<seq:int>"))
    run_dir = tempfile.mkdtemp(prefix="lotline-stream-run-")
    first = run_stream_upsert(spark, src, items.schema, initial, AS_OF, ["seq"], files_per_batch=2, run_dir=run_dir)
    want = sorted((r.vin, r.price) for r in first.read().collect())
    again = run_stream_upsert(spark, src, items.schema, initial, AS_OF, ["seq"], files_per_batch=2, run_dir=run_dir)
    assert sorted((r.vin, r.price) for r in again.read().collect()) == want == [("V0", 18.0), ("V1", 19.0), ("V2", 17.0)]


def test_deltas_grow_with_the_batch_and_rejects_stay(spark):
    """A batch writes its own VINs only, next to what it turned down; folding deltas into a base changes nothing."""
    rows = [(f"V{i}", "D", "Dealer.com", "https://u", f"2024 BMW X5 T{i}", float(i), i, i) for i in range(40)]
    schema = "vin string, dealer string, dealer_platform string, source_url string, title string, price double, odometer int, seq int"
    stored, _ = merge(spark.createDataFrame([], VEHICLES), spark.createDataFrame(rows, schema), AS_OF, seq=["seq"], keep_seq=True)
    src = tempfile.mkdtemp(prefix="lotline-stream-src-")
    new = [("V1", "D", "Dealer.com", "https://u", "2025 BMW X3 N", 1.5, 1, 100), ("V2", "D", "Dealer.com", "https://u", None, 2.5, 1, 101),
           ("W", "D", "Dealer.com", "https://u", "2025 BMW X3 N", 3.5, 1, 102)]
    for r in new:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(src)
    results = []
    for every in (16, 2):
        t = run_stream_upsert(spark, src, spark.createDataFrame([], schema).schema, stored, AS_OF, ["seq"], files_per_batch=1,
                              run_dir=tempfile.mkdtemp(prefix="lotline-stream-run-"), compact_every=every)
        results.append(sorted((r.vin, r.price, r.model) for r in t.read().collect()))
        assert [(r.vin, r.violations) for r in t.rejects().collect()] == [("V2", ["title"])]
        if every == 16:
            # one item a batch: one row a delta
            assert [spark.read.parquet(f"{t.run_dir}/delta/batch={b}").count() for b in t.deltas()] == [1, 1, 1]
        else:
            assert t.base() > -1
    assert results[0] == results[1] and len(results[0]) == 41


ITEM = "vin string, dealer string, dealer_platform string, source_url string, title string, price double, odometer int, seq int"


def _table(spark, tmp_path, n=400, keep=2):
    """A stream's table with n stored vehicles in 8 buckets."""
    from lotline.streaming.upsert_stream import open_stream_table
    rows = [(f"V{i}", "D", "Dealer.com", "https://u", f"2024 BMW X5 T{i}", float(i), i, 0) for i in range(n)]
    items = spark.createDataFrame(rows, ITEM)
    stored, _ = merge(spark.createDataFrame([], VEHICLES), items, AS_OF, seq=["seq"], keep_seq=True)
    return open_stream_table(spark, str(tmp_path / "run"), items.schema, stored, AS_OF, ["seq"])


def _upsert(spark, t, rows, batch_id, every=16):
    t.upsert_batch(spark.createDataFrame([(v, "D", "Dealer.com", "https://u", "2025 BMW X3 N", p, 1, s) for v, p, s in rows], ITEM),
                   batch_id, AS_OF, ["seq"], "title", every)


def test_a_batch_reads_and_writes_its_buckets(spark, tmp_path):
    from lotline.sources.store import list_dirs
    t = _table(spark, tmp_path)
    one = spark.createDataFrame([("V5",)], "vin string")
    touched = t.touched(one)
    # the stored side: one bucket's files, by bucket (no shuffle), and as state for the merge
    stored = t.parts(touched)
    assert {f.split("/")[-2] for f in stored.inputFiles()} == {f"_bucket={touched[0]}"}
    plan = last_per_key(stored, "vin", ["_part"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount" in plan
    before = t.latest()
    _upsert(spark, t, [("V5", 1.5, 7)], 0)
    assert list_dirs(spark, f"{t.root}/delta/batch=0") == [f"_bucket={touched[0]}"]
    assert {b for b, p in t.latest().parts.items() if p != before.parts[b]} == set(touched)
    # a rerun of a batch that is there does nothing
    version = t.latest()
    _upsert(spark, t, [("V5", 99.0, 9)], 0)
    assert t.latest() == version and t.read().where("vin = 'V5'").first().price == 1.5


def test_old_generations_are_dropped(spark, tmp_path):
    import glob
    t = _table(spark, tmp_path, keep=1)
    want = {f"V{i}": float(i) for i in range(400)}
    for b in range(5):
        rows = [(f"V{(37 * b + k) % 400}", 1000.0 * b + k, 10 + b) for k in range(3)]
        want.update({v: p for v, p, _ in rows})
        _upsert(spark, t, rows, b, every=2)
        assert {r.vin: r.price for r in t.read().collect()} == want
    # no bucket has more parts than deltas are let stand, and only parts of kept versions are on disk
    assert all(len(p) <= 2 for p in t.latest().parts.values()) and t.done() == 4 and t.base() == 3 and t.deltas() == [4]
    named = {f for n in t._numbers() for f in t.version(n).folders()}
    found = {"/".join(p.split("/")[-3:]) for p in glob.glob(f"{t.root}/*/batch=*/_bucket=*") if "rejects" not in p}
    assert found == named


def test_a_stream_without_files_has_empty_rejects(spark, tmp_path):
    items = spark.createDataFrame([], ITEM)
    (tmp_path / "src").mkdir()
    initial = spark.createDataFrame([], VEHICLES).withColumn("_seq", F.lit(None).cast("struct<seq:int>"))
    t = run_stream_upsert(spark, str(tmp_path / "src"), items.schema, initial, AS_OF, ["seq"], run_dir=str(tmp_path / "run"))
    assert t.read().count() == 0 and t.rejects().count() == 0
    assert t.rejects().columns == ["vin", "violations", "_seq", "batch"]
