"""Statistics by bucket: refreshed from the touched buckets, merged on read; and the split log."""

import pytest

from lotline.operators import eventlog as L
from lotline.sources.bucket_stats import BucketStats
from lotline.sources.buckets import BucketTable


def test_refresh_reads_touched_buckets(spark, tmp_path, monkeypatch):
    def frame(rows):
        return spark.createDataFrame(rows, "vin string, dealer string, model string")
    t = BucketTable(spark, str(tmp_path / "t"), frame([]).schema, buckets=8)
    stats = BucketStats(t)
    assert stats.refresh() == []
    with pytest.raises(LookupError):
        stats.read()
    t.replace(frame([(f"V{i}", f"D{i % 9}", f"M{i % 4}") for i in range(300)]))
    assert stats.refresh() == list(range(8)) and tuple(stats.read().first()) == (300, 9, 4)
    assert stats.refresh() == []
    new = frame([("V5", "D new", "M0"), ("N1", None, None)])
    touched = t.touched(new)
    merged = t.read(touched).where("vin <> 'V5'").unionByName(new)
    t.replace(merged, touched)
    read = []
    whole = BucketTable.read
    monkeypatch.setattr(BucketTable, "read", lambda self, buckets=None, version=None: read.append(buckets) or whole(self, buckets, version))
    assert stats.refresh() == touched and read == [touched]
    assert tuple(stats.read().first()) == (301, 10, 4)
    # a bucket that is emptied leaves the statistics
    gone = t.touched(frame([("V7", "", "")]))
    n = whole(t, gone).count()
    t.replace(frame([]), gone)
    assert stats.refresh() == [] and stats.read().first().total_vehicles == 301 - n


def test_log_is_split_in_one_pass(spark, tmp_path):
    good, bad = ['{"uuid": 1}', "[1, 2]", "3", '"x"', "null"], ['{"uuid": ', "", "not json", '{"a" 1}']
    (tmp_path / "log.txt").write_text("\n".join([*good, *bad]) + "\n")
    seen = L.write_parsed(spark.read.text(str(tmp_path / "log.txt")), str(tmp_path / "out"))
    assert seen == {"lines": 9, "rejected": 4}
    out = spark.read.parquet(str(tmp_path / "out"))
    rejected = out.where("kind = 'rejected'").collect()
    assert sorted(r.line for r in rejected) == sorted(bad)
    assert all(r.file.endswith("log.txt") and r.block_start == 0 and r.doc is None for r in rejected)
    kept = L.parse_lines(spark.read.text(str(tmp_path / "log.txt"))).count()
    assert out.where("kind = 'document'").count() == kept == len(good)
