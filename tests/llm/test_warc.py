import gzip
import hashlib

import pytest

from lotline.llm import warc
from tests.llm.conftest import SF

ROWS = [(1, "u", None), (2, None, ""), (3, "http://a/é x\r\nWARC-Type: q", "x" * 99), (4, "u", "x" * 99), (5, "u", "y" * 100),
        (6, "u", "y" * 100), (None, "u", "y" * 100), (7, "u", "é\r\n\r\n" * 5000), (6, "u", "y" * 100), (5, "u", "y" * 100),
        (8, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08" * 3), (9, "u", "é\r\n\r\n" * 5000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "d", 0) for r in ROWS], "page_id long, url string, html string, digest string, first int")


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ref = first[b] if i is not None and first.get(b, i) != i else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=repr)


def test_round_trip_at_any_split(spark, pages):
    files = warc.write(pages, file_bytes=200)
    assert files.count() >= 1 and files.agg({"records": "sum"}).first()[0] == len(ROWS)
    for size in (37, 1000, 1 << 20):
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                      for r in warc.read(files, size, payload=True).collect()), key=repr)
        assert got == expected(ROWS)


def test_archives_are_plain_gzip_members(spark, pages):
    for f in warc.write(pages).collect():
        fs, at = warc.filesystem(f.path)
        with fs.open_input_file(at) as s:
            data = gzip.decompress(s.read())
        assert data.count(b"WARC/1.1\r\nWARC-Type: ") == f.records
        assert b"\r\nWARC-Type: q" not in data  # a line end in a URL starts no header


def test_reader_passes_over_what_is_no_member(spark, tmp_path):
    good = [warc.record(i, "u", b"p" * i, "d", None) for i in (1, 2)]
    junk = b"\x1f\x8b\x08 no member" + gzip.compress(b"no header at all") + gzip.compress(b"WARC/1.")
    (tmp_path / "a.warc.gz").write_bytes(junk + good[0] + junk + good[1][:-4] + b"")
    path = str(tmp_path / "a.warc.gz")
    files = spark.createDataFrame([(path, (tmp_path / "a.warc.gz").stat().st_size)], "path string, bytes long")
    assert [r.page_id for r in warc.read(files, 50).collect()] == [1]   # the last member is cut off


def test_empty_tables(spark, pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_whole_table(spark):
    from lotline.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in QUERIES["op7_warc"](spark, SF).collect()), key=repr) == expected(rows)


def test_a_long_header_is_read_back(spark):
    """A URL of megabytes that hardly compresses makes a header longer than any chunk."""
    import random
    rnd = random.Random(6)
    rows = [(1, "http://a/" + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=3_000_000)), "x" * 200), (2, "u", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=repr) == expected(rows)


def test_lost_records_are_an_error(spark, pages, monkeypatch):
    read = warc.read
    monkeypatch.setattr(warc, "read", lambda *a: read(*a).limit(3))
    with pytest.raises(RuntimeError, match="12 records were written and 3 read"):
        warc.round_trip(pages)
