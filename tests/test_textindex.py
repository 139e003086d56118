"""The text index answers as the scan does, and reads the lists of its pattern."""

import random

import pytest

from lotline.operators import search as S
from lotline.operators import textindex as T

SCHEMA = "vin string, title string, dealer string, ext_color string, price double"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rnd = random.Random(4)
    words = ["BMW", "X5", "xDrive40i", "M4", "Competition", "Ünïcode", "İstanbul", "a_b", "100%", "", "Straße", "Σίσυφος", "\\", "red", "Deep Sea"]
    rows = [(f"VIN{i:06d}", " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 6))) if i % 11 else None,
             f"Dealer {i % 7}", rnd.choice(["Red Metallic", "alpine white", None, "x"]), float(i)) for i in range(500)]
    v = spark.createDataFrame(rows, SCHEMA)
    path = T.build(v, str(tmp_path_factory.mktemp("index") / "ix"), 4)
    return v, T.TextIndex(spark, path, 4)


PATTERNS = ["bmw", "x5", "XDRIVE", "drive40i m4", "m4%comp", "a_b", "100%", "%", "_", "", "e", "red", "Metallic", "nïco", "İst", "i̇st", "strasse",
            "Straße", "σίσυ", "Σίσυφος", "VIN000123", "000123", "vin_00012_", "dealer 3", "nothing like it", "\\", "ea%red", "comp%xdrive",
            S.NO_ESCAPE, "red" + S.NO_ESCAPE + "%"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_like_the_scan(data, pattern):
    v, ix = data
    try:
        want = sorted(r.vin for r in S.filter_vehicles(v, search=pattern).collect())
    except Exception:       # an escape character at the end or before a letter is an error of the scan
        with pytest.raises(Exception):
            ix.search(v, pattern).collect()
        return
    assert sorted(r.vin for r in ix.search(v, pattern).collect()) == want


def test_large_lists_are_joined(data, monkeypatch):
    v, ix = data
    monkeypatch.setattr(T, "KEYS", 1)
    monkeypatch.setattr(T, "SCAN_SHARE", 1.0)
    for pattern in ("bmw", "comp%xdrive", "dealer 3"):
        assert sorted(r.vin for r in ix.search(v, pattern).collect()) == sorted(r.vin for r in S.filter_vehicles(v, search=pattern).collect())


def test_what_is_read(spark, data):
    v, ix = data
    assert ix.rarest("x5") is None and ix.rarest("%") is None and ix.rarest("e_l") is None
    assert ix.rarest("vin") is None                         # in every row
    assert ix.rarest("zzz") == [("zzz", 0)]
    best = ix.rarest("vin000123")
    assert len(best) == T.RAREST and best[0][1] <= 2
    plan = ix.candidates([g for g, _ in best])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and "title" not in plan       # lists only, from their buckets
    found = ix.search(v, "vin000123")
    assert "vin" in found._jdf.queryExecution().optimizedPlan().toString()
