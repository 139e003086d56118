"""Report formats and run-log operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lotline.functions import display as D
from lotline.operators import eventlog as L


def _one(spark, value, ddl, fn):
    return spark.createDataFrame([(value,)], f"x {ddl}").select(fn(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize("ts,want", [
    (dt.datetime(2024, 1, 2, 3, 4, 5), "2024-01-02T03:04:05"),
    (dt.datetime(2024, 1, 2, 3, 4, 5, 120), "2024-01-02T03:04:05.000120"),
])
def test_iso(spark, ts, want):
    assert _one(spark, ts, "timestamp_ntz", D.iso) == want


@pytest.mark.parametrize("p,want", [(42000.5, "$42,001"), (0.0, "-"), (None, "-"), (1234567.0, "$1,234,567")])
def test_price_format(spark, p, want):
    assert _one(spark, p, "double", D.fmt_price) == want


@pytest.mark.parametrize("n,want", [(12345, "12,345"), (0, "-"), (None, "-")])
def test_number_format(spark, n, want):
    assert _one(spark, n, "int", D.fmt_number) == want


@pytest.mark.parametrize("ago,want", [(dt.timedelta(minutes=30), "Just now"), (dt.timedelta(hours=5), "5h ago"),
                                      (dt.timedelta(days=3), "3d ago"), (dt.timedelta(days=30), "12/2/2025")])
def test_age(spark, ago, want):
    now = dt.datetime(2026, 1, 1)
    assert _one(spark, now - ago, "timestamp_ntz", lambda c: D.age_label(c, "2026-01-01 00:00:00")) == want


def test_escape(spark):
    assert _one(spark, "a<b>&c ", "string", D.escape_html) == "a&lt;b&gt;&amp;c&nbsp;"


@pytest.mark.parametrize("ms,want", [(999, "999ms"), (1000, "1.00s"), (1239, "1.23s"), (61005, "61.00s")])
def test_duration(spark, ms, want):
    assert _one(spark, ms, "bigint", L.duration_label) == want


LOG = [
    {"type": "assistant", "message": {"role": "assistant", "content": [
        {"type": "thinking", "thinking": "..."}, {"type": "text", "text": "hello"}, {"type": "tool_use", "name": "x"}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "content": "ok"}]}},
    {"type": "user", "message": {"content": "plain string"}},
    {"type": "system", "subtype": "init"},
    {"type": "result", "subtype": "success", "is_error": False, "result": "# T\n## S\n* a\n```x```\n**b**",
     "duration_ms": 1500, "total_cost_usd": 0.25, "session_id": "abcdefghijk",
     "usage": {"input_tokens": 10}, "modelUsage": {"m1": {"inputTokens": 1, "outputTokens": 2, "costUSD": 0.5}}},
]


@pytest.fixture()
def docs(spark):
    lines = [json.dumps(x) for x in LOG] + ['{"type": "result", "broken']
    return L.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_parse_drops_bad_lines(docs):
    assert docs.count() == len(LOG)


def test_flatten(docs):
    got = sorted(r.line for r in L.flatten_messages(docs).collect())
    assert got == ["[assistant] text: hello", "[assistant] thinking: ", "[user] tool_result: ok"]


def test_map_entries_and_defaults(docs):
    m = L.map_entries(docs).collect()
    assert [(r.model, r.input_tokens, r.output_tokens, r.cost_usd) for r in m] == [("m1", 1, 2, 0.5)]
    f = {r.type: r for r in L.with_defaults(docs).collect()}
    assert f["result"].output_tokens == 0 and f["result"].input_tokens == 10 and f["system"].subtype == "init"
    assert f["assistant"].duration_ms == 0 and f["assistant"].is_error is False


def test_status_and_lines(docs):
    f = L.with_defaults(docs)
    st = {r.type: r.s for r in f.select("type", L.status_label(F.col("is_error"), F.col("subtype"),
                                                                F.col("type")).alias("s")).collect()}
    assert st["result"] == "SUCCESS" and st["system"] == "system"
    lines = [(r.line, r.kind) for r in L.response_lines(f).orderBy("line_no").collect()]
    assert lines == [("  T", "plain"), ("    S", "plain"), ("  • a", "plain"), ("```x```", "code"), ("**b**", "bold")]
