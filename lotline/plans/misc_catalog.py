"""Registered URL, report-formatting and run-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import derived, inputs
from .catalog import register
from .oracle_views import register as register_view
from ..functions import display as D
from ..functions import urls as U
from ..operators import eventlog as L
from ..sources.eventlog import log_text

# ---------------------------------------------------------------- URLs
_MODEL = ("CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'iX' WHEN 2 THEN '3 Series' WHEN 3 THEN '' "
          "ELSE 'X5 M' END")
_YEAR = "CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '2025' ELSE '' END"
register_view("url_inputs", [], f"SELECT page_id, url, {_MODEL} AS model, {_YEAR} AS year FROM pages")


def _url_inputs(spark, sf):
    p = spark.read.parquet(f"{sf.rstrip('/')}/pages.parquet")
    return p.select("page_id", "url", F.expr(_MODEL).alias("model"), F.expr(_YEAR).alias("year"))


def _enc(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


_Y = "CASE WHEN coalesce(model, '') <> '' THEN CASE WHEN coalesce(year, '') <> '' THEN year ELSE '2026' END END"
_BEFORE = "regexp_extract(url, '^([^?#]*)', 1)"
_FRAG = "CASE WHEN regexp_extract(url, '#(.*)$', 1) <> '' THEN '#' || regexp_extract(url, '#(.*)$', 1) ELSE '' END"


@register("url_filter_dealercom",
          f"SELECT page_id, {_BEFORE} || '?' || concat_ws('&', CASE WHEN ({_Y}) IS NOT NULL THEN 'year=' || "
          f"{_enc(_Y)} END, CASE WHEN coalesce(model, '') <> '' THEN 'model=' || {_enc('model')} END, 'status=1-1') "
          f"|| {_FRAG} AS filtered_url FROM url_inputs", ("url_inputs",))
def q_url_filter_dealercom(spark, sf):
    x = _url_inputs(spark, sf)
    return x.select("page_id", U.dealercom_filtered_url(F.col("url"), F.col("model"), F.col("year"))
                    .alias("filtered_url"))


@register("url_filter_roadster",
          f"SELECT page_id, CASE WHEN coalesce(model, '') <> '' THEN {_BEFORE} || '?' || concat_ws('&', "
          f"'f=' || {_enc(chr(39) + 'submodel:' + chr(39) + ' || model')}, 'f=' || "
          f"{_enc(chr(39) + 'year:' + chr(39) + ' || (' + _Y + ')')}) || {_FRAG} ELSE url END AS filtered_url "
          f"FROM url_inputs", ("url_inputs",))
def q_url_filter_roadster(spark, sf):
    x = _url_inputs(spark, sf)
    return x.select("page_id", U.roadster_filtered_url(F.col("url"), F.col("model"), F.col("year"))
                    .alias("filtered_url"))


@register("url_domain",
          "SELECT page_id, nullif(regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1), '') AS domain FROM pages")
def q_url_domain(spark, sf):
    p = spark.read.parquet(f"{sf.rstrip('/')}/pages.parquet")
    return p.select("page_id", U.domain(F.col("url")).alias("domain"))


# ---------------------------------------------------------------- report formats
def _iso_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN strftime({c}, '%f') = '000000' THEN "
            f"strftime({c}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END")


@register("iso_timestamps",
          f"SELECT id, {_iso_sql('started_at')} AS started_at, {_iso_sql('completed_at')} AS completed_at FROM runs",
          ("runs",))
def q_iso_timestamps(spark, sf):
    r = derived.runs(spark, sf)
    return r.select("id", D.iso(F.col("started_at")).alias("started_at"),
                    D.iso(F.col("completed_at")).alias("completed_at"))


_PRICE_SQL = ("CASE WHEN price IS NULL OR price = 0 THEN '-' ELSE '$' || format('{:,}', "
              "CAST(round(price) AS BIGINT)) END")
_NUM_SQL = "CASE WHEN odometer IS NULL OR odometer = 0 THEN '-' ELSE format('{:,}', odometer) END"


@register("fmt_price", f"SELECT vin, {_PRICE_SQL} AS price_text FROM vehicles", ("vehicles",))
def q_fmt_price(spark, sf):
    v = inputs.vehicles(spark, sf)
    return v.select("vin", D.fmt_price(F.col("price")).alias("price_text"))


@register("fmt_number", f"SELECT vin, {_NUM_SQL} AS odometer_text FROM vehicles", ("vehicles",))
def q_fmt_number(spark, sf):
    v = inputs.vehicles(spark, sf)
    return v.select("vin", D.fmt_number(F.col("odometer")).alias("odometer_text"))


AGE_AS_OF = "2024-01-08 00:00:00"
_HOURS = f"floor((epoch_us(TIMESTAMP '{AGE_AS_OF}') - epoch_us(started_at)) / 3600000000)"


@register("age_label",
          f"SELECT id, CASE WHEN {_HOURS} < 1 THEN 'Just now' WHEN {_HOURS} < 24 THEN "
          f"CAST(CAST({_HOURS} AS BIGINT) AS VARCHAR) || 'h ago' WHEN floor({_HOURS} / 24) < 7 THEN "
          f"CAST(CAST(floor({_HOURS} / 24) AS BIGINT) AS VARCHAR) || 'd ago' "
          f"ELSE strftime(started_at, '%-m/%-d/%Y') END AS age FROM runs", ("runs",))
def q_age_label(spark, sf):
    r = derived.runs(spark, sf)
    return r.select("id", D.age_label(F.col("started_at"), AGE_AS_OF).alias("age"))


def _esc_sql(c: str) -> str:
    return (f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"chr(160), '&nbsp;')")


def _or(c: str, ph: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN '{ph}' ELSE {c} END"


@register("report_rows",
          f"SELECT vin AS key, {_esc_sql(_or('dealer', ''))} AS dealer, {_esc_sql(_or('title', ''))} AS title, "
          f"CASE WHEN year IS NULL OR year = 0 THEN '-' ELSE CAST(year AS VARCHAR) END AS year, "
          f"{_PRICE_SQL} AS price, {_NUM_SQL} AS miles, {_esc_sql(_or('ext_color', '-'))} AS ext_color, "
          f"{_esc_sql(_or('vin', ''))} AS vin, {_esc_sql(_or('dealer_platform', ''))} AS platform, "
          f"{_esc_sql(_or('source_url', '#'))} AS link FROM vehicles", ("vehicles",))
def q_report_rows(spark, sf):
    v = inputs.vehicles(spark, sf)
    return v.select(F.col("vin").alias("key"), *D.report_columns())


@register("html_escape",
          f"SELECT page_id, {_esc_sql(_or(chr(39) + chr(39) + ' || regexp_extract(html, ' + chr(39) + '<title>([^<]*)</title>' + chr(39) + ', 1)', ''))} "
          f"AS title_html FROM pages")
def q_html_escape(spark, sf):
    p = spark.read.parquet(f"{sf.rstrip('/')}/pages.parquet")
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.select("page_id", D.escape_html(D.or_placeholder(t, "")).alias("title_html"))


# ---------------------------------------------------------------- run log
_K = "(conv_id * 16 + turn)"
register_view("log_msgs", [], (
    f"SELECT conv_id, turn, role, text, {_K} AS k, conv_id || '-' || turn || '-m' AS uuid FROM conversations "
    f"WHERE NOT ({_K} % 13 = 5)"))
register_view("log_results", [], (
    f"SELECT conv_id, turn, text, {_K} AS k, conv_id || '-' || turn || '-r' AS uuid, "
    "CAST(length(text) AS BIGINT) AS n FROM conversations "
    f"WHERE role = 'assistant' AND NOT ({_K} % 13 = 6)"))


def _log(spark, sf):
    return L.parse_lines(log_text(spark, sf, inputs.key(spark, sf)))


@register("log_parse",
          "SELECT uuid, type FROM (SELECT uuid, role AS type FROM log_msgs UNION ALL "
          "SELECT uuid, 'result' FROM log_results)", ("log_msgs", "log_results"))
def q_log_parse(spark, sf):
    d = _log(spark, sf)
    return d.select(F.try_variant_get("doc", "$.uuid", "string").alias("uuid"),
                    F.try_variant_get("doc", "$.type", "string").alias("type"))


@register("log_flatten",
          "SELECT uuid, chunk_pos, line FROM ("
          "SELECT uuid, 0 + CASE WHEN role = 'assistant' AND k % 3 = 0 THEN 1 ELSE 0 END AS chunk_pos, "
          "'[' || role || '] text: ' || text AS line FROM log_msgs WHERE role <> 'system' "
          "AND NOT (role = 'user' AND k % 7 = 0) "
          "UNION ALL SELECT uuid, 0, '[' || role || '] thinking: ' FROM log_msgs "
          "WHERE role = 'assistant' AND k % 3 = 0 "
          "UNION ALL SELECT uuid, 1 + CASE WHEN role = 'assistant' AND k % 3 = 0 THEN 1 ELSE 0 END "
          "+ CASE WHEN role = 'assistant' AND k % 3 = 1 THEN 1 ELSE 0 END, "
          "'[' || role || '] tool_result: ' || split_part(text, chr(10), 1) FROM log_msgs "
          "WHERE role <> 'system' AND k % 4 = 2 AND NOT (role = 'user' AND k % 7 = 0))",
          ("log_msgs",))
def q_log_flatten(spark, sf):
    return L.flatten_messages(_log(spark, sf))


@register("log_map_entries",
          "SELECT uuid, 'model-a' AS model, n AS input_tokens, n * 2 AS output_tokens, round(n / 100.0, 2) "
          "AS cost_usd FROM log_results UNION ALL SELECT uuid, 'model-b', CAST(turn + 1 AS BIGINT), 7, 0.01 "
          "FROM log_results WHERE k % 2 = 0", ("log_results",))
def q_log_map_entries(spark, sf):
    return L.map_entries(_log(spark, sf))


_RESULT_SQL = ("CASE WHEN k % 4 = 0 THEN '# Answer' || chr(10) || text || chr(10) || '* done' || chr(10) || "
               "'## Notes' || chr(10) || '**bold** line' WHEN k % 4 = 1 THEN '```' || chr(10) || text || chr(10) "
               "|| '```' WHEN k % 4 = 2 THEN '' ELSE text END")
register_view("log_fields", ["log_results"], (
    "SELECT uuid, 'result' AS type, CASE WHEN k % 4 = 3 THEN 'error_max_turns' ELSE 'success' END AS subtype, "
    "k % 8 = 3 AS is_error, " + _RESULT_SQL + " AS result, n * 3 AS duration_ms, "
    "CASE WHEN k % 6 <> 0 THEN n * 2 ELSE 0 END AS duration_api_ms, CAST(turn + 1 AS BIGINT) AS num_turns, "
    "round(n / 100.0, 2) AS total_cost_usd, 'conv-' || conv_id AS session_id, n AS input_tokens, "
    "CASE WHEN k % 5 <> 1 THEN n * 2 ELSE 0 END AS output_tokens, CAST(0 AS BIGINT) AS cache_creation, "
    "CAST(turn * 10 AS BIGINT) AS cache_read FROM log_results"))
_DEFAULTS_OTHER = ("SELECT uuid, role AS type, CASE WHEN role = 'system' THEN 'init' ELSE '' END AS subtype, "
                   "false AS is_error, '' AS result, CAST(0 AS BIGINT) AS duration_ms, "
                   "CAST(0 AS BIGINT) AS duration_api_ms, CAST(0 AS BIGINT) AS num_turns, 0.0 AS total_cost_usd, "
                   "'conv-' || conv_id AS session_id, CAST(0 AS BIGINT) AS input_tokens, "
                   "CAST(0 AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_creation, "
                   "CAST(0 AS BIGINT) AS cache_read FROM log_msgs")


@register("log_defaults", f"SELECT * FROM log_fields UNION ALL {_DEFAULTS_OTHER}", ("log_fields", "log_msgs"))
def q_log_defaults(spark, sf):
    return L.with_defaults(_log(spark, sf))


@register("log_status",
          "SELECT uuid, CASE WHEN is_error THEN 'ERROR' WHEN subtype = 'success' THEN 'SUCCESS' ELSE type END "
          f"AS status FROM (SELECT * FROM log_fields UNION ALL {_DEFAULTS_OTHER})", ("log_fields", "log_msgs"))
def q_log_status(spark, sf):
    f = L.with_defaults(_log(spark, sf))
    return f.select("uuid", L.status_label(F.col("is_error"), F.col("subtype"), F.col("type")).alias("status"))


@register("fmt_duration",
          "SELECT uuid, CASE WHEN duration_ms < 1000 THEN duration_ms || 'ms' ELSE "
          "(duration_ms // 1000) || '.' || lpad(CAST((duration_ms % 1000) // 10 AS VARCHAR), 2, '0') || 's' END "
          "AS duration, CASE WHEN duration_api_ms < 1000 THEN duration_api_ms || 'ms' ELSE "
          "(duration_api_ms // 1000) || '.' || lpad(CAST((duration_api_ms % 1000) // 10 AS VARCHAR), 2, '0') "
          "|| 's' END AS api_duration FROM log_fields", ("log_fields",))
def q_fmt_duration(spark, sf):
    f = L.with_defaults(_log(spark, sf)).where(F.col("type") == "result")
    return f.select("uuid", L.duration_label(F.col("duration_ms")).alias("duration"),
                    L.duration_label(F.col("duration_api_ms")).alias("api_duration"))


@register("fmt_misc",
          "SELECT uuid, printf('%.4f', total_cost_usd) AS cost, left(session_id, 8) AS session_short "
          "FROM log_fields", ("log_fields",))
def q_fmt_misc(spark, sf):
    f = L.with_defaults(_log(spark, sf)).where(F.col("type") == "result")
    return f.select("uuid", L.cost_label(F.col("total_cost_usd")).alias("cost"),
                    F.left(F.col("session_id"), F.lit(8)).alias("session_short"))


@register("event_clock",
          "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
def q_event_clock(spark, sf):
    e = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet")
    return e.select("event_id", F.date_format("ts", "HH:mm:ss").alias("clock"))


@register("log_lines",
          "SELECT uuid, line_no, line, CASE WHEN contains(line, '```') THEN 'code' WHEN contains(line, '**') "
          "THEN 'bold' ELSE 'plain' END AS kind FROM (SELECT uuid, CAST(g.idx - 1 AS INTEGER) "
          "AS line_no, regexp_replace(regexp_replace(regexp_replace(g.raw, '^# ', '  '), '^## ', '    '), "
          "'^\\* ', '  • ') AS line FROM (SELECT uuid, unnest(string_split(result, chr(10))) AS raw, "
          "generate_subscripts(string_split(result, chr(10)), 1) AS idx FROM log_fields WHERE result <> '') g)",
          ("log_fields",))
def q_log_lines(spark, sf):
    return L.response_lines(L.with_defaults(_log(spark, sf)))
