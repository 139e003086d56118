"""Operators over a JSON-lines run log: tolerant parse, message flattening,
map-to-rows, field defaults and the status / duration / cost labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import variant as V

# Content chunk types that are shown.
SHOWN_CHUNKS = ("text", "message", "tool_result", "thinking", "analysis", "reasoning")


def parse_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """One parsed document per line; a line that is not valid JSON is dropped."""
    return lines.select(F.try_parse_json(F.col(col)).alias("doc")).where(F.col("doc").isNotNull())


def parse_files(lines: DataFrame, col: str = "value") -> DataFrame:
    """Every line of a text scan with where it is from and its document:
    (file, block_start, line, doc).  ``doc`` is NULL for a line that is not valid JSON;
    file and first byte of the block that was read stand for the place."""
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"),
                        F.col(col).alias("line"), F.try_parse_json(F.col(col)).alias("doc"))


def write_parsed(lines: DataFrame, path: str) -> dict[str, int]:
    """The log in one pass: documents to the folder ``kind=document`` of ``path`` and
    lines that are none, with their place, to ``kind=rejected``.  Returns {'lines',
    'rejected'}, counted along the way."""
    seen = Observation()
    bad = F.col("doc").isNull()
    out = parse_files(lines).select("file", "block_start", F.when(bad, F.col("line")).alias("line"), F.to_json("doc").alias("doc"),
                                    F.when(bad, "rejected").otherwise("document").alias("kind"))
    out = out.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("kind") == "rejected").alias("rejected"))
    out.write.partitionBy("kind").parquet(path)
    return seen.get


def alt(*vals: Column) -> Column:
    """``a // b // c``: the first operand that is neither null nor false."""
    expr = None
    for v in vals[:-1]:
        ok = V.present(v) & ~F.coalesce(V.is_bool(v) & ~F.try_variant_get(v, "$", "boolean"), F.lit(False))
        expr = F.when(ok, v) if expr is None else expr.when(ok, v)
    last = vals[-1]
    return last if expr is None else expr.otherwise(last)


def doc_field(path: str) -> Column:
    return F.try_variant_get(F.col("doc"), "$." + path, "variant")


def flatten_messages(docs: DataFrame) -> DataFrame:
    """Lines that carry a message -> one row per shown content chunk, with
    the text ``[role] type: content`` (role falls back to the line type;
    content to the chunk text, then '')."""
    msg = doc_field("message")
    with_msg = docs.where(V.truthy(msg) | (V.present(msg) & V.is_bool(msg) & F.try_variant_get(msg, "$", "boolean")))
    role = alt(doc_field("message.role"), doc_field("type"))
    chunks = F.try_variant_get(F.col("doc"), "$.message.content", "array<variant>")
    x = with_msg.select(F.try_variant_get(F.col("doc"), "$.uuid", "string").alias("uuid"),
                        V.as_text(role).alias("role"), F.posexplode(chunks).alias("chunk_pos", "chunk"))
    ctype = F.try_variant_get(F.col("chunk"), "$.type", "string")
    body = alt(V.get(F.col("chunk"), "content"), V.get(F.col("chunk"), "text"), F.lit("").cast("variant"))
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.coalesce(ctype, F.lit("unknown")), F.lit(": "),
                    V.as_text(body))
    return x.where(ctype.isin(*SHOWN_CHUNKS)).select("uuid", "chunk_pos", line.alias("line"))


def map_entries(docs: DataFrame, path: str = "modelUsage") -> DataFrame:
    """``.modelUsage | to_entries[]``: one row per key of the object."""
    m = F.try_variant_get(F.col("doc"), "$." + path, "map<string,variant>")
    x = docs.select(F.try_variant_get(F.col("doc"), "$.uuid", "string").alias("uuid"),
                    F.explode(m).alias("model", "usage"))
    u = F.col("usage")
    return x.select("uuid", "model",
                    F.try_variant_get(u, "$.inputTokens", "bigint").alias("input_tokens"),
                    F.try_variant_get(u, "$.outputTokens", "bigint").alias("output_tokens"),
                    F.try_variant_get(u, "$.costUSD", "double").alias("cost_usd"))


def with_defaults(docs: DataFrame) -> DataFrame:
    """The fields the viewer reads, each with its default when null or false."""
    def f(path, default, typ):
        return F.try_variant_get(alt(doc_field(path), F.lit(default).cast("variant")), "$", typ)
    return docs.select(
        F.try_variant_get(F.col("doc"), "$.uuid", "string").alias("uuid"),
        f("type", "unknown", "string").alias("type"),
        f("subtype", "", "string").alias("subtype"),
        f("is_error", False, "boolean").alias("is_error"),
        f("result", "", "string").alias("result"),
        f("duration_ms", 0, "bigint").alias("duration_ms"),
        f("duration_api_ms", 0, "bigint").alias("duration_api_ms"),
        f("num_turns", 0, "bigint").alias("num_turns"),
        f("total_cost_usd", 0, "double").alias("total_cost_usd"),
        f("session_id", "", "string").alias("session_id"),
        f("usage.input_tokens", 0, "bigint").alias("input_tokens"),
        f("usage.output_tokens", 0, "bigint").alias("output_tokens"),
        f("usage.cache_creation_input_tokens", 0, "bigint").alias("cache_creation"),
        f("usage.cache_read_input_tokens", 0, "bigint").alias("cache_read"))


def status_label(is_error: Column, subtype: Column, typ: Column) -> Column:
    return F.when(is_error, F.lit("ERROR")).when(subtype == "success", F.lit("SUCCESS")).otherwise(typ)


def duration_label(ms: Column) -> Column:
    """< 1000 -> 'Nms'; else seconds truncated to two decimals, 'S.SSs'."""
    secs = F.concat(F.floor(ms / 1000).cast("string"), F.lit("."),
                    F.lpad(F.floor(F.pmod(ms, F.lit(1000)) / 10).cast("string"), 2, "0"), F.lit("s"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(secs)


def cost_label(cost: Column) -> Column:
    return F.format_string("%.4f", cost)


def response_lines(fields: DataFrame) -> DataFrame:
    """Result text -> display lines: '# ', '## ' and '* ' prefixes rewritten,
    code-fence and bold lines flagged."""
    res = F.col("result")
    x = fields.where((res != "") & (res != "null")).select(
        "uuid", F.posexplode(F.split(res, "\n")).alias("line_no", "raw"))
    line = F.regexp_replace(F.col("raw"), r"^# ", "  ")
    line = F.regexp_replace(line, r"^## ", "    ")
    line = F.regexp_replace(line, r"^\* ", "  • ")
    kind = F.when(line.contains("```"), F.lit("code")).when(line.contains("**"), F.lit("bold")).otherwise(F.lit("plain"))
    return x.select("uuid", "line_no", line.alias("line"), kind.alias("kind"))
