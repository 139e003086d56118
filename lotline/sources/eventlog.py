"""JSON-lines run log: built from the conversation table, written as text,
read back tolerantly.

Each conversation turn becomes one stream line (system init, or a message
with content chunks); each assistant turn also yields a result line with
timing, cost, token usage and a per-model usage map.  Every 13th line is cut
short (invalid JSON) as happens when a process dies mid-write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize_text


def _k() -> Column:
    return F.col("conv_id") * 16 + F.col("turn")


def message_line(conv: DataFrame) -> DataFrame:
    k = _k()
    text = F.col("text")
    session = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    uuid = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit("-m"))
    chunk_t = "struct<type:string,text:string,content:string,thinking:string,name:string>"

    def chunk(typ, text_=None, content=None, thinking=None, name=None):
        return F.struct(F.lit(typ).alias("type"), (text_ if text_ is not None else F.lit(None)).cast("string").alias("text"),
                        (content if content is not None else F.lit(None)).cast("string").alias("content"),
                        (thinking if thinking is not None else F.lit(None)).cast("string").alias("thinking"),
                        (F.lit(name) if name else F.lit(None)).cast("string").alias("name"))
    first_line = F.split(text, "\n")[0]
    chunks = F.array(chunk("text", text_=text))
    chunks = F.when((F.col("role") == "assistant") & (k % 3 == 0),
                    F.concat(F.array(chunk("thinking", thinking=F.lit("..."))), chunks)).otherwise(chunks)
    chunks = F.when((F.col("role") == "assistant") & (k % 3 == 1),
                    F.concat(chunks, F.array(chunk("tool_use", name="Bash")))).otherwise(chunks)
    chunks = F.when(k % 4 == 2, F.concat(chunks, F.array(chunk("tool_result", content=first_line)))).otherwise(chunks)
    chunks = chunks.cast(f"array<{chunk_t}>")
    content = F.when((F.col("role") == "user") & (k % 7 == 0), F.to_json(text.cast("variant"))) \
               .otherwise(F.to_json(chunks))
    role_json = F.when(k % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"role":'), F.to_json(F.col("role").cast("variant")), F.lit(",")))
    msg = F.concat(F.lit('{"type":'), F.to_json(F.col("role").cast("variant")), F.lit(',"message":{'), role_json,
                   F.lit('"content":'), content, F.lit('},"session_id":"'), session, F.lit('","uuid":"'), uuid,
                   F.lit('"}'))
    system = F.concat(F.lit('{"type":"system","subtype":"init","session_id":"'), session, F.lit('","uuid":"'),
                      uuid, F.lit('"}'))
    return conv.select("conv_id", "turn", F.lit("m").alias("kind"),
                       F.when(F.col("role") == "system", system).otherwise(msg).alias("line"))


def result_text() -> Column:
    k = _k()
    t = F.col("text")
    return (F.when(k % 4 == 0, F.concat(F.lit("# Answer\n"), t, F.lit("\n* done\n## Notes\n**bold** line")))
            .when(k % 4 == 1, F.concat(F.lit("```\n"), t, F.lit("\n```")))
            .when(k % 4 == 2, F.lit(""))
            .otherwise(t))


def result_line(conv: DataFrame) -> DataFrame:
    k = _k()
    n = F.length("text").cast("bigint")
    usage = F.struct(n.alias("input_tokens"),
                     F.when(k % 5 != 1, n * 2).alias("output_tokens"),
                     F.lit(0).cast("bigint").alias("cache_creation_input_tokens"),
                     (F.col("turn") * 10).alias("cache_read_input_tokens"))
    model_a = F.struct(n.alias("inputTokens"), (n * 2).alias("outputTokens"),
                       (F.round(n / 100.0, 2)).alias("costUSD"))
    model_b = F.struct((F.col("turn") + 1).alias("inputTokens"), F.lit(7).cast("bigint").alias("outputTokens"),
                       F.lit(0.01).alias("costUSD"))
    usage_map = F.when(k % 2 == 0, F.create_map(F.lit("model-a"), model_a, F.lit("model-b"), model_b)) \
                 .otherwise(F.create_map(F.lit("model-a"), model_a))
    rec = F.struct(
        F.lit("result").alias("type"),
        F.when(k % 4 == 3, F.lit("error_max_turns")).otherwise(F.lit("success")).alias("subtype"),
        F.when(k % 8 == 3, F.lit(True)).when(k % 8 == 7, F.lit(None)).otherwise(F.lit(False)).alias("is_error"),
        result_text().alias("result"),
        (n * 3).alias("duration_ms"),
        F.when(k % 6 != 0, n * 2).alias("duration_api_ms"),
        (F.col("turn") + 1).alias("num_turns"),
        F.round(n / 100.0, 2).alias("total_cost_usd"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session_id"),
        usage.alias("usage"),
        usage_map.alias("modelUsage"),
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit("-r")).alias("uuid"))
    return conv.where(F.col("role") == "assistant").select("conv_id", "turn", F.lit("r").alias("kind"),
                                                           F.to_json(rec).alias("line"))


def build_log(conversations: DataFrame) -> DataFrame:
    lines = message_line(conversations).unionByName(result_line(conversations))
    k = _k()
    bad = (k % 13 == 5) & (F.col("kind") == "m") | (k % 13 == 6) & (F.col("kind") == "r")
    cut = F.substring(F.col("line"), 1, (F.length("line") / 2).cast("int"))
    return lines.select(F.when(bad, cut).otherwise(F.col("line")).alias("value"))


def log_text(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """The log written as a text file once (shared work folder), read back
    line by line as ``value``."""
    conv = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return materialize_text(spark, "runlog", lambda: build_log(conv), key)
