"""The registered query of each operator, with production parameters, over its
whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, common, decontaminate, hnsw, linededup, neardup, quality, suffixdedup, toxicity, warc, whitening, wordshuffle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Vocabulary of op5 and of the pipeline's last stage: a file name of the public_tokenizers package.
VOCABULARY = "word_bpe_49k.json"
# Ranks of op11; its splitting pattern is the package's.
RANKS = "byte_bpe_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.settle(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


@query("op5_bpe_codec")
def bpe_codec(spark, sf_dir):
    return bpe.encode(common.documents(spark, sf_dir), vocabulary())


@query("op3_minhash_neardup")
def minhash_neardup(spark, sf_dir):
    return neardup.near_duplicates(common.documents(spark, sf_dir))


@query("op10_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    return suffixdedup.remove_repeats(common.documents(spark, sf_dir))


@query("op7_warc", """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""")
def warc_round_trip(spark, sf_dir):
    return warc.round_trip(common.table(spark, sf_dir, "pages"))


@query("op8_hnsw")
def hnsw_search(spark, sf_dir):
    return hnsw.nearest(common.table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query("op4_toxicity")
def toxicity_scores(spark, sf_dir):
    return toxicity.toxicity(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


@query("op1_quality")
def quality_scores(spark, sf_dir):
    return quality.quality(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


_SHINGLES_SQL = """
{t}_words AS (SELECT {id}, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x09-\\x0D ]+'), lambda w: w <> '') AS w FROM {t})"""


@query("op2_decontamination", "WITH" + _SHINGLES_SQL.format(t="documents", id="doc_id") + ","
       + _SHINGLES_SQL.format(t="benchmark", id="item_id") + """,
items AS (SELECT DISTINCT item_id, least(len(w), 5) AS width,
                 unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
          FROM benchmark_words WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY 1),
widths AS (SELECT DISTINCT width FROM items),
docs AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS s
         FROM documents_words CROSS JOIN widths WHERE len(w) >= width)
SELECT doc_id, item_id, n_item, count(*) AS n_shared
FROM docs JOIN items USING (width, s) JOIN sizes USING (item_id)
GROUP BY 1, 2, 3 HAVING 100 * count(*) >= 80 * n_item""")
def decontamination(spark, sf_dir):
    return decontaminate.contaminated(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))


# a run is three lines, or one or two of so many words together
LINE_WORDS = 50


@query("op6_line_dedup", f"""
WITH d AS (SELECT *, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY ln) AS i, len(string_split_regex(x, '[\\s\\x0B]+')) AS w
      FROM (SELECT r, doc_id, text, regexp_replace(x, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS x, ln FROM l) WHERE x <> ''),
g AS (SELECT *, lead(x) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(ln) OVER o AS ln1, lead(ln, 2) OVER o AS ln2, lead(w) OVER o AS w1
      FROM f WINDOW o AS (PARTITION BY r ORDER BY i)),
runs AS (SELECT 3 AS size, r, doc_id, i, x, x1, x2, [ln, ln1, ln2] AS lns FROM g WHERE x2 IS NOT NULL
         UNION ALL SELECT 2, r, doc_id, i, x, x1, NULL, [ln, ln1] FROM g WHERE x1 IS NOT NULL AND w + w1 >= {LINE_WORDS}
         UNION ALL SELECT 1, r, doc_id, i, x, NULL, NULL, [ln] FROM g WHERE w >= {LINE_WORDS}),
k AS (SELECT *, first_value(struct_pack(d := doc_id, i := i)) OVER (PARTITION BY size, x, x1, x2 ORDER BY doc_id, i) AS first FROM runs),
gone AS (SELECT DISTINCT r, unnest(lns) AS ln FROM k WHERE first.d <> doc_id OR first.i <> i),
kept AS (SELECT l.r, string_agg(x, chr(10) ORDER BY ln) AS text FROM l ANTI JOIN gone USING (r, ln) GROUP BY 1)
SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n_lines, coalesce(c.n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS text_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY 1) c USING (r)""")
def line_dedup(spark, sf_dir):
    out = linededup.remove_repeated_lines(common.documents(spark, sf_dir), words=LINE_WORDS)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query("op9_chat_format", """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT conv_id, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS piece, chr(1) || role || chr(2) || text AS part,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
p AS (SELECT conv_id, pos, string_agg(part, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
             count(*) OVER (PARTITION BY conv_id) AS n FROM r),
whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies, any_value(n) AS n_turns FROM p WHERE pos = n GROUP BY 1),
maximal AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n))
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, copies, string_agg(piece, '' ORDER BY pos) AS text
FROM maximal JOIN r USING (conv_id) GROUP BY 1, 2, 3""")
def chat_format(spark, sf_dir):
    return chat.collapse(common.table(spark, sf_dir, "conversations"))


@query("op13_filter_audit", """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                  list_filter(string_split_regex(coalesce(text, ''), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
             + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS INT)
             + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
             + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest([1, 2, 4, 8, 16]) AS b, unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits, f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order
      FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31
      AND len(list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM n, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""")
def filter_audit(spark, sf_dir):
    return audit.audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@query("op12_whitening")
def embedding_whitening(spark, sf_dir):
    return whitening.whitened(common.table(spark, sf_dir, "embeddings"))


@query("op11_byte_bpe")
def byte_bpe(spark, sf_dir):
    import public_tokenizers
    vocabulary = wordshuffle.Vocabulary.read(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return wordshuffle.encode(common.documents(spark, sf_dir), vocabulary)
