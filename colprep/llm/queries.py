"""Queries over the given tables, one for each operator, and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colprep.llm import (
    chat_format, decontaminate, filter_audit, html_extract, jaccard_join, language_id, packing, quality_rules, secret_scan, token_files, topk_index, vector_codes, warc,
)
from colprep.llm.common import read

TOOLS = [
    chat_format.Tool("search", {"query": ("string", True), "limit": ("integer", True)}),
    chat_format.Tool("note", {"query": ("string", True), "limit": ("integer", False), "pinned": ("boolean", False)}),
]


def chat_tables(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The given conversations hold no tool calls, so their turns are read as such.

    An assistant's turn is a call named by its conversation and turn, with arguments in one of four forms, right
    and wrong; it needs the call two turns before. A turn of another role right behind it is its result.
    """
    def named(turn):
        return F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")))

    size = F.length("text")
    form = size % 4
    arguments = F.when(form == 0, F.to_json(F.struct(F.col("text").alias("query"), size.alias("limit")))).when(form == 1, F.to_json(F.struct(F.col("text").alias("query")))).when(
        form == 2, F.to_json(F.struct(F.col("text").alias("query"), size.cast("string").alias("limit")))
    ).otherwise(F.to_json(F.struct(F.col("text").alias("query"), size.alias("limit"), F.lit(True).alias("pinned"))))
    is_call = F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = turns.where(is_call).select(
        "conv_id", "turn", named(F.col("turn")).alias("call_id"), F.when(size % 3 == 0, "note").when(size % 7 == 1, "paint").otherwise("search").alias("name"),
        arguments.alias("arguments"), F.when(F.col("turn") >= 2, F.array(named(F.col("turn") - 2))).alias("after"),
    )
    results = turns.where(~is_call & (F.col("turn") >= 1)).select("conv_id", "turn", named(F.col("turn") - 1).alias("call_id"), "text")
    return turns.where(~is_call & ~F.coalesce(F.col("turn") >= 1, F.lit(False))), calls, results


def op1_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.similar_documents(read(spark, sf, "documents"))


def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    return chat_format.format_chats(*chat_tables(read(spark, sf, "conversations")), TOOLS)


def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf, "documents"))


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op5_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract(read(spark, sf, "pages"))


def op6_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk_index.top_k(read(spark, sf, "embeddings"))


def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.token_table(read(spark, sf, "documents"))


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(read(spark, sf, "documents"))


def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive(read(spark, sf, "pages"))


def op10_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan_documents(read(spark, sf, "documents"))


def op11_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.audit(read(spark, sf, "documents"))


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf, "documents"), read(spark, sf, "labels"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_chat_format, op3_best_fit_packing, op4_decontamination, op5_html_text, op6_top_k, op7_token_files, op8_language_id, op9_warc, op10_secret_scan,
        op11_quality_rules, op12_vector_codes, op13_filter_audit, pipeline,
    )
}

ORACLE = {
    "op1_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\t\n\x0b\x0c\r ]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT r, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN CAST([''] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM w
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), p AS (
  SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL
), links AS (
  SELECT ra, rb FROM p JOIN n x ON x.r = ra JOIN n y ON y.r = rb WHERE 1.8 * c >= 0.8 * (x.n + y.n) - 1e-9
), reach AS (
  SELECT r, r AS other FROM w UNION SELECT reach.r, links.rb FROM reach JOIN links ON reach.other = links.ra
)
SELECT w.doc_id, c.class_id, coalesce(l.n_links, 0) AS n_links
FROM w JOIN (SELECT reach.r, min(doc_id) AS class_id FROM reach JOIN w ON w.r = reach.other GROUP BY reach.r) c ON c.r = w.r
LEFT JOIN (SELECT ra, count(*) AS n_links FROM links GROUP BY ra) l ON l.ra = w.r
""",
    "op9_warc": r"""
WITH p AS (
  SELECT page_id, lower(coalesce(url, '')) AS url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), f AS (
  SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest
), k AS (
  SELECT *, regexp_replace(url, '^[a-z][a-z0-9+.-]*://(www\.)?', '') AS rest FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, k.digest AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(regexp_extract(rest, '^[^/?#]*'), '.')), ',') || ')' || regexp_replace(rest, '^[^/?#]*', '') AS url_key,
  strftime(make_timestamp((1700000000 + coalesce(page_id, 0)) * 1000000), '%Y%m%d%H%M%S') AS captured,
  row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS history
FROM k LEFT JOIN f ON f.digest = k.digest
""",
    "op2_chat_format": """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, text, length(text) AS n, coalesce(role = 'assistant', false) AS is_call FROM conversations
), calls AS (
  SELECT *, md5(concat_ws(':', conv_id, turn)) AS call_id,
    CASE WHEN n % 3 = 0 THEN 'note' WHEN n % 7 = 1 THEN 'paint' ELSE 'search' END AS name
  FROM t WHERE is_call
), levels AS (
  SELECT DISTINCT conv_id, turn, 0 AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 2)
  UNION
  SELECT c.conv_id, c.turn, l.level + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2
), results AS (
  SELECT *, md5(concat_ws(':', conv_id, turn - 1)) AS call_id FROM t WHERE NOT is_call AND turn >= 1
)
SELECT conv_id, turn, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS INTEGER) AS level, '' AS errors,
  '{"content":' || to_json(coalesce(text, '')) || ',"role":' || to_json(role) || '}' AS json
FROM t WHERE NOT is_call AND NOT coalesce(turn >= 1, false)
UNION ALL
SELECT c.conv_id, c.turn, 'call', c.call_id, l.level,
  concat_ws(',',
    CASE WHEN name = 'paint' THEN 'tool' END,
    CASE WHEN name = 'search' AND n % 4 = 1 THEN 'missing:limit' END,
    CASE WHEN name <> 'paint' AND n % 4 = 2 THEN 'type:limit' END,
    CASE WHEN name = 'search' AND n % 4 = 3 THEN 'unknown:pinned' END,
    CASE WHEN c.turn >= 2 AND l.level = 0 THEN 'dangling' END,
    CASE WHEN NOT EXISTS (SELECT 1 FROM results r WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id) THEN 'unanswered' END),
  '{"arguments":{' || CASE n % 4 WHEN 0 THEN '"limit":' || n || ',' WHEN 1 THEN '' WHEN 2 THEN '"limit":"' || n || '",' ELSE '"limit":' || n || ',"pinned":true,' END
    || '"query":' || to_json(text) || '},"id":"' || c.call_id || '","name":"' || name || '","role":"assistant","type":"tool_call"}'
FROM calls c LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn
UNION ALL
SELECT r.conv_id, r.turn, 'result', r.call_id, l.level, CASE WHEN l.turn IS NULL THEN 'orphan' ELSE '' END,
  '{"content":' || to_json(coalesce(text, '')) || ',"role":"tool","tool_call_id":"' || r.call_id || '"}'
FROM results r LEFT JOIN levels l ON l.conv_id = r.conv_id AND l.turn = r.turn - 1
""",
    "op6_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""",
    "op11_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT r, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'i': i, 'g': array_to_string(ws[i:i + 2], ' ')}), recursive := true) FROM w WHERE len(ws) >= 3
), twice AS (
  SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS t(k) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullets
  FROM w LEFT JOIN rep USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 100 * n_capitals > 30 * word_chars
    OR 100 * n_lettered < 80 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_bullets > 90 * n_lines) AS kept
FROM f
""",
    "op12_vector_codes": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT r, vec_id, label, p, e[p * len(e) // 16 + 1:(p + 1) * len(e) // 16] AS x FROM v, range(16) AS t(p)
), c0 AS (
  SELECT p, x AS c, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts QUALIFY k < 64
), a1 AS (
  SELECT r, parts.p, any_value(x) AS x, min({'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': k}) AS best FROM parts JOIN c0 ON parts.p = c0.p GROUP BY r, parts.p
), m1 AS (
  SELECT p, k, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS c FROM (
    SELECT p, best.k AS k, j, sum(x[j]) AS s, count(*) AS n FROM a1, range(1, 1000) AS t(j) WHERE j <= len(x) GROUP BY ALL
  ) GROUP BY p, k
), c1 AS (
  SELECT p, k, coalesce(m1.c, c0.c) AS c FROM c0 LEFT JOIN m1 USING (p, k)
), a2 AS (
  SELECT r, parts.p, any_value(x) AS x, min({'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': k}) AS best FROM parts JOIN c1 ON parts.p = c1.p GROUP BY r, parts.p
), m2 AS (
  SELECT p, k, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS c FROM (
    SELECT p, best.k AS k, j, sum(x[j]) AS s, count(*) AS n FROM a2, range(1, 1000) AS t(j) WHERE j <= len(x) GROUP BY ALL
  ) GROUP BY p, k
), c2 AS (
  SELECT p, k, coalesce(m2.c, c1.c) AS c FROM c1 LEFT JOIN m2 USING (p, k)
), a3 AS (
  SELECT r, parts.p, any_value(vec_id) AS vec_id, any_value(label) AS label, min({'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': k}) AS best
  FROM parts JOIN c2 ON parts.p = c2.p GROUP BY r, parts.p
), coded AS (
  SELECT any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a3 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c2) AS codebooks_sha256
FROM coded
""",
    "op13_filter_audit": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), first AS (
  SELECT text, min(doc_id) AS id FROM d GROUP BY text
), l AS (
  SELECT doc_id, max(CAST(coalesce(quality, 0) = 1 AS INT)) AS good, max(CAST(coalesce(toxic, 0) = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text) AS INT)
    + 8 * CAST(regexp_matches(d.text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(d.doc_id > first.id, false) AS INT) AS mask,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM d JOIN first ON first.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY ALL
), orders(o, applied, n) AS (
  SELECT '', 0, 0 UNION ALL SELECT o || substr('ABCDE', k + 1, 1), applied | (1 << k), n + 1 FROM orders, (SELECT CAST(range AS INT) AS k FROM range(5)) WHERE applied & (1 << k) = 0
), steps AS (
  SELECT o, s, 1 << (instr('ABCDE', substr(o, s, 1)) - 1) AS bit, list_sum(list_transform(range(1, s), lambda i: 1 << (instr('ABCDE', substr(o, i, 1)) - 1))) AS earlier
  FROM orders, (SELECT CAST(range AS INT) AS s FROM range(1, 6)) WHERE n = 5
), m AS (
  SELECT part, o AS filter_order, s AS step, bit,
    CAST(coalesce(sum(n) FILTER (mask & (coalesce(earlier, 0) | bit) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & coalesce(earlier, 0) <> 0 AND mask & bit <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0), 0) AS BIGINT) AS toxic_lost
  FROM c, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM m
""",
}
