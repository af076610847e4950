"""Queries of the pipeline's operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, exact_dedup, kd_shards, minhash, pieces, pii, store, substring_dedup, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_array_dedup(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame(chat.HOSTILE, "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_json(chat.turn_records(rows.unionByName(hostile))))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is spark.costlight.pii.key; where that is unset, a new one that nobody keeps."""
    key = spark.conf.get("spark.costlight.pii.key", None)
    return pii.checked(_table(spark, sf_dir, "documents"), key.encode() if key else os.urandom(32))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(_table(spark, sf_dir, "documents"), shards=8)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.small_batches(spark)
    return pieces.encode_texts(_table(spark, sf_dir, "documents"), pieces.load())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_substring_dedup, op3_chat_formatting, op4_pii_surrogates, op5_minhash_near_dedup, op6_toxicity, op7_exact_dedup, op8_kd_tree_sharding, op9_sentencepiece, op10_decontamination)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op1_suffix_array_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(octet_length(h) AS BIGINT) AS n_bytes FROM d),
win AS (SELECT doc_id, p, md5(h[p + 1:p + 100]) AS k FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 99)) AS p FROM n WHERE n_bytes >= 100)),
firsts AS (SELECT k, min(doc_id) AS doc_id FROM win GROUP BY k HAVING count(*) > 1),
firstp AS (SELECT k, win.doc_id, min(p) AS p FROM win JOIN firsts USING (k, doc_id) GROUP BY ALL),
marks AS (SELECT win.doc_id, win.p FROM win JOIN firstp f USING (k) WHERE win.doc_id > f.doc_id OR win.p > f.p),
edges AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS fresh FROM marks),
runs AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM (SELECT doc_id, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM edges) GROUP BY doc_id, i),
cuts AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM runs),
kept AS (SELECT c.doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last, string_agg(hex(h[b + 1:s]), '' ORDER BY s) AS body FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT n.doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(body, '') || hex(h[coalesce(last, 0) + 1:n_bytes]))) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)
"""

ORACLES["op2_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
keyed AS (SELECT doc_id, p, md5(array_to_string(w[p:p+12], ' ')) AS k FROM win),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed GROUP BY k),
marks AS (SELECT keyed.doc_id, keyed.p FROM keyed JOIN firsts USING (k) WHERE keyed.doc_id > firsts.first),
gone AS (SELECT DISTINCT doc_id, p + o AS i FROM marks, (SELECT unnest(range(0, 13)) AS o)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT words.doc_id, count(gone.i) AS n_removed, coalesce(string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY words.i), '') AS body
         FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256, CAST(coalesce(s.n, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM gone) WHERE b IS NULL OR b < i - 1 GROUP BY doc_id) s USING (doc_id)
"""

ORACLES["op3_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       CAST(sum(length(role) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 14) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

ORACLES["op5_minhash_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS x, a AS y FROM both_ UNION SELECT reach.x, both_.b FROM reach JOIN both_ ON both_.a = reach.y),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, coalesce(low.y, n.doc_id) AS component_id, coalesce(low.y, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN low ON low.x = n.doc_id
"""

ORACLES["op7_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""

ORACLES["op10_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS size, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, size, array_to_string(w[p:p+size-1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT size FROM grams),
dw AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT dw.doc_id, dw.p, dw.size, item_id FROM dw JOIN grams ON grams.size = dw.size AND grams.g = array_to_string(dw.w[dw.p:dw.p+dw.size-1], ' ')),
cover AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS i FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.names, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
