"""Queries that apply the text operators to the whole given tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vitalspan.catalog.base import Query, table
from vitalspan.llm import (
    bpe,
    decontaminate,
    hard_negatives,
    licenses,
    minhash_dedup,
    ngram_join,
    order_minhash,
    prefix_trie,
    quality_cnn,
    repair_store,
    suffix_dedup,
    toxicity,
    url_rules,
)

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text with the contiguous rank array."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_OP5_SQL = rf"""
WITH items AS (
  SELECT DISTINCT item_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT item_id, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w
  FROM items WHERE len(w) > 0
), patterns AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p FROM windows
), docs AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents
), places AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs CROSS JOIN (SELECT DISTINCT n FROM patterns) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, item_id, places.n, i FROM places JOIN patterns ON places.p = patterns.p AND places.n = patterns.n
), words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op5_decontaminate", _OP5_SQL)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document, by Wu-Manber search."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP2_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)
), m AS (
  SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)
), r AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh
  FROM w JOIN m USING (s) WHERE doc_id > first_id
), numbered AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r
), runs AS (
  SELECT doc_id, min(i) AS low, max(i) + 50 AS high FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, low, high, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY low) AS before FROM runs
), cut AS (
  SELECT doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans, max(high) AS last_high,
    string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS head
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last_high, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


@query("op2_suffix_dedup", _OP2_SQL)
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that an earlier document already has in a string of 50."""
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))




def _near_sql(gram: int, more: str = "") -> str:
    """Components of documents whose shingle sets reach 85 percent, by comparing every pair that shares one."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {gram - 1}), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {gram - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.size, nb.size
  HAVING 100 * count(*) >= 85 * (na.size + nb.size - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT d.doc_id, coalesce(any_value(n.size), 0) AS n_shingles, min(reach.y) AS component_id{more}
FROM d JOIN reach ON reach.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op8_ngram_join", _near_sql(4))
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies by 4-word shingles and Jaccard 0.85."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a text is toxic, from lexicon hits and their context."""
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op1_sql() -> str:
    """Phrases and templates as regular expressions over the words joined by spaces."""
    phrases = [(" ".join(p.split()), label) for p, label in licenses.PHRASES.items()]
    found = [(licenses.template_pattern(t), label, score) for label, score, t in licenses.TEMPLATES]
    values = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in phrases)
    hits = ", ".join(f"regexp_matches(joined, '{pattern}')" for pattern, _, _ in found)
    labels = ", ".join(f"'{label}'" for _, label, _ in found)
    scores = ", ".join(str(score) for _, _, score in found)
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents
), j AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM d
), places AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: array_to_string(w[i + 1 : i + n], ' ') = phrase)) AS i
  FROM j JOIN (VALUES {values}) AS p(phrase, label, n) ON contains(joined, ' ' || phrase || ' ')
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
  FROM places GROUP BY doc_id
), t AS (
  SELECT doc_id, len(w) AS n, list_zip([{hits}], [{labels}], [{scores}]) AS hits FROM j
), m AS (
  SELECT doc_id, n, list_transform(list_filter(hits, lambda h: h[1]), lambda h: h[2]) AS labels,
    coalesce(list_max(list_transform(list_filter(hits, lambda h: h[1]), lambda h: h[3])), 0) AS score FROM t
)
SELECT doc_id, n AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), m.labels))), ',') AS labels,
  CAST(greatest(m.score, CASE WHEN n_base > 0 THEN {licenses.PHRASE} ELSE 0 END) AS DOUBLE) AS score
FROM m LEFT JOIN base USING (doc_id)
"""


@query("op1_licenses", _op1_sql())
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and accepted licence templates of every text."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a text is of good quality, by a byte-level convolutional network."""
    return quality_cnn.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_repair")
def op4_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files with a Re-Pair grammar per shard, read back document by document."""
    return repair_store.store_and_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_order_minhash")
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every text and of its edited text, by built-in functions."""
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


@query("op7_url_rules")
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by fixed rules, then by mined ones."""
    return url_rules.judged(table(spark, sf_dir, "pages"))


_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(c) + 1), lambda i: CAST(ascii(c[i]) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

_OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS size,
    md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS c, list(digest || ':' || size ORDER BY turn NULLS FIRST, digest) AS s
  FROM t GROUP BY conv_id
), heads AS (
  SELECT conv_id, s, {_CRC} % 9 AS h FROM lists
), rebuilt AS (
  SELECT heads.conv_id, list_concat(coalesce(base.s[1:h], []), heads.s[h + 1:]) AS s
  FROM heads LEFT JOIN lists base ON base.conv_id = heads.conv_id - heads.conv_id % 5
), prefixes AS (
  SELECT conv_id, len(s) AS n, s[1:d] AS p, d FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY p
), placed AS (
  SELECT v.*, u.conv_id AS parent_conv_id, u.p AS above
  FROM nodes v LEFT JOIN nodes u ON v.depth > 0 AND u.p = v.p[1:v.depth - 1]
), children AS (
  SELECT above AS p, count(*) AS n_children FROM placed WHERE depth > 0 GROUP BY above
), own AS (
  SELECT p, depth, n_children IS NULL AS leaf,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * CAST(split_part(p[depth], ':', 2) AS BIGINT) END AS saved
  FROM placed LEFT JOIN children USING (p)
), below AS (
  SELECT p[1:d] AS p, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT p, leaf, saved, unnest(range(0, depth + 1)) AS d FROM own) GROUP BY 1
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved_tokens, ends_sha256
FROM placed LEFT JOIN children USING (p) JOIN below USING (p)
"""


@query("op13_prefix_trie", _OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt conversations, by ROLLUP over positional turn columns."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


_OP12_SQL = """
WITH e AS (
  SELECT vec_id, min({'l': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END,
    'v': list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))}) AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.r.l = b.r.l AS same, CAST(list_dot_product(a.r.v, b.r.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op12_hard_negatives", _OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, by threshold joins on a suffix-norm index."""
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op11_minhash_dedup", _near_sql(5, ", d.doc_id = min(reach.y) AS kept"))
def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies by 5-word shingles, from MinHash bands and odd sketches."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
