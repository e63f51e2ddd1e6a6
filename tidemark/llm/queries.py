"""The registered queries of the corpus operators, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    class_lm,
    exact_dedup,
    fingerprints,
    hard_negatives,
    jaccard_join,
    lang_id,
    merkle,
    mixing,
    pii,
    quality,
    simhash,
    url_filter,
)

#: A file of the public tokenizers package.
TOKENIZER = "word_bpe_49k.json"

#: Rules of the URL query: fixed values of its contract.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf))


def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(documents(spark, sf), public_tokenizers.path(TOKENIZER), digests=True)


def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf))


def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_with_edits(documents(spark, sf))


def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    return url_filter.judge_urls(pages, rules)


def op6_lang_id(spark: SparkSession, sf: str) -> DataFrame:
    return lang_id.predict_languages(documents(spark, sf))


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mix(mixing.sized(documents(spark, sf)))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def op10_class_lm(spark: SparkSession, sf: str) -> DataFrame:
    return class_lm.score_documents(documents(spark, sf))


def op11_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf))


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf), tampered=merkle.every_seventh())


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = hard_negatives.relabelled(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)"""

_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)

OP5_SQL = rf"""
WITH r(rule_host, rule_path, action) AS (VALUES {_RULES}),
p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
u AS (SELECT DISTINCT host, path FROM p),
m AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(action, length(rule_host || rule_path)) AS action
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path"""

OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
           WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- Only shingles of two documents can be common ones.
shared AS (SELECT doc_id, shingle FROM s WHERE shingle IN (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1)),
c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shared x JOIN shared y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 80 * (x.n + y.n - common)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reached r ON r.doc_id = w.doc_id GROUP BY w.doc_id"""

OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
            || coalesce(octet_length(encode(source)) || ':' || source, '-')
            || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS front,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS back
  FROM documents),
-- DuckDB has no crc32: eight shifts for each byte of the decimal id.
crc(doc_id, rest, c) AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR, 4294967295::BIGINT FROM d WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, rest[2:], list_reduce(
           list_prepend(xor(c, ascii(rest[1])::BIGINT), range(8)),
           lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
  FROM crc WHERE rest <> ''),
seventh AS (SELECT doc_id FROM crc WHERE rest = '' AND xor(c, 4294967295) % 7 = 0),
l AS (
  SELECT lang, doc_id, sha256(front || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || back) AS leaf,
         sha256(front || coalesce(octet_length(encode((n_chars + b)::VARCHAR)) || ':' || (n_chars + b), '-') || back) AS given
  FROM (SELECT *, (doc_id IN (SELECT doc_id FROM seventh))::BIGINT AS b FROM d) x),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
t(lang, lvl, pos, n, h) AS (
  SELECT lang, 0, pos, n, leaf FROM p
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2),
s AS (
  SELECT lang, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM t WHERE n = 1),
u(lvl, pos, n, h) AS (
  SELECT 0, pos, n, h FROM s
  UNION ALL
  SELECT lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 2),
-- The steps of every leaf: its place at each level, and the sibling there, if any.
steps AS (
  SELECT p.lang, p.doc_id, p.pos AS leaf_pos, t.lvl AS step, (p.pos >> t.lvl) & 1 AS odd, o.h AS sibling
  FROM p JOIN (SELECT DISTINCT lang, lvl FROM t WHERE n > 1) t ON p.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM p.lang AND o.lvl = t.lvl AND o.pos = xor(p.pos >> t.lvl, 1)
  UNION ALL
  SELECT p.lang, p.doc_id, p.pos, 1000 + u.lvl, (s.pos >> u.lvl) & 1, o.h
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang
  CROSS JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) u
  LEFT JOIN u o ON o.lvl = u.lvl AND o.pos = xor(s.pos >> u.lvl, 1)),
paths AS (
  SELECT lang, leaf_pos, list(struct_pack(odd, sibling) ORDER BY step) AS path,
         sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256
  FROM steps GROUP BY lang, leaf_pos),
f(lang, pos, h, path) AS (
  SELECT p.lang, p.pos, p.given, coalesce(q.path, []) FROM p LEFT JOIN paths q ON p.lang IS NOT DISTINCT FROM q.lang AND p.pos = q.leaf_pos
  UNION ALL
  SELECT lang, pos, sha256(CASE WHEN path[1].odd = 1 THEN coalesce(path[1].sibling, '') || h ELSE h || coalesce(path[1].sibling, '') END),
         path[2:]
  FROM f WHERE len(path) > 0),
r AS (SELECT h FROM u WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = r.h AS verified
FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN r
JOIN f ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos AND len(f.path) = 0
LEFT JOIN paths q ON p.lang IS NOT DISTINCT FROM q.lang AND p.pos = q.leaf_pos"""

OP13_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
   AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_fingerprints": op4_fingerprints,
    "op5_url_filter": op5_url_filter,
    "op6_lang_id": op6_lang_id,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_class_lm": op10_class_lm,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_merkle": op12_merkle,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op5_url_filter": OP5_SQL,
    "op11_jaccard_join": OP11_SQL,
    "op12_merkle": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
