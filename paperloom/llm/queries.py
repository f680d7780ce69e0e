"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc, bpe, jaccard, langid, lsh, mixing, ppm, quality, substring, token_counts
from .common import crc_mod, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod("doc_id", 7) == 2
    return ppm.score(table(spark, sf_dir, "documents"), ~held, held)


def op2_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), target="entropy", goal=0.95)


def op4_arc_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.through_warc(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), words=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 3) == 1
    model = langid.train(docs.filter(~held))
    return langid.predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ppm": op1_ppm,
    "op2_multiprobe": op2_multiprobe,
    "op3_mixing": op3_mixing,
    "op4_arc_warc": op4_arc_warc,
    "op5_bpe": op5_bpe,
    "op6_jaccard": op6_jaccard,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
}
ORACLE_SQL: dict[str, str] = {
    "op3_mixing": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents),
t AS (SELECT key, sum(n) AS tokens, count(*) AS docs FROM d GROUP BY key),
p AS (SELECT key, tokens, docs, tokens / (SELECT sum(tokens) FROM t) AS p FROM t),
s AS (SELECT list(tokens::DOUBLE / (SELECT max(tokens) FROM t)) AS s, count(*) AS k FROM t WHERE tokens > 0),
g AS (SELECT coalesce(min(h), 8.0) AS top FROM (SELECT 8.0::DOUBLE * pow(2, i) AS h FROM range(21) r(i)), s
      WHERE NOT ln(list_sum([pow(x, h) FOR x IN s])) - h * list_sum([pow(x, h) * ln(x) FOR x IN s]) / list_sum([pow(x, h) FOR x IN s]) > 0.95 * ln(k)),
b AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, top::DOUBLE AS hi FROM g
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, mid, ln(list_sum([pow(x, mid) FOR x IN s])) - mid * list_sum([pow(x, mid) * ln(x) FOR x IN s]) / list_sum([pow(x, mid) FOR x IN s]) > 0.95 * ln(k) AS up
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM b, s) WHERE i < 60)),
a AS (SELECT hi AS alpha FROM b WHERE i = 60),
w AS (SELECT key, tokens, docs, alpha, CASE WHEN tokens > 0 THEN pow(p, alpha) / (SELECT sum(pow(p, alpha)) FROM p, a WHERE tokens > 0) ELSE 0 END AS weight FROM p, a),
q AS (SELECT *, CAST(round(weight * (SELECT max(tokens / weight) FROM w WHERE tokens > 0)) AS BIGINT) AS quota, CAST(ceil(docs / greatest(1000, ceil(sqrt(docs)))) AS BIGINT) AS blocks FROM w),
r AS (SELECT *, greatest(1, CAST(ceil(quota / tokens) AS BIGINT)) AS passes FROM q),
db AS (SELECT d.*, h % blocks AS block FROM d JOIN r USING (key)),
bt AS (SELECT key, block, sum(n) AS b_tokens FROM db GROUP BY key, block),
bp AS (SELECT bt.*, r.tokens, r.quota, r.weight, r.alpha, unnest(range(passes)) AS pass FROM bt JOIN r USING (key)),
bs AS (SELECT *, pass * tokens + coalesce(sum(b_tokens) OVER (PARTITION BY key, pass ORDER BY md5('0|' || pass || '|' || key || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_start FROM bp),
o AS (
  SELECT doc_id, source, pass, quota, n, weight, alpha, quota >= (pass + 1) * tokens AS whole,
         b_start + coalesce(sum(n) OVER (PARTITION BY key, pass, block ORDER BY md5('0|' || pass || '|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM db JOIN bs USING (key, block) WHERE quota >= (pass + 1) * tokens OR b_start < greatest(quota, 1))
SELECT doc_id, source, CAST(pass AS INTEGER) AS pass, CAST(start AS BIGINT) AS start, CAST(n AS BIGINT) AS n_tokens, round(weight, 9) AS weight, round(alpha, 9) AS alpha
FROM o WHERE whole OR start < greatest(quota, 1)
""",
    "op9_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
x AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 12], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS first_id FROM x GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM x JOIN m USING (h) WHERE doc_id > first_id),
r AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string([w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(gone, j)], ' ') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
""",
    "op4_arc_warc": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""",
}
