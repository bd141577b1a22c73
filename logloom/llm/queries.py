"""The registered queries: each operator on its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logloom.llm import (
    bpe,
    decontaminate,
    fingerprints,
    jaccard,
    language_id,
    language_model,
    pii,
    ranked_search,
    resampling,
    secrets,
    sharding,
    token_files,
    toxicity,
)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def vocabulary(name: str) -> bytes:
    """A vocabulary file of the driver; about a megabyte, it travels with the tasks."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(read(spark, folder, "documents"))


def op4_bpe_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(read(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(read(spark, folder, "documents"))


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_edited(read(spark, folder, "documents"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = vocabulary("word_bpe_49k.json").decode()
    manifest = token_files.write(read(spark, folder, "documents"), tokenizer, end_id=1)
    return token_files.read(manifest, digest=True)


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_components(read(spark, folder, "documents"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = read(spark, folder, "documents"), read(spark, folder, "benchmark")
    return decontaminate.contaminated(docs, benchmark)


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.by_bytes(sharding.sizes(read(spark, folder, "documents")), shards=40)


def op9_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score(read(spark, folder, "documents"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identified_documents(read(spark, folder, "documents"))


def op10_page_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identified_pages(read(spark, folder, "pages"))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


# Compares all pairs of documents that share a shingle; for small tables.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
      lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE
      WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM g),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT l.y, r.c FROM r JOIN links l ON l.x = r.doc_id)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, m.component_id
FROM g JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

# Holds every document against every item.
SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
i AS (
  SELECT row_number() OVER () AS item, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
m AS (
  SELECT doc, doc_id, 100 - 90 + ((90 * CAST(len(t) AS BIGINT) * s.n) // s.l) AS m, t
  FROM d, s WHERE len(t) > 0),
p AS (
  SELECT doc, doc_id, m, term, count(*) AS tf
  FROM (SELECT doc, doc_id, m, unnest(t) AS term FROM m)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, s GROUP BY term, s.n),
r AS (
  SELECT item, item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) GROUP BY item, item_id, doc, doc_id),
k AS (
  SELECT item_id, doc_id, score,
    CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""

# The CRC byte by byte, once for each distinct feature.
RESAMPLING_SQL = r"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT row_number() OVER () AS doc, doc_id, text, true AS raw FROM documents
  UNION ALL SELECT 0, NULL, text, false FROM benchmark),
w AS (
  SELECT doc, doc_id, raw, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM d),
f AS (
  SELECT doc, raw, unnest(list_concat(w,
      list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
      list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM w),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
b AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2),
      lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
      lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS b
  FROM h, t),
n AS (
  SELECT b, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM f JOIN b USING (f) GROUP BY b),
g AS (
  SELECT b, CAST(floor(1000 * ln((t + 1) * CAST(sum(s) OVER () + 10000 AS DOUBLE)
      / ((s + 1) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS g
  FROM n),
k AS (
  SELECT doc, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight
  FROM f JOIN b USING (f) JOIN g USING (b) WHERE raw GROUP BY doc),
r AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(
      CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN k USING (doc) WHERE raw),
p AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
    (count(*) FILTER (n_words >= 20) OVER ()) * 5 // 100 AS drawn
  FROM r)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank
FROM p
"""

QUERIES = {
    "op1_pii": (op1_pii, None),
    "op2_fingerprints": (op2_fingerprints, None),
    "op3_secrets": (op3_secrets, None),
    "op4_bpe_roundtrip": (op4_bpe_roundtrip, None),
    "op5_token_files": (op5_token_files, None),
    "op6_jaccard_join": (op6_jaccard_join, JACCARD_SQL),
    "op7_decontamination": (op7_decontamination, None),
    "op8_sharding": (op8_sharding, None),
    "op9_language_model": (op9_language_model, None),
    "op10_language_id": (op10_language_id, None),
    "op10_page_language_id": (op10_page_language_id, None),
    "op11_toxicity": (op11_toxicity, None),
    "op12_ranked_search": (op12_ranked_search, SEARCH_SQL),
    "op13_importance_resampling": (op13_importance_resampling, RESAMPLING_SQL),
}
