"""Queries of this package: name -> (spark, folder of Parquet tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodemap.llm import (
    bpe, cap_filters, jaccard_join, langid, licenses, mixing, prefix_trie, quality, resampling, rotated_codes, token_files, toxicity, url_filter,
)
from lodemap.llm.common import bucket_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _held_out(buckets: int, held: int):
    return F.coalesce(bucket_of("doc_id", buckets) == held, F.lit(False)).alias("held_out")


@query
def op1_bpe(spark, folder):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(_documents(spark, folder), ranks, public_tokenizers.PATTERN)


@query
def op2_rotated_codes(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return rotated_codes.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


@query
def op3_licenses(spark, folder):
    docs = _documents(spark, folder)
    return licenses.scan(docs, licenses.fit(docs))


@query
def op4_mixing(spark, folder):
    sized = mixing.written_sizes(_documents(spark, folder))
    taken = mixing.copies(sized, mixing.plan(sized))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op5_jaccard_join(spark, folder):
    return jaccard_join.join(_documents(spark, folder))


ORACLES["op5_jaccard_join"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach AS (
  SELECT doc_id AS root, doc_id AS d FROM documents
  UNION SELECT r.root, b.y FROM reach r JOIN both_ways b ON b.x = r.d
), c AS (SELECT d, min(root) AS component_id FROM reach GROUP BY d)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.d = d.doc_id
"""


@query
def op6_toxicity(spark, folder):
    docs = _documents(spark, folder)
    model = toxicity.split_fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    found = toxicity.toxicity(docs, model)
    return found.select("doc_id", _held_out(3, 1), "score", "predicted")


@query
def op7_token_files(spark, folder):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    manifest, files = token_files.write_corpus(_documents(spark, folder), spec)
    return token_files.read(manifest, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: Fixed values of the query's contract.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


@query
def op8_url_filter(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op8_url_filter"] = """
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a
), c AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM b
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""


@query
def op9_cap_filters(spark, folder):
    return cap_filters.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query
def op10_language_id(spark, folder):
    docs = _documents(spark, folder)
    found = langid.identify(docs, langid.split_fit(docs))
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score")


@query
def op11_quality(spark, folder):
    docs = _documents(spark, folder)
    model = quality.split_fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return quality.quality(docs, model).select("doc_id", _held_out(5, 0), "score", "predicted")


@query
def op12_resampling(spark, folder):
    return resampling.resample(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


#: CRC-32 in SQL: its table by rule, and the digest of a list `b` of bytes.
CRC_TABLE = """(SELECT list(c ORDER BY i) FROM (
  SELECT i, list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), i) AS c FROM (SELECT unnest(range(256)) AS i)))"""
CRC_OF = "xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"

ORACLES["op12_resampling"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), g AS (
  SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark
), f AS (SELECT r, unnest(ws) AS w FROM d
), v AS (
  SELECT w, {CRC_TABLE} AS t, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT w FROM f UNION SELECT w FROM g)
), k AS (SELECT w, {CRC_OF} % 10000 AS bucket FROM v
), s AS (SELECT bucket, count(*) AS n FROM f JOIN k USING (w) GROUP BY 1
), t AS (SELECT bucket, count(*) AS n FROM g JOIN k USING (w) GROUP BY 1
), gain AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
      / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), w AS (SELECT r, sum(gain)::BIGINT AS weight FROM f JOIN k USING (w) JOIN gain USING (bucket) GROUP BY 1
), p AS (
  SELECT d.r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w ON w.r = d.r
), q AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER () AS n FROM p WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM p LEFT JOIN q USING (r)
"""


@query
def op13_prefix_trie(spark, folder):
    return prefix_trie.trie(spark.read.parquet(f"{folder}/conversations.parquet"))


ORACLES["op13_prefix_trie"] = f"""
WITH u AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, {CRC_OF} % 9 AS h FROM (
    SELECT DISTINCT conv_id, {CRC_TABLE} AS t, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS b FROM u)
), z AS (
  SELECT c.conv_id, 0 AS own, p, r, x FROM c JOIN u ON u.conv_id = c.conv_id - c.conv_id % 5 AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, r, x FROM c JOIN u ON u.conv_id = c.conv_id AND p > h
), s AS (
  SELECT c.conv_id, coalesce(k, []) AS k
  FROM c LEFT JOIN (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY own, p) AS k FROM z GROUP BY 1) y ON y.conv_id = c.conv_id
), o AS (SELECT conv_id, d, len(k) AS length, k[1:d] AS k FROM (SELECT conv_id, k, unnest(range(len(k) + 1)) AS d FROM s)
), n AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = (SELECT len(s.k) FROM s WHERE s.conv_id = o.conv_id)), '')) AS ends_sha256
  FROM o GROUP BY k, d
), e AS (SELECT a.*, CASE WHEN a.d > 0 THEN (a.n_convs - 1) * strlen(a.k[a.d].x) ELSE 0 END AS saved, (SELECT count(*) FROM n b WHERE b.d = a.d + 1 AND b.k[1:a.d] = a.k) AS n_children FROM n a
), up AS (SELECT k, d, saved, n_children, unnest(range(d + 1)) AS a FROM e
), tot AS (SELECT k[1:a] AS k, a AS d, sum(saved)::BIGINT AS saved_tokens, sum((n_children = 0)::INT)::BIGINT AS n_leaves FROM up GROUP BY 1, 2)
SELECT e.conv_id, e.d AS depth, q.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, saved_tokens, e.ends_sha256
FROM e JOIN tot ON tot.d = e.d AND tot.k = e.k LEFT JOIN n q ON q.d = e.d - 1 AND q.k = e.k[1:e.d - 1]
"""
