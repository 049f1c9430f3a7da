"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, hamming, language, lines, negatives, onebit, packing, secrets, simhash, substrings, suffixes, warc
from .common import documents


def tokenizer_path() -> str:
    """The public tokenizer's vocabulary; PACKING_TOKENIZER names another file."""
    if "PACKING_TOKENIZER" in os.environ:
        return os.environ["PACKING_TOKENIZER"]
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(documents(spark, sf_dir, "doc_id", "text"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(documents(spark, sf_dir, "doc_id", "text"), benchmark).select("doc_id", "contamination.*")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_words(documents(spark, sf_dir, "doc_id", "text"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir, "doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir, "doc_id", "text"))


def op6_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all rows for each row whose id is divisible by 20 (the stated query set)."""
    codes = hamming.with_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hamming.top_k(codes.filter("id % 20 = 0"), codes)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits all pages against a second replica, in which one page of 97 has lost its last character."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    lost = F.pmod("page_id", F.lit(97)) == 13
    html = F.coalesce("html", F.lit(""))
    return warc.fixity_report(pages.withColumn("rotten", F.when(lost, F.left(html, F.length(html) - 1)).otherwise(html)))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = language.with_language(docs, documents(spark, sf_dir, "doc_id", "text", "lang"))
    return found.select("doc_id", language.held_out().alias("held_out"), "language.lang_pred", "language.score", "language.languages")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir, "text", "lang", "source"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("id") % 100 == 0)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffixes,
        op2_decontaminate,
        op3_substrings,
        op4_secrets,
        op5_simhash,
        op6_hamming,
        op7_warc,
        op8_packing,
        op9_language,
        op10_lines,
        op11_divergence,
        op12_negatives,
        op13_neighbours,
    )
}

ORACLE: dict[str, str] = {}

ORACLE["op2_decontaminate"] = r"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS win
       FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
       FROM (SELECT r, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS i FROM d, ns)),
m AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


def _secret_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    gap = "(?s)(.*?)(" + pattern + ")"
    sql = gap.replace("'", "''")
    return f"""
s{rank} AS (SELECT r, {rank} AS rank, '{kind}' AS kind, list_sum(list_slice(a, 1, i)) - f[i] AS start, list_sum(list_slice(a, 1, i)) AS stop
  FROM (SELECT r, list_transform(regexp_extract_all(t, '{sql}', 0), lambda x: length(x)) AS a, list_transform(regexp_extract_all(t, '{sql}', 2), lambda x: length(x)) AS f,
          list_transform(regexp_extract_all(t, '{sql}', {2 + group if group else 2}), lambda x: length(x)) AS g FROM d) x,
       LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i) y WHERE g[i] >= {least})"""


ORACLE["op4_secrets"] = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),"
    + ",".join(_secret_sql(x.kind, i, x.pattern, x.group, x.least) for i, x in enumerate(secrets.RULES))
    + """,
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY start, rank) AS spans
  FROM (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""
)

ORACLE["op10_lines"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, {lines._LAST}) AS doc, CAST('0x' || md5(coalesce(text, ''))[1:15] AS BIGINT) AS k1, CAST('0x' || md5(coalesce(text, ''))[16:30] AS BIGINT) AS k2, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
o AS (SELECT r, {{'doc': doc, 'k1': k1, 'k2': k2, 'no': i}} AS place, ls[i] AS line FROM (SELECT r, doc, k1, k2, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) WHERE regexp_matches(ls[i], '[^\\x20\\x09-\\x0D]')),
f AS (SELECT line, min(place) AS first FROM o GROUP BY line),
e AS (FROM f WHERE length(line) >= {lines.EDIT_CHARS}),
v AS (SELECT line, first, i, hash(line[: i - 1] || line[i + 1 :]) AS h FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS i FROM e)),
s AS (SELECT i, h, min(first) AS first FROM v GROUP BY i, h HAVING count(*) > 1),
near AS (SELECT v.line FROM v JOIN s USING (i, h) WHERE s.first < v.first
   UNION SELECT v.line FROM v JOIN e f ON v.h = hash(f.line) WHERE f.first < v.first
   UNION SELECT f.line FROM v JOIN e f ON v.h = hash(f.line) WHERE v.first < f.first),
g AS (SELECT r, list(CAST(place.no AS BIGINT)) AS gone FROM o JOIN f USING (line) WHERE place <> first OR line IN (FROM near) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ls[i]), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN g USING (r)"""

ORACLE["op3_substrings"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT r, i, array_to_string(w[i + 1 : i + 35], ' ') AS win FROM (SELECT r, w, unnest(range(greatest(0, len(w) - 34))) AS i FROM d)),
c AS (SELECT win FROM v GROUP BY win HAVING count(*) > 1),
g AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(i + 1, i + 36)) AS p FROM v SEMI JOIN c USING (win)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(CASE WHEN gone IS NULL THEN range(1, len(w) + 1) ELSE list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)) END, lambda i: w[i]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)"""

ORACLE["op6_hamming"] = """
WITH b AS (SELECT DISTINCT vec_id AS id, list_reduce(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS UBIGINT) << ((i - 1) % 64) ELSE CAST(0 AS UBIGINT) END), lambda x, y: x | y) AS code
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
p AS (SELECT q.id AS query_id, r.id, CAST(bit_count(xor(q.code, r.code)) AS BIGINT) AS distance FROM b q, b r WHERE q.id % 20 = 0 AND q.id <> r.id),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM p)
SELECT * FROM k WHERE rank <= 10"""

_RECORD = (
    "'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Target-URI: ' || url || nl || 'Content-Type: text/html' || nl || "
    "'Content-Length: ' || CAST(strlen({body}) AS VARCHAR) || nl || nl || {body} || nl || nl"
)


def _nodes(table: str, below: str) -> str:
    return f"{table} AS (SELECT archive, seq // 16 AS seq, sha256(string_agg(a, '' ORDER BY seq)) AS a, sha256(string_agg(b, '' ORDER BY seq)) AS b, sha256(string_agg(ra, '' ORDER BY seq)) AS ra, sha256(string_agg(rb, '' ORDER BY seq)) AS rb FROM {below} GROUP BY ALL)"


ORACLE["op7_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl,
  CASE WHEN page_id % 97 = 13 THEN left(coalesce(html, ''), greatest(0, length(coalesce(html, '')) - 1)) ELSE coalesce(html, '') END AS rotten FROM pages),
h AS (SELECT page_id, url, sha256({_RECORD.format(body="html")}) AS a, sha256({_RECORD.format(body="rotten")}) AS b, strlen({_RECORD.format(body="html")}) AS n, strlen({_RECORD.format(body="rotten")}) AS nb FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, url, a) - 1 AS rank FROM h),
k AS (SELECT page_id, a, b, n, nb, rank // 1000 AS archive, rank % 1000 AS seq, CAST(sum(n) OVER (PARTITION BY rank // 1000 ORDER BY rank) AS BIGINT) AS stop, CAST(sum(nb) OVER (PARTITION BY rank // 1000 ORDER BY rank) AS BIGINT) AS stop_b FROM r),
l0 AS (SELECT *, sha256((stop - n) || '-' || stop) AS ra, sha256((stop_b - nb) || '-' || stop_b) AS rb FROM k),
{_nodes("l1", "l0")}, {_nodes("l2", "l1")}, {_nodes("l3", "l2")}
SELECT archive, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_bytes, any_value(l3.a) AS root, any_value(l3.b) AS replica_root,
  count(*) FILTER (l0.a <> l0.b) AS n_bad, coalesce(string_agg(coalesce(CAST(page_id AS VARCHAR), ''), ',' ORDER BY l0.seq) FILTER (l0.a <> l0.b), '') AS bad_ids,
  coalesce(string_agg(CAST(stop - n AS VARCHAR) || '-' || CAST(stop AS VARCHAR), ',' ORDER BY l0.seq) FILTER (l0.a <> l0.b), '') AS bad_ranges,
  any_value(l3.ra) AS index_root, any_value(l3.rb) AS replica_index_root, count(*) FILTER (stop <> stop_b OR stop - n <> stop_b - nb) AS n_moved
FROM l0 JOIN l3 USING (archive) GROUP BY archive"""

_TERM = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE["op11_divergence"] = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERM} AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(w) AS t FROM d) SEMI JOIN k USING (lang, t) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.t, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
p AS (SELECT lang, source, t, n, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM x),
ql AS (SELECT lang, t, sum(n) AS n FROM x GROUP BY ALL),
q AS (SELECT lang, t, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM ql),
v AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
      UNION ALL SELECT lang, source, 'term', t, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10"""

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLE["op12_negatives"] = f"""
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5"""

ORACLE["op13_neighbours"] = f"""
WITH r AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {_WHOLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score FROM r a JOIN r b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM k WHERE rank <= 20"""
