"""Ingest queries: documents put under headings, cut into chunks, described, merged and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knowledge, text
from ..sources import readers

TARGET, LEAST = 700, 60
STOP_WORDS = ["Part", "Notes"]
#: How functions look in the files made below: a line's end with a type, a name and arguments in backticks.
TYPES = ["String", "Number", "Flag"]
SIGNATURE = r"`(\w+ \w+\([^`\n]*\))`\n"
NAME = "^[A-Z][a-z]+[A-Z]"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, text)``: each document as a file with a header, an introduction and two sections."""
    docs = readers.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    body = F.coalesce("text", F.lit(""))
    priority = F.when(F.col("doc_id") % 3 == 0, "high").otherwise("low")
    return docs.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.concat(
            F.lit("---\npriority: "), priority, F.lit("\ntags: ["), F.col("lang"), F.lit(", "), F.col("source"), F.lit("]\n---\nOpening\n## Part one\n"),
            F.replace(body, F.lit("\n"), F.lit("\n\n")), F.lit("\n## GetTotal()\n**Signature**\n`String GetTotal(x)`\n"), F.left(body, F.lit(200)),
        ).alias("text"),
    )


def front_matter(spark, sf_dir):
    """Fields of headers that hold nulls, scalars, lists on a line and lists of lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    even = F.col("doc_id") % 2 == 0
    head = F.concat(
        F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\nabbrev: "), F.when(even, "null").otherwise('"A B"'), F.lit("\ntags:\n"),
        F.lit("  - "), F.col("source"), F.lit("\n  - '"), F.col("lang"), F.lit("'\nlevel: high\nwords: ["), F.col("lang"), F.lit(', "x y", '), F.col("source"), F.lit("]\nempty:\n---\n"), F.col("text"),
    )
    found = docs.select("doc_id", text.front_fields(head).alias("f"), F.md5(text.body(head).cast("binary")).alias("body_md5"))
    return found.select("doc_id", "body_md5", F.explode("f").alias("field", "x")).select("doc_id", "body_md5", "field", "x.kind", F.array_join("x.items", "|").alias("items"))


def _chunks(spark, sf_dir):
    return text.chunks(files(spark, sf_dir), TARGET, LEAST)


def _described(spark, sf_dir):
    return text.features(_chunks(spark, sf_dir), STOP_WORDS, TYPES, SIGNATURE, NAME)


def chunk_sections(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", "path", "section", "ordinal", "priority", "tags", "content_hash", F.length("text").cast("long").alias("n_chars"))


def chunk_features(spark, sf_dir):
    return _described(spark, sf_dir).select("chunk_id", "has_code", "has_signature", "function_name", "signature", "return_type")


def search_texts(spark, sf_dir):
    described = _described(spark, sf_dir)
    found = text.search_text(F.col("text"), F.col("function_name"), F.col("signature"), F.col("tags"))
    return described.select("chunk_id", F.md5(found.cast("binary")).alias("search_md5"))


def ingest_manifest(spark, sf_dir):
    return knowledge.manifest(_described(spark, sf_dir))


def known_names(spark, sf_dir):
    before = spark.createDataFrame([("Before",), ("GetTotal",)], "name string")
    return knowledge.known_names(_described(spark, sf_dir), before)


def ingest_preview(spark, sf_dir):
    """What a dry run shows: the first five chunks, and whether they are urgent."""
    rows = _chunks(spark, sf_dir).withColumn("urgent", knowledge.is_urgent(F.col("priority")))
    return knowledge.preview(rows, "path", "ordinal").select("path", "ordinal", "chunk_id", "urgent")


def _corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prefix = F.when(F.col("doc_id") % 2 == 0, "kb_").otherwise("web_")
    return docs.select(F.concat(prefix, F.col("doc_id").cast("string")).alias("chunk_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content_hash"), "lang")


def additive_ingest(spark, sf_dir):
    """What the odd documents add to the even ones, by content."""
    every = _corpus(spark, sf_dir)
    return knowledge.additive(every.filter(F.col("chunk_id").startswith("web_")), every.filter(F.col("chunk_id").startswith("kb_")))


def corpus_merge(spark, sf_dir):
    """The English rows take the place of all of their prefix; other prefixes stay."""
    every = _corpus(spark, sf_dir)
    new = every.filter(F.col("chunk_id").startswith("kb_") & (F.col("lang") == "en"))
    return knowledge.merged(every, new, "kb_")


def integrity_checks(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return knowledge.violations(rows, {"role": ["user", "assistant"]}, ["conv_id"])


def cache_keys(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    skills = F.array(F.lit("tables"), F.lit("dates"))
    key = knowledge.cache_key(F.col("text"), F.lit("small"), F.lit(6), skills, F.lit("full"), F.col("item_id").cast("string"))
    return asked.select("item_id", key.alias("cache_key"))


def page_texts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.md5(text.html_text(F.col("html")).cast("binary")).alias("text_md5"))


_CHUNKS = f"""
f AS (SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS priority, lang || ' ' || source AS tags, coalesce(text, '') AS t FROM documents),
s AS (SELECT path, priority, tags, 0 AS s, 'intro' AS section, 'Opening' AS body FROM f
  UNION ALL SELECT path, priority, tags, 1, 'Part one', trim('## Part one' || chr(10) || replace(t, chr(10), chr(10) || chr(10)), ' ' || chr(10) || chr(13) || chr(9)) FROM f
  UNION ALL SELECT path, priority, tags, 2, 'GetTotal()', trim('## GetTotal()' || chr(10) || '**Signature**' || chr(10) || '`String GetTotal(x)`' || chr(10) || t[1:200], ' ' || chr(10) || chr(13) || chr(9)) FROM f),
p AS (SELECT path, priority, tags, s, section, list_reduce(
    list_transform(regexp_split_to_array(body, '\\n{{2,}}'), lambda x: {{'done': CAST([] AS VARCHAR[]), 'cur': x, 'n': length(x) + 2}}),
    lambda a, b: CASE WHEN a.n + b.n > {TARGET} THEN {{'done': list_append(a.done, a.cur), 'cur': b.cur, 'n': b.n}}
      ELSE {{'done': a.done, 'cur': a.cur || chr(10) || chr(10) || b.cur, 'n': a.n + b.n}} END) AS r FROM s WHERE length(body) > {TARGET}),
b AS (SELECT path, priority, tags, s, section, unnest(list_append(r.done, r.cur)) AS text, generate_subscripts(list_append(r.done, r.cur), 1) - 1 AS b FROM p
  UNION ALL SELECT path, priority, tags, s, section, body, 0 FROM s WHERE length(body) <= {TARGET}),
c AS (SELECT 'kb_' || md5(path || '::' || section || '::' || CAST(s * 1000 + b AS VARCHAR))[1:16] AS chunk_id, path, section, s * 1000 + b AS ordinal, text, priority, tags
  FROM b WHERE length(trim(regexp_replace(text, '^## [^\\n]*', ''))) >= {LEAST}),
fe AS (SELECT *, contains(text, '```') AS has_code, contains(text, '**Signature**') OR contains(text[1:80], 'Signature') AS has_signature,
  trim(regexp_extract(text, '`(\\w+ \\w+\\([^`\\n]*\\))`\\n', 1)) AS signature FROM c),
fn AS (SELECT *, CASE WHEN section = 'GetTotal()' THEN 'GetTotal' ELSE '' END AS function_name, CASE WHEN split_part(signature, ' ', 1) IN ('String', 'Number', 'Flag') THEN split_part(signature, ' ', 1) ELSE '' END AS return_type FROM fe)"""
_CORPUS = "e AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'kb_' ELSE 'web_' END || doc_id AS chunk_id, md5(coalesce(text, '')) AS content_hash, lang FROM documents)"

ORACLE = {
    "chunk_sections": f"WITH {_CHUNKS} SELECT chunk_id, path, section, CAST(ordinal AS BIGINT) AS ordinal, priority, tags, sha256(text) AS content_hash, length(text) AS n_chars FROM c",
    "front_matter": """WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, md5(coalesce(text, '')) AS body_md5 FROM documents),
v AS (SELECT doc_id, body_md5, unnest([{'f': 'id', 'k': 'scalar', 'i': CAST(doc_id AS VARCHAR)}, {'f': 'abbrev', 'k': CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE 'scalar' END, 'i': CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'A B' END},
  {'f': 'tags', 'k': 'list', 'i': source || '|' || lang}, {'f': 'level', 'k': 'scalar', 'i': 'high'}, {'f': 'words', 'k': 'list', 'i': lang || '|x y|' || source}, {'f': 'empty', 'k': 'null', 'i': ''}]) AS x FROM d)
SELECT doc_id, body_md5, x.f AS field, x.k AS kind, x.i AS items FROM v""",
    "chunk_features": f"WITH {_CHUNKS} SELECT chunk_id, has_code, has_signature, function_name, signature, return_type FROM fn",
    "search_texts": f"""WITH {_CHUNKS} SELECT chunk_id, md5(trim(text || ' ' || CASE WHEN function_name <> '' THEN 'GetTotal GetTotal GetTotal Get Total' ELSE tags END || CASE WHEN signature <> '' THEN ' ' || signature ELSE '' END)) AS search_md5 FROM fn""",
    "ingest_manifest": f"""WITH {_CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT path) AS n_files, count(*) FILTER (function_name <> '') AS n_named,
  CAST(floor(100.0 * count(*) FILTER (has_code) / greatest(count(*), 1)) AS BIGINT) AS code_percent, CAST(floor(100.0 * count(*) FILTER (function_name <> '') / greatest(count(*), 1)) AS BIGINT) AS named_percent FROM fn""",
    "ingest_preview": f"WITH {_CHUNKS} SELECT path, CAST(ordinal AS BIGINT) AS ordinal, chunk_id, priority = 'high' AS urgent FROM c ORDER BY path, ordinal LIMIT 5",
    "known_names": f"WITH {_CHUNKS} SELECT DISTINCT function_name AS name FROM fn WHERE function_name <> '' UNION SELECT unnest(['Before', 'GetTotal'])",
    "additive_ingest": f"WITH {_CORPUS} SELECT * FROM e WHERE starts_with(chunk_id, 'web_') AND content_hash NOT IN (SELECT content_hash FROM e WHERE starts_with(chunk_id, 'kb_'))",
    "corpus_merge": f"WITH {_CORPUS} SELECT * FROM e WHERE starts_with(chunk_id, 'web_') OR lang = 'en'",
    "integrity_checks": """SELECT 'role not allowed' AS "check", count(*) FILTER (role NOT IN ('user', 'assistant')) AS n FROM conversations
UNION ALL SELECT 'conv_id not unique', (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 1))""",
    "cache_keys": "SELECT item_id, sha256('v1|' || trim(text) || '|small|6|dates,tables|full|' || sha256(CAST(item_id AS VARCHAR))[1:12])[1:16] AS cache_key FROM benchmark",
    "page_texts": """SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\n\\r\\t]+', ' ', 'g'))) AS text_md5 FROM pages""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
