"""Search queries over ``documents``, ``benchmark`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25, expand, ranking, text
from ..sources import readers

K = 6

# Fixed values of the queries below: intents with their triggers, and words that call for more context.
TRIGGERS = [
    (1, "edition", "print label report"),
    (1, "report", "print label report"),
    (2, "attention", "alert notify mail"),
    (3, "erent", "current state value"),
    (3, "tion of", "current state value"),
    (4, "nding", "search find lookup"),
]
NAME = "(?:^|[^A-Za-z])([A-Z][a-z]{3,})"
MARKERS = ["tion", "the ", "and ", "ing ", "er", "under", "ed "]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding"))


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries of the dense branch: the vectors whose ids are items of the benchmark."""
    return vectors(spark, sf_dir).join(questions(spark, sf_dir).select(F.col("query_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding")


def bm25_topk(spark, sf_dir):
    return bm25.bm25_topk(documents(spark, sf_dir), questions(spark, sf_dir))


def dense_topk(spark, sf_dir):
    return ranking.cosine_topk(vectors(spark, sf_dir), _asked_vectors(spark, sf_dir))


def _lists(spark, sf_dir):
    lexical = bm25.bm25_topk(documents(spark, sf_dir), questions(spark, sf_dir), 6 * K)
    dense = ranking.cosine_topk(vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), 6 * K)
    return dense.select("query_id", F.lit(0).alias("source"), "rank", "id").unionByName(lexical.select("query_id", F.lit(1).alias("source"), "rank", F.col("doc_id").alias("id")))


def rrf_fusion(spark, sf_dir):
    return ranking.rrf(_lists(spark, sf_dir)).select("query_id", "id", "score")


def _boosted(spark, sf_dir):
    docs = documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.contains("text", F.lit("Ouwhea")).alias("named"), (F.col("lang") == "fr").alias("preferred"), (F.length("text") > 2000).alias("signed")
    )
    return ranking.boost(ranking.rrf(_lists(spark, sf_dir)).join(docs, "id"), K)


def boosted_rank(spark, sf_dir):
    return _boosted(spark, sf_dir).select("query_id", "id", "score", "position", "fused_position")


def hybrid_search(spark, sf_dir):
    """Exact rows (the document of the item's own number, score 1), then the fused ones, then edge-loaded."""
    exact = questions(spark, sf_dir).join(documents(spark, sf_dir).select(F.col("doc_id").alias("query_id")), "query_id", "left_semi")
    exact = exact.select("query_id", F.col("query_id").alias("id"), F.lit(1.0).alias("score"), F.lit(1).cast("long").alias("position"))
    ranked = ranking.exact_then_fused(exact, _boosted(spark, sf_dir), K)
    return ranking.edge_load(ranked).select("query_id", "place", "id", "score")


def expand_query(spark, sf_dir):
    triggers = readers.inline(spark, TRIGGERS, "intent_id INT, trigger STRING, expansion STRING")
    return expand.expand(questions(spark, sf_dir), triggers).select("query_id", "expanded")


def known_name_detect(spark, sf_dir):
    first = documents(spark, sf_dir).select(F.regexp_extract("text", NAME, 1).alias("name")).filter("name <> ''")
    return expand.known_name(questions(spark, sf_dir), first)


def adaptive_k(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", ranking.adaptive_k(F.col("text"), MARKERS, K).cast("long").alias("k"))


def search_terms(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", text.terms(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ").cast("binary")).alias("terms_md5"))


_BM25 = """
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents),
s AS (SELECT count(*) AS n, avg(CAST(len(words) AS DOUBLE)) AS avgdl FROM w),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS term FROM w) GROUP BY term),
r AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, s),
m AS (SELECT avg(raw) AS mean FROM r),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM w) GROUP BY ALL),
c AS (SELECT query_id, doc_id, round(sum(qtf * (CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
      FROM p JOIN q USING (term) JOIN r USING (term), m, s GROUP BY ALL),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM c WHERE score > 0)"""
_DENSE = """
dn AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
dk AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM dn)"""
_RRF = f"""{_BM25}, {_DENSE},
li AS (SELECT query_id, 0 AS source, rank, id FROM dk WHERE rank <= 36 UNION ALL SELECT query_id, 1, rank, doc_id FROM k WHERE rank <= 36),
fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (25 + rank)), 9) AS score, min({{'s': source, 'r': rank}}) AS first FROM li GROUP BY ALL)"""
_BOOST = f"""{_RRF},
fp AS (SELECT fu.*, contains(text, 'Ouwhea') AS named, lang = 'fr' AS preferred, length(text) > 2000 AS signed,
   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first.s, first.r, id) AS fused_position FROM fu JOIN documents ON doc_id = id),
bo AS (SELECT query_id, id, fused_position, round(score * (CASE WHEN named THEN 1.12::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN preferred THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN signed THEN 1.04::DOUBLE ELSE 1.0::DOUBLE END), 9) AS score FROM fp WHERE fused_position <= 12),
bp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_position) AS position FROM bo)"""
_fold = "regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')"

ORACLE = {
    "bm25_topk": f"WITH {_BM25} SELECT * FROM k WHERE rank <= 10",
    "dense_topk": f"WITH {_DENSE} SELECT * FROM dk WHERE rank <= 10",
    "rrf_fusion": f"WITH {_RRF} SELECT query_id, id, score FROM fu",
    "boosted_rank": f"WITH {_BOOST} SELECT query_id, id, score, position, fused_position FROM bp",
    "hybrid_search": f"""WITH {_BOOST},
ex AS (SELECT item_id AS query_id, item_id AS id, 1.0::DOUBLE AS score FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents)),
al AS (SELECT query_id, id, score, 0 AS stage, 1 AS position FROM ex UNION ALL SELECT query_id, id, score, 1, position FROM bp ANTI JOIN ex USING (query_id, id)),
po AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY stage, position, id) AS position FROM al),
cu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM po WHERE position <= 6)
SELECT query_id, CASE WHEN n <= 2 THEN position WHEN r = 1 THEN 1 WHEN r = 2 THEN n ELSE r - 1 END AS place, id, score FROM cu""",
    "expand_query": f"""WITH t(intent_id, trigger, expansion) AS (VALUES {", ".join(map(repr, TRIGGERS))}),
h AS (SELECT DISTINCT item_id, intent_id, expansion FROM benchmark, t WHERE contains(lower(text), trigger)
  OR (NOT contains(trigger, ' ') AND length(trigger) >= 6 AND contains(lower(text), trigger[1 : greatest(6, CAST(floor(length(trigger) * 0.8) AS INT))])))
SELECT item_id AS query_id, concat_ws(' ', text, (SELECT string_agg(expansion, ' ' ORDER BY intent_id) FROM h WHERE h.item_id = b.item_id)) AS expanded FROM benchmark b""",
    "known_name_detect": f"""WITH n AS (SELECT DISTINCT regexp_extract(text, '{NAME}', 1) AS name FROM documents),
w AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM benchmark)
SELECT query_id, name FROM w JOIN n USING (name) WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, name) = 1""",
    "adaptive_k": f"""SELECT item_id AS query_id, CAST(CASE WHEN n >= 5 THEN 10 WHEN n >= 3 THEN 8 ELSE 6 END AS BIGINT) AS k
FROM (SELECT item_id, {" + ".join(f"CAST(contains(lower(text), '{m}') AS INT)" for m in MARKERS)} AS n FROM benchmark)""",
    "search_terms": f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9À-ɏ_\\-]+'), lambda x: {{'l': lower(x), 'p': regexp_extract_all(x, '[A-Z][a-z0-9]+|[a-zÀ-ɏ]+|[0-9]+')}}) AS ws FROM documents),
t AS (SELECT doc_id, flatten(list_transform(ws, lambda x: list_concat([x.l], CASE WHEN {_fold.format("x.l")} <> x.l THEN [{_fold.format("x.l")}] ELSE [] END,
  CASE WHEN len(x.p) > 1 THEN flatten(list_transform(x.p, lambda y: [lower(y), {_fold.format("lower(y)")}])) ELSE [] END))) AS t FROM w)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, md5(coalesce(array_to_string(t, ' '), '')) AS terms_md5 FROM t""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
