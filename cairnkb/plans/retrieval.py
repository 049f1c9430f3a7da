"""Queries around retrieval: accent-aware ranking, filters, the hybrid search end to end, context blocks and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bm25, context, expand, ranking, text
from ..sources import readers
from . import search

# Fixed values of the queries below: synonyms by name, and profiles by keyword.
SYNONYMS = [("Ouwhea", "spring water"), ("Ouw", "short form"), ("Te", "article"), ("Le", "article"), ("Der", "article")]
PROFILES = [("reporting", ["edition", "report", "label"]), ("alerting", ["attention", "alert"]), ("reading", ["the", "and"])]
NAME = search.NAME


def _named(spark, sf_dir):
    """Documents with the first name that they hold, and its first three letters as the bare name."""
    return search.documents(spark, sf_dir).withColumns({"name": F.regexp_extract("text", NAME, 1)}).withColumn("bare", F.left("name", F.lit(3)))


def synonym_text(spark, sf_dir):
    rows = _named(spark, sf_dir).withColumn("search_text", F.coalesce("text", F.lit("")))
    out = context.with_synonyms(rows, readers.inline(spark, SYNONYMS, "name STRING, words STRING"), "name", "bare", "search_text")
    return out.select("doc_id", F.md5(F.col("search_text").cast("binary")).alias("text_md5"))


def bm25_terms(spark, sf_dir):
    """BM25 over accent-folded, split terms."""
    return bm25.bm25_topk(search.documents(spark, sf_dir), search.questions(spark, sf_dir), tokenize=text.terms)


def _by_language(spark, sf_dir):
    langs = search.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"))
    vectors = search.vectors(spark, sf_dir).join(langs, "id")
    asked = vectors.join(search.questions(spark, sf_dir).select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")
    return vectors, asked.withColumnRenamed("id", "query_id")


def filtered_dense(spark, sf_dir):
    """The nearest vectors of the question's own language."""
    vectors, asked = _by_language(spark, sf_dir)
    return ranking.cosine_topk(vectors, asked, 6, within=("lang",))


def exact_by_name(spark, sf_dir):
    known = search.known_name_detect(spark, sf_dir)
    return context.exact_rows(known, _named(spark, sf_dir).filter("name <> ''").select(F.col("doc_id").alias("id"), "name"))


def secondary_names(spark, sf_dir):
    """Known names of the question and of its expansion, the two that matter most."""
    asked = search.expand_query(spark, sf_dir).join(search.questions(spark, sf_dir), "query_id")
    every = asked.select("query_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("expanded", F.lit("[A-Za-z0-9_]+"), 0))).alias("name"))
    words = every.select("query_id", "name", F.array_contains(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), 0), F.col("name")).alias("original"))
    return context.other_names(words, _named(spark, sf_dir).filter("name <> ''").select("name"))


def hybrid_full(spark, sf_dir):
    """Expansion, name detection, exact rows of the question's name and of its further ones, both rankings, fusion, a filter by category, boosts, edge loading."""
    k = search.K
    docs = search.documents(spark, sf_dir)
    lexical = bm25.bm25_topk(docs, search.expand_query(spark, sf_dir).select("query_id", F.col("expanded").alias("text")), 6 * k)
    dense = ranking.cosine_topk(search.vectors(spark, sf_dir), search._asked_vectors(spark, sf_dir), 6 * k)
    lists = dense.select("query_id", F.lit(0).alias("source"), "rank", "id").unionByName(lexical.select("query_id", F.lit(1).alias("source"), "rank", F.col("doc_id").alias("id")))
    known = search.known_name_detect(spark, sf_dir)
    about = _named(spark, sf_dir).filter("text is not null and coalesce(lang, '') <> 'de'").select(F.col("doc_id").alias("id"), "name", (F.col("lang") == "fr").alias("preferred"), (F.length("text") > 2000).alias("signed"))
    fused = ranking.rrf(lists).join(about, "id").join(known.withColumnRenamed("name", "_known"), "query_id", "left")
    boosted = ranking.boost(fused.withColumn("named", F.coalesce(F.col("name") == F.col("_known"), F.lit(False))), k)
    exact = context.named_exact(known, secondary_names(spark, sf_dir), _named(spark, sf_dir).filter("name <> ''").select(F.col("doc_id").alias("id"), "name"))
    ranked = ranking.exact_then_fused(exact, boosted, k)
    return ranking.edge_load(ranked).select("query_id", "place", "id", "score")


def context_blocks(spark, sf_dir):
    """Each question's best documents as the blocks an answer is made from."""
    top = search.bm25_topk(spark, sf_dir).join(search.documents(spark, sf_dir), "doc_id")
    made = context.block(F.col("rank"), F.concat_ws(" — ", "lang", "doc_id"), F.regexp_extract("text", NAME, 1), F.col("text"), F.col("score"))
    return top.select("query_id", "rank", F.md5(made.cast("binary")).alias("block_md5"))


def answer_sources(spark, sf_dir):
    """Each question's first three sources, as labels with rounded scores."""
    top = search.bm25_topk(spark, sf_dir).filter("rank <= 3").join(search.documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    label = context.source_label(F.concat_ws(" — ", "lang", F.concat(F.lit("document "), "doc_id"), F.lit("whole")))
    return top.select("query_id", "rank", label.alias("label"), F.round("score", 3).alias("score"), F.right(label, F.lit(8)).alias("short"))


def hint_names(spark, sf_dir):
    """The first three different names of each question's eight best documents."""
    top = search.bm25_topk(spark, sf_dir).filter("rank <= 8").join(_named(spark, sf_dir).select("doc_id", "name"), "doc_id")
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])
    return top.groupBy("query_id").agg(F.array_join(ranking.distinct_first(names, 3), ", ").alias("names"))


def skill_profiles(spark, sf_dir):
    words = bm25.tokens(F.col("text"))
    return search.questions(spark, sf_dir).select("query_id", context.profile(words, PROFILES, "general").alias("profile"))


_NAMES = f"nd AS (SELECT doc_id, text, lang, coalesce(regexp_extract(text, '{NAME}', 1), '') AS name FROM documents)"
_KNOWN = """kw AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM benchmark),
kn AS (SELECT query_id, name FROM kw JOIN (SELECT DISTINCT name FROM nd WHERE name <> '') USING (name) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, name) = 1)"""
_EXACT = """ex AS (SELECT query_id, doc_id AS id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS position FROM kn JOIN nd USING (name) QUALIFY position <= 3)"""
_OTHER = """sw AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(expanded, '[A-Za-z0-9_]+')) AS name, regexp_extract_all(text, '[A-Za-z0-9_]+') AS own FROM xq JOIN benchmark ON item_id = query_id),
ox AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY length(name) + CASE WHEN list_contains(own, name) THEN 20 ELSE 0 END DESC, name) AS position
  FROM sw WHERE name IN (SELECT name FROM nd WHERE name <> '') QUALIFY position <= 2),
tu AS (SELECT query_id, name, 0 AS turn FROM kn UNION ALL SELECT ox.query_id, ox.name, ox.position FROM ox LEFT JOIN kn USING (query_id) WHERE ox.name IS DISTINCT FROM kn.name),
ex AS (SELECT query_id, id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY first_at, id) AS position FROM
  (SELECT query_id, doc_id AS id, min({'t': turn, 'p': place}) AS first_at FROM (SELECT query_id, turn, doc_id, row_number() OVER (PARTITION BY query_id, name ORDER BY doc_id) AS place FROM tu JOIN nd USING (name)) WHERE place <= 3 GROUP BY ALL))"""
_EXPANDED = "xq AS (" + search.ORACLE["expand_query"].replace("WITH t(intent_id", "WITH tt(intent_id").replace("FROM benchmark, t WHERE", "FROM benchmark, tt WHERE") + ")"
_FULL_BM25 = search._BM25.replace("unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)", "unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM (SELECT query_id AS item_id, expanded AS text FROM xq))")
_TERMS = search.ORACLE["search_terms"].split("t AS (SELECT doc_id")[1].split(" FROM w)")[0].removeprefix(", ")


def _terms_sql(table: str, key: str) -> str:
    return f"""(SELECT {key}, {_TERMS.split(" AS t")[0]} AS words FROM (SELECT {key}, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9À-ɏ_\\-]+'), lambda x: {{'l': lower(x), 'p': regexp_extract_all(x, '[A-Z][a-z0-9]+|[a-zÀ-ɏ]+|[0-9]+')}}) AS ws FROM {table}))"""


_TERM_BM25 = search._BM25.replace("(SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents)", _terms_sql("documents", "doc_id")).replace(
    "(SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)", "(SELECT item_id AS query_id, unnest(words) AS term FROM " + _terms_sql("benchmark", "item_id") + ")"
)

ORACLE = {
    "synonym_text": f"""WITH {_NAMES}, sy(name, words) AS (VALUES {", ".join(map(repr, SYNONYMS))})
SELECT doc_id, md5(concat_ws(' ', coalesce(text, ''), coalesce(a.words, b.words))) AS text_md5 FROM nd LEFT JOIN sy a ON nd.name = a.name LEFT JOIN sy b ON nd.name[1:3] = b.name""",
    "bm25_terms": f"WITH {_TERM_BM25} SELECT * FROM k WHERE rank <= 10",
    "filtered_dense": """WITH e AS (SELECT vec_id AS id, embedding, coalesce(lang, '') AS lang FROM embeddings JOIN documents ON vec_id = doc_id),
s AS (SELECT q.id AS query_id, e.id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM e, e q WHERE e.lang = q.lang AND q.id IN (SELECT item_id FROM benchmark)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM s) SELECT * FROM r WHERE rank <= 6""",
    "exact_by_name": f"WITH {_NAMES}, {_KNOWN}, {_EXACT} SELECT * FROM ex",
    "secondary_names": f"""WITH {_NAMES}, {_EXPANDED},
w AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(expanded, '[A-Za-z0-9_]+')) AS name, regexp_extract_all(text, '[A-Za-z0-9_]+') AS own FROM xq JOIN benchmark ON item_id = query_id)
SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY length(name) + CASE WHEN list_contains(own, name) THEN 20 ELSE 0 END DESC, name) AS position
FROM w WHERE name IN (SELECT name FROM nd WHERE name <> '') QUALIFY position <= 2""",
    "hybrid_full": f"""WITH {_NAMES}, {_KNOWN}, {_EXPANDED}, {_OTHER}, {_FULL_BM25}, {search._DENSE},
li AS (SELECT query_id, 0 AS source, rank, id FROM dk WHERE rank <= 36 UNION ALL SELECT query_id, 1, rank, doc_id FROM k WHERE rank <= 36),
fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (25 + rank)), 9) AS score, min({{'s': source, 'r': rank}}) AS first FROM li GROUP BY ALL),
fp AS (SELECT fu.*, coalesce(nd.name = kn.name, false) AS named, lang = 'fr' AS preferred, length(text) > 2000 AS signed,
   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first.s, first.r, id) AS fused_position FROM fu JOIN nd ON doc_id = id LEFT JOIN kn USING (query_id) WHERE text IS NOT NULL AND coalesce(lang, '') <> 'de'),
bo AS (SELECT query_id, id, fused_position, round(score * (CASE WHEN named THEN 1.12::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN preferred THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN signed THEN 1.04::DOUBLE ELSE 1.0::DOUBLE END), 9) AS score FROM fp WHERE fused_position <= 12),
bp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_position) AS position FROM bo),
al AS (SELECT query_id, id, score, 0 AS stage, position FROM ex UNION ALL SELECT query_id, id, score, 1, position FROM bp ANTI JOIN ex USING (query_id, id)),
po AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY stage, position, id) AS position FROM al),
cu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM po WHERE position <= 6)
SELECT query_id, CASE WHEN n <= 2 THEN position WHEN r = 1 THEN 1 WHEN r = 2 THEN n ELSE r - 1 END AS place, id, score FROM cu""",
    "context_blocks": f"""WITH {search._BM25} SELECT query_id, rank, md5(concat_ws(chr(10), '[' || rank || '] ' || concat_ws(' — ', lang, CAST(doc_id AS VARCHAR)) || ' (' || format('{{:.3f}}', score) || ')', nullif(regexp_extract(text, '{NAME}', 1), ''), text)) AS block_md5
FROM k JOIN documents USING (doc_id) WHERE rank <= 10""",
    "answer_sources": f"""WITH {search._BM25}, l AS (SELECT query_id, rank, array_to_string(string_split(concat_ws(' — ', lang, 'document ' || doc_id, 'whole'), ' — ')[1:2], ' — ') AS label, score FROM k JOIN documents USING (doc_id) WHERE rank <= 3)
SELECT query_id, rank, label, round(score, 3) AS score, right(label, 8) AS short FROM l""",
    "hint_names": f"""WITH {_NAMES}, {search._BM25}, t AS (SELECT query_id, rank, name FROM k JOIN nd USING (doc_id) WHERE rank <= 8),
g AS (SELECT query_id, name, min(rank) AS r FROM t WHERE name <> '' GROUP BY query_id, name), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r) <= 3)
SELECT q.query_id, coalesce(n.names, '') AS names FROM (SELECT DISTINCT query_id FROM t) q LEFT JOIN (SELECT query_id, string_agg(name, ', ' ORDER BY r) AS names FROM f GROUP BY query_id) n USING (query_id)""",
    "skill_profiles": f"""SELECT item_id AS query_id, CASE {" ".join(f"WHEN len(list_intersect(w, {keys})) > 0 THEN '{name}'" for name, keys in PROFILES)} ELSE 'general' END AS profile
FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM benchmark)""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
