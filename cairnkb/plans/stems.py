"""Stemmed terms of the documents and of the questions, and ranking by them; the SQL goes by CASE over the same rule data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stem
from ..operators import bm25, text
from . import retrieval, search


def stemmed_terms(spark, sf_dir):
    """The distinct lower-case words of all documents and questions, and their stems."""
    every = search.documents(spark, sf_dir).select("text").unionByName(search.questions(spark, sf_dir).select("text"))
    words = every.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-zà-ÿœæ]+"), 0)).alias("word"))
    return stem.stemmed(words)


def bm25_stems(spark, sf_dir):
    """BM25 over folded, split and stemmed terms."""
    return bm25.bm25_topk(search.documents(spark, sf_dir), search.questions(spark, sf_dir), tokenize=text.stemmed_terms)


_V = stem.VOWELS


def _ends(word: str, endings: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN suffix({word}, '{e}') THEN '{e}'" for e in sorted(endings, key=len, reverse=True)) + " ELSE '' END"


def _cut(word: str, ending: str) -> str:
    return f"left({word}, length({word}) - length({ending}))"


def _after(group: str) -> str:
    """What stands before the ending, with what is looked at after it has gone."""
    out = []
    for more, inside, put, other in stem.AFTER[group]:
        if more in ("ativ", "icat"):
            inner = {"ativ": ("iv", "''", "b"), "icat": ("at", "'iqU'", "left(b, length(b) - 4) || 'iqU'")}[more]
            less = "left(b, length(b) - 2)" if more == "ativ" else inner[2]
            out.append(f"WHEN suffix(b, '{more}') THEN CASE WHEN length(b) - 4 >= r2 THEN left(b, length(b) - 4) WHEN length(b) - 2 >= r2 THEN {less} ELSE b END")
            continue
        n, at = len(more), {"R2": "r2", "RV": "rv", "R1": "r1"}[inside]
        second = f" WHEN length(b) - {n} >= {({'': '0', 'R1': 'r1'})[other[0]]} THEN left(b, length(b) - {n}) || '{other[1]}'" if other else ""
        out.append(f"WHEN suffix(b, '{more}') THEN CASE WHEN length(b) - {n} >= {at} THEN left(b, length(b) - {n}) || '{put}'{second} ELSE b END")
    return "CASE " + " ".join(out) + " ELSE b END"


def stem_sql(words: str) -> str:
    """CTEs that make ``fin(word, stem)`` of a table ``words(word)``."""
    vowel = lambda x: f"({x} <> '' AND contains('{_V}', {x}))"
    endings = {e: names.split()[0] for names in stem.STANDARD for e in names.split()}
    group = "CASE " + " ".join(f"WHEN e IN ({', '.join(repr(x) for x in names.split())}) THEN '{names.split()[0]}'" for names in stem.STANDARD) + " ELSE '' END"
    at = {"": "0", "RV": "rv", "R1": "r1", "R2": "r2"}
    plain = " ".join(f"WHEN g = '{n.split()[0]}' THEN CASE WHEN length(b) >= {at[r]} THEN b || '{put}' ELSE m END" for n, (r, put) in stem.STANDARD.items() if n.split()[0] not in ("ance", "atrice", "ement", "ité", "if", "euse", "issement", "ment"))
    looked = " ".join(f"WHEN g = '{g}' THEN CASE WHEN length(b) >= {'rv' if g == 'ement' else 'r2'} THEN {_after(a)} ELSE m END" for g, a in (("atrice", "ation"), ("ement", "ement"), ("ité", "ité"), ("if", "if")))
    return f"""
mk AS (SELECT word, list_reduce(list_concat([''], string_split(word, '')), lambda a, c, i: a || CASE
   WHEN (c IN ('i', 'u') AND {vowel("right(a, 1)")} AND {vowel("substr(word, i, 1)")}) OR (c = 'y' AND ({vowel("right(a, 1)")} OR {vowel("substr(word, i, 1)")})) OR (c = 'u' AND right(a, 1) = 'q') THEN upper(c) ELSE c END) AS m FROM {words}),
rg AS (SELECT *, CASE WHEN regexp_matches(m, '^[{_V}]{{2}}|^par|^col|^tap') THEN least(3, length(m)) WHEN regexp_matches(m, '^.[^{_V}]*[{_V}]') THEN length(regexp_extract(m, '^.[^{_V}]*[{_V}]')) ELSE length(m) END AS rv,
   CASE WHEN regexp_matches(m, '[{_V}][^{_V}]') THEN length(regexp_extract(m, '^.*?[{_V}][^{_V}]')) ELSE length(m) END AS r1 FROM mk),
rr AS (SELECT *, r1 + CASE WHEN regexp_matches(substr(m, r1 + 1), '[{_V}][^{_V}]') THEN length(regexp_extract(substr(m, r1 + 1), '^.*?[{_V}][^{_V}]')) ELSE length(m) - r1 END AS r2 FROM rg),
en AS (SELECT *, {_ends("m", list(endings))} AS e FROM rr),
gr AS (SELECT *, {group} AS g, {_cut("m", "e")} AS b FROM en),
s1 AS (SELECT *, CASE WHEN g = '' THEN m
   WHEN g = 'ance' THEN CASE WHEN length(b) >= r2 THEN b ELSE m END
   WHEN g = 'euse' THEN CASE WHEN length(b) >= r2 THEN b WHEN length(b) >= r1 THEN b || 'eux' ELSE m END
   WHEN g = 'issement' THEN CASE WHEN length(b) >= r1 AND NOT {vowel("right(b, 1)")} THEN b ELSE m END
   WHEN g = 'ment' THEN CASE WHEN length(b) - 1 >= rv AND {vowel("right(b, 1)")} THEN b ELSE m END
   {looked} {plain} ELSE m END AS w1 FROM gr),
vi AS (SELECT *, w1 = m OR g IN ('amment', 'emment', 'ment') AS verb, substr(w1, rv + 1) AS v1, {_ends("substr(w1, rv + 1)", stem.VERBS_I.split())} AS ei, {_ends("substr(w1, rv + 1)", ["ions", *stem.VERBS_GO.split(), *stem.VERBS_E.split()])} AS eo FROM s1),
s2 AS (SELECT *, CASE WHEN NOT verb THEN w1
   WHEN ei <> '' AND length(v1) > length(ei) AND NOT {vowel("substr(v1, length(v1) - length(ei), 1)")} THEN {_cut("w1", "ei")}
   WHEN eo = '' OR (eo = 'ions' AND length(w1) - 4 < r2) THEN w1
   WHEN eo IN ({", ".join(repr(x) for x in stem.VERBS_E.split())}) AND suffix({_cut("w1", "eo")}, 'e') AND length({_cut("w1", "eo")}) > rv THEN left(w1, length(w1) - length(eo) - 1)
   ELSE {_cut("w1", "eo")} END AS w2 FROM vi),
s3 AS (SELECT *, CASE WHEN verb THEN w2 <> w1 ELSE true END AS changed, CASE WHEN suffix(w2, 's') AND substr(w2, length(w2) - 1, 1) NOT IN ('a', 'i', 'o', 'u', 'è', 's') THEN left(w2, length(w2) - 1) ELSE w2 END AS ws FROM s2),
s4 AS (SELECT *, CASE WHEN changed THEN regexp_replace(regexp_replace(w2, 'Y$', 'i'), 'ç$', 'c')
   WHEN suffix(substr(ws, rv + 1), 'ion') THEN CASE WHEN length(ws) - 3 >= r2 AND length(ws) - 4 >= rv AND substr(ws, length(ws) - 3, 1) IN ('s', 't') THEN left(ws, length(ws) - 3) ELSE ws END
   WHEN regexp_matches(substr(ws, rv + 1), '[iI]ère$') THEN left(ws, length(ws) - 4) || 'i' WHEN regexp_matches(substr(ws, rv + 1), '[iI]er$') THEN left(ws, length(ws) - 3) || 'i'
   WHEN suffix(substr(ws, rv + 1), 'e') THEN left(ws, length(ws) - 1) WHEN suffix(substr(ws, rv + 1), 'ë') AND suffix(ws, 'guë') THEN left(ws, length(ws) - 1) ELSE ws END AS w4 FROM s3),
fin AS (SELECT word, lower(regexp_replace(CASE WHEN regexp_matches(w4, '(enn|onn|ett|ell|eill)$') THEN left(w4, length(w4) - 1) ELSE w4 END, '[éè]([^{_V}]+)$', 'e\\1')) AS stem FROM s4)"""


_WORDS = "wd AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿœæ]+')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark))"



def _with_stems(name: str, key: str) -> str:
    return f"""{name} AS (SELECT t.{key}, list_concat(words, coalesce(st, [])) AS words FROM {name}_t t LEFT JOIN
  (SELECT {key}, list(DISTINCT stem) AS st FROM (SELECT {key}, words, unnest(words) AS word FROM {name}_t) JOIN fin USING (word) WHERE regexp_full_match(word, '[a-zà-ÿœæ]{{4,}}') AND NOT list_contains(words, stem) GROUP BY {key}) USING ({key}))"""


_RANKED = search._BM25.replace("(SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents)", "(FROM wdoc)").replace(
    "(SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)", "(SELECT item_id AS query_id, unnest(words) AS term FROM wask)"
)
ORACLE = {
    "stemmed_terms": f"WITH {_WORDS}, {stem_sql('wd')} SELECT word, stem FROM fin",
    "bm25_stems": f"""WITH wdoc_t AS {retrieval._terms_sql("documents", "doc_id")}, wask_t AS {retrieval._terms_sql("benchmark", "item_id")},
wd AS (SELECT DISTINCT unnest(words) AS word FROM (SELECT words FROM wdoc_t UNION ALL SELECT words FROM wask_t)), {stem_sql("wd")},
{_with_stems("wdoc", "doc_id")}, {_with_stems("wask", "item_id")}, {_RANKED} SELECT * FROM k WHERE rank <= 10""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
