"""Stems by the published sample, and small cases of reports, cache entries, ownership and prefixed names."""

import pytest
from cairnkb.functions import stem
from cairnkb.operators import accounts, context, knowledge, rules, text
from pyspark.sql import functions as F

# Words and stems of the sample that the description is published with, as remembered: the sample itself is not at hand.
SAMPLE = """continu continu, continua continu, continuait continu, continuant continu, continuation continu, continue continu, continué continu,
continuel continuel, continuelle continuel, continuellement continuel, continuera continu, continuité continu, continuons continuon, contorsions contors,
contournait contourn, contractée contract, contradictoirement contradictoir, contraindre contraindr, contraintes contraint, mains main,
maintenaient mainten, maintenant mainten, maintenue maintenu, maires mair, mairie mair, maison maison, maîtresses maîtress, majestueusement majestu,
majestueux majestu, majeure majeur, majorité major, malades malad, maladive malad"""


@pytest.mark.parametrize("pair", SAMPLE.replace("\n", " ").split(", "))
def test_sample(pair):
    word, stemmed = pair.split()
    assert stem.stem(word) == stemmed


def test_odd_words():
    for word in ["", "a", "é", "qu", "yy", "naïve", "œuvre", "guë", "par", "ièrement", "s", "ss", "quiquiquiqui"]:
        assert isinstance(stem.stem(word), str)


def test_stemmed_terms(spark):
    rows = spark.createDataFrame([("Continuait GetMaisons maisons",), (None,), ("",)], "t string")
    got = [r[0] for r in rows.select(text.stemmed_terms(F.col("t"))).collect()]
    assert got[1:] == [[], []]
    assert {"continuait", "continu", "maisons", "maison"} <= set(got[0])
    words = {r.word: r.stem for r in stem.stemmed(spark.createDataFrame([("mains",), ("mains",), (None,)], "word string")).collect()}
    assert words == {"mains": "main"}


def test_cached(spark):
    entry = lambda ts, said: f'{{"ts": {ts}, "response": "{said}", "docs": ["d"]}}'
    rows = [("a", entry(100, "old")), ("a", entry(200, "new")), ("a", '{"ts": 300, "resp'), ("b", entry(10, "stale")), ("c", None), ("d", '{"ts": 150}')]
    got = knowledge.cached(spark.createDataFrame(rows, "key string, raw string"), F.lit(250.0), 100).collect()
    assert [(r.key, r.response, r.docs) for r in got] == [("a", "new", ["d"])]


def test_owned_and_urgent(spark):
    convs = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "user_id int, conv_id int")
    asked = spark.createDataFrame([(1, 10), (1, 20), (1, 99), (None, 30)], "user_id int, conv_id int")
    assert [r.found for r in sorted(accounts.owned(asked, convs).collect(), key=lambda r: (r.conv_id, str(r.user_id)))] == [True, False, False, False]
    got = [r[0] for r in spark.createDataFrame([("high",), ("low",), (None,), ("critical",)], "p string").select(knowledge.is_urgent(F.col("p"))).collect()]
    assert got == [True, False, False, True]


def test_reports(spark):
    issue = "array<struct<rule_id: string, severity: string, message: string, line: long, excerpt: string>>"
    rows = spark.createDataFrame([([("a", "INFO", "hint", 3, ""), ("b", "ERROR", "bad", 7, ""), ("c", "ERROR", "worse", None, "")],), ([],)], f"i {issue}")
    words = {"ERROR": "error(s)", "WARNING": "warning(s)", "INFO": "hint(s)"}
    got = [r[0] for r in rows.select(rules.lint_markdown(F.col("i"), words, "clean")).collect()]
    assert got == ["2 error(s)\n\n**error(s)** *(line 7)*: bad\n**error(s)**: worse\n**hint(s)** *(line 3)*: hint", "clean"]
    one = lambda *x: spark.range(1).select(rules.banner(*[F.lit(v) for v in x], "stop")).first()[0]
    assert one("text", "m", "m", "", False) == "text"
    assert one("text", "m", "n", "report", True) == "*(answered by n; m was not available)*\n\ntext\n\n---\nreport\n\nstop"


def test_prefixed_names_and_their_synonyms(spark):
    words = spark.createDataFrame([("OrderTotal", "sum"), ("Total", "all"), ("Order", "request")], "name string, words string")
    keys = {(r.name, r.words) for r in context.bare_keys(words, ["Order", "Result"]).collect()}
    assert keys == {("OrderTotal", "sum"), ("Total", "sum"), ("Total", "all"), ("Order", "request")}
    known = spark.createDataFrame([(1, "Total")], "query_id int, name string")
    others = spark.createDataFrame([(1, "Total", 1), (1, "Sum", 2), (2, "Sum", 1)], "query_id int, name string, position long")
    rows = spark.createDataFrame([(5, "Sum"), (3, "Total"), (4, "Total"), (5, "Total"), (9, "Total")], "id int, name string")
    got = sorted((r.query_id, r.position, r.id) for r in context.named_exact(known, others, rows).collect())
    assert got == [(1, 1, 3), (1, 2, 4), (1, 3, 5), (2, 1, 5)]
