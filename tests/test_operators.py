"""Small cases of operators and functions, edges first."""

import datetime as dt

from cairnkb.functions import convert, dates, lists, numbers, strings, tags
from cairnkb.operators import bm25, evals, expand, knowledge, monitor, ranking, rules, text, usage
from cairnkb.plans import rulings
from pyspark.sql import functions as F


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def lit(x):
    return F.lit(x)


def test_values(spark):
    cases = [
        (strings.pad_centre(lit("abc"), 10, "-"), "----abc---"),
        (strings.pad_left(lit("abcdef"), 3, "-"), "abcdef"),
        (strings.index_of(lit("Hello"), lit("")), 1),
        (strings.index_of(lit("Hello"), lit("z")), 0),
        (strings.fill(lit("ab"), lit(-1)), ""),
        (strings.known(lit(None).cast("string")), ""),
        (strings.fit(lit("aa bb cc"), 5, "", "> "), "aa bb\n> cc"),
        (strings.headline(lit("x" * 60)), "x" * 50 + "…"),
        (strings.initials(lit("")), "?"),
        (strings.initials(lit("ada")), "AD"),
        (strings.char(lit(300)), None),
        (strings.compact_count(lit(12400)), "12,4k"),
        (lists.entry(lit(0), lit("a,b")), None),
        (lists.entry(lit(2), lit("a|b"), "|"), "b"),
        (lists.remove(lit("a,b,c"), lit(2), lit(-1)), "a"),
        (lists.remove(lit("a,b,c"), lit(9), lit(1)), "a,b,c"),
        (lists.top_level(lit('f(a,b),"x,y",z')), ["f(a,b)", '"x,y"', "z"]),
        (tags.extract(lit("A=1,B=2"), "b"), "2"),
        (tags.put(lit("A=1"), "a", lit("3")), "a=3"),
        (tags.range_label(lit(5), "0:low,5:mid"), "mid"),
        (tags.range_label(lit(-1), "0:low,5:mid"), None),
        (numbers.rounded(lit(2.75), 1), 2.8),
        (numbers.truncated(lit(-2.79), 1), -2.7),
        (numbers.quotient(lit(-7), lit(2)), -3),
        (numbers.quotient(lit(7), lit(0)), None),
        (numbers.in_words(lit(121_042)), "one hundred twenty-one thousand forty-two"),
        (numbers.in_words(lit(0)), "zero"),
        (dates.to_day(lit("31/02/2024")), None),
        (dates.to_day(lit("29/02/2024")), dt.date(2024, 2, 29)),
        (dates.to_seconds(lit("01:00")), 3600),
        (dates.years_between(lit(dt.date(2024, 7, 1)), lit(dt.date(2023, 7, 1))), 1.0),
        (dates.combine(lit(dt.date(2024, 1, 2)), lit(61)), dt.datetime(2024, 1, 2, 0, 1, 1)),
        (convert.to_integer(lit("x1")), None),
        (convert.format_fractional(lit(1.5)), "1.50"),
        (evals.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), 1.0),
        (evals.jaccard(F.array(lit("a")), F.array().cast("array<string>")), 0.0),
        (evals.score(lit(5), lit(0)), 0),
        (expand.bare_name(lit("OrderTotal"), ["Order"]), "Total"),
        (expand.bare_name(lit("Orders"), ["Order"]), "Orders"),
    ]
    got = one(spark, *[column for column, _ in cases])
    assert [(i, x) for i, x in enumerate(got)] == [(i, want) for i, (_, want) in enumerate(cases)]


def test_screening_escalates_on_two_identifying_hits(spark):
    cases = spark.createDataFrame(
        [(1, "mail a@b.org", False), (2, "mail a@b.org on 2023-02-01", True), (3, "4111111111111111", True), (4, None, False), (5, "", False)], "id int, text string, want boolean"
    )
    found = rules.alerts(F.col("text"), rulings.SCREENS)
    rows = cases.select("id", "want", rules.blocked(found, rulings.SCREENS).alias("got"), rules.blocked(found, rulings.SCREENS, escalate=False).alias("plain")).collect()
    assert all(r.got == r.want for r in rows)
    assert {r.id for r in rows if r.plain} == {3}


def test_lint_and_repair(spark):
    code = "begin p\n-- note\nwhen a\nclip (x) { loop\n} share y = 1 / 0.5"
    r = one(spark, rules.lint(lit(code), rulings.CHECKS), rules.repaired(lit(code), rulings.REPAIRS), rules.lint(lit(" \n "), rulings.CHECKS), rules.lint(lit(None).cast("string"), rulings.CHECKS))
    assert [(i.rule_id, i.line) for i in r[0]] == [("dash-comment", 2), ("old-call", 4), ("global", 5), ("no-give", None), ("whens", None)]
    assert r[1] == "begin p\n{ note }\nwhen a\npart(x) { loop\n} share y = 1 / 0.5"
    assert r[2] == r[3] == []


def test_lint_of_every_match(spark):
    checks = (rules.Lint("old", "WARNING", "m", r"old\s*\(", every=True), rules.Lint("slash", "INFO", "m", r"//[^\n]*", raw=True, every=True), rules.Lint("any", "INFO", "m", "b", raw=True))
    code = "a // one old(\nold( b old\n(b) // \x01two\n\n--old(\nold (é"
    r = one(spark, rules.lint(lit(code), checks), rules.lint(lit("nothing"), checks), rules.lint(lit("").cast("string"), checks))
    assert [(i.rule_id, i.line, i.excerpt) for i in r[0]] == [
        ("old", 1, "old("), ("old", 2, "old("), ("old", 2, "old\n("), ("old", 6, "old ("), ("slash", 1, "// one old("), ("slash", 3, "// two"), ("any", 2, "b"),
    ]
    assert r[1] == r[2] == []


def test_lint_report_orders_by_severity(spark):
    code = "-- x\nloop always\nnext\nshare y = 2"
    r = one(spark, rules.lint_report(rules.lint(lit(code), rulings.CHECKS), "WARNING"), rules.lint_report(rules.lint(lit("y = 1"), rulings.CHECKS)))
    assert r[0] == "ERROR forever:2 this loop has no way out\nWARNING dash-comment:1 a line comment, write { } instead"
    assert r[1] == ""


def test_gate_and_certainty(spark):
    said = "```code\nLOOP a\n```"
    level, reason = rules.certainty(lit("## Sure\n[A] **Yes** — seen\n## More"), "Sure", [("[A]", "high")])
    gate = lambda on: rules.loop_gate(lit(said), lit(on), "no", ["loop"])
    r = one(spark, gate(True), gate(False), level, reason, rules.answer_only(lit("hmm## A"), ["## A"], ["hmm"]))
    assert list(r) == ["no", said, "high", "seen", "## A"]


def test_chunks_pack_and_drop(spark):
    files = spark.createDataFrame([("a.md", "---\npriority: high\ntags: [x, y]\n---\nshort\n## One\n" + "\n\n".join(["p" * 50] * 5)), ("b.md", None), ("c.md", "")], "path string, text string")
    rows = text.chunks(files, 120, 30).orderBy("ordinal").collect()
    assert [(r.section, r.ordinal, r.priority, r.tags) for r in rows] == [("One", 1000, "high", "x y"), ("One", 1001, "high", "x y"), ("One", 1002, "high", "x y")]
    assert rows[1].text == "p" * 50 + "\n\n" + "p" * 50


def test_ranking_edges(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, None), (3, "red red"), (4, "blue")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red"), (8, ""), (9, None)], "query_id long, text string")
    assert {r.query_id for r in bm25.bm25_topk(docs, asked).collect()} <= {7}
    assert bm25.bm25_topk(docs.limit(0), asked).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "id long, embedding array<double>")
    top = ranking.cosine_topk(vectors, vectors.filter("id = 1").withColumnRenamed("id", "query_id"))
    assert [(r.rank, r.id) for r in top.orderBy("rank").collect()] == [(1, 1), (2, 4)]
    placed = ranking.edge_load(spark.createDataFrame([(1, i, 1.0 - i / 10, i) for i in range(1, 5)], "query_id int, id int, score double, position long"))
    assert [r.id for r in placed.orderBy("place").collect()] == [1, 3, 4, 2]


def test_upsert_and_windows(spark):
    today = dt.date(2024, 1, 30)
    day = lambda n: today - dt.timedelta(days=n)
    facts = spark.createDataFrame([(1, day(0), 100, 50, 1), (1, day(0), 20, 5, 1), (2, day(29), 40, 10, 1), (3, day(30), 40, 10, 1)], "user_id long, day date, prompt_tokens long, completion_tokens long, request_count long")
    daily = usage.upsert(usage.daily(facts.limit(0)), facts)
    assert [tuple(r)[2:] for r in daily.filter("user_id = 1").collect()] == [(120, 55, 2)]
    assert {r.user_id: r.tokens for r in usage.totals(daily, lit(today)).collect()} == {1: 175, 2: 50, 3: 0}
    filled = usage.gap_filled(daily, spark.createDataFrame([(1,)], "user_id long"), lit(today), 7).orderBy("day").collect()
    assert len(filled) == 7 and filled[-1].request_count == 2 and filled[0].request_count == 0


def test_limits(spark):
    second = 1_000_000
    rows = spark.createDataFrame([(1, i, i * second) for i in range(12)] + [(1, 99, 301 * second)], "user_id long, event_id long, at long")
    got = {r.event_id: r.accepted for r in usage.rate_limited(rows).collect()}
    assert [got[i] for i in range(12)] == [True] * 10 + [False] * 2 and got[99]
    tries = spark.createDataFrame([(1, i, i * second, False) for i in range(6)] + [(1, 50, 2000 * second, True)], "user_id long, event_id long, at long, success boolean")
    states = {r.event_id: (r.outcome, r.failures) for r in usage.account_lock(tries).collect()}
    assert states[4] == ("failed", 5) and states[5] == ("locked", 5) and states[50] == ("ok", 0)
    assert usage.rate_limited(rows.limit(0)).count() == 0


def test_sessions_to_the_instant(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, at), (1, at + dt.timedelta(hours=8)), (1, at + dt.timedelta(hours=17))], "user_id long, ts timestamp")
    assert sorted(r.n_events for r in usage.sessions(rows).collect()) == [1, 2]


def test_as_of_and_counters(spark):
    left = spark.createDataFrame([(1, 1, 5), (2, 1, 1), (3, 2, 9)], "event_id int, k int, at int")
    right = spark.createDataFrame([(7, 1, 5, 1.0), (8, 1, 5, 2.0), (9, 1, 6, 3.0)], "event_id int, k int, at int, v double")
    assert {r.event_id: r.as_of_value for r in monitor.as_of(left, right, "k", "at", "v", "event_id").collect()} == {1: 2.0, 2: None, 3: None}
    deltas = monitor.since_first(spark.createDataFrame([(1, 1, 10), (1, 2, 25)], "k int, at int, c int"), "k", "c", ["at"])
    assert [r.delta for r in deltas.orderBy("at").collect()] == [0, 15]


def test_caches_and_retention(spark):
    entries = spark.createDataFrame([(1, 100.0, "x"), (2, 100.0, None), (3, 0.0, "x")], "id int, ts double, payload string")
    assert [r.id for r in knowledge.fresh(entries, "ts", lit(86_450.0)).collect()] == [1]
    key = lambda skills: knowledge.cache_key(lit("q"), lit("m"), lit(6), F.array(*map(F.lit, skills)), lit("full"), lit(None))
    r = one(spark, key(["a", "b"]), key(["b", "a"]))
    assert r[0] == r[1] and len(r[0]) == 16
    assert knowledge.retained(entries, "ts", lit(100.0)).count() == 2


def test_cut_measured_and_dated(spark):
    none = lit(None).cast("string")
    r = one(spark, strings.trimmed(lit("xyaxy"), "yx"), strings.trimmed(lit("xyaxy"), "yx", "L"), strings.trimmed(lit("xx"), "x"), strings.part(lit("héllo"), lit(2), lit(3)), strings.part(lit("abc"), lit(0), lit(2)),
            strings.part(lit("abc"), lit(3), lit(9)), strings.part(lit("abc"), lit(1), lit(0)), strings.part(none, lit(1), lit(1)), strings.translated(lit("banana"), "abn", "o"), strings.translated(none, "a", "b"))
    assert list(r) == ["a", "axy", "", "éll", "", "c", "", None, "ooo", None]
    r = one(spark, numbers.logarithm(lit(0.0)), numbers.logarithm(lit(8.0), 2), numbers.logarithm(lit(1000.0), 10), numbers.root(lit(-1.0)), numbers.root(lit(9.0)))
    assert r[0] is r[3] is None and (round(r[1], 9), round(r[2], 9), r[4]) == (3, 3, 3)
    rows = spark.sql("select * from values (1, date'2024-01-01'), (2, date'2024-01-02'), (3, null) as t(day, at)")
    calendar = spark.sql("select * from values (date'2024-01-01'), (date'2024-01-01'), (null) as t(day)")
    assert sorted((x.day, x.holiday) for x in dates.with_holiday(rows, "at", calendar).collect()) == [(1, True), (2, False), (3, False)]
    assert [x.holiday for x in dates.with_holiday(rows.filter("day = 1"), "at", calendar.limit(0)).collect()] == [False]
