"""Rule queries: screening, lint and repair of code blocks, gates, evaluation batteries, comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evals, rules
from ..operators.rules import Lint, Screen
from ..sources import readers

# Rules of these queries: what the synthetic documents and conversations can hold.
SCREENS = (
    Screen("payment card", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}\b", True, True),
    Screen("access key", r"\bAKIA[A-Z0-9]{14,}", True),
    Screen("password", r"(?i)\bpassword *[:=] *[^ \n]{6,}", True),
    Screen("mail address", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}", False, True),
    Screen("network address", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    Screen("telephone", r"\+[0-9]{1,3}[ -][0-9][0-9 -]{6,}[0-9]", False, True),
    Screen("calendar day", r"\b(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]\b", False, True),
)
# A small language of our own for the code in answers: begin/end, loop/next, when/over, give; -- and { } comments.
CHECKS = (
    Lint("dash-comment", "WARNING", "a line comment, write { } instead", "--", raw=True),
    Lint("forever", "ERROR", "this loop has no way out", r"(?i)\bloop[ \n]+always\b"),
    Lint("divide-by-nothing", "ERROR", "a division by 0", r"/ *0(?![.0-9])"),
    Lint("truncates", "WARNING", "two whole numbers divided lose the remainder", r"\b[0-9]+ */ *[1-9][0-9]*\b"),
    Lint("old-call", "ERROR", "clip() is gone, use part()", r"\bclip *\("),
    Lint("global", "INFO", "seen by every run", r"(?i)\bshare +[a-z]+ *="),
    Lint("no-give", "ERROR", "a program that gives nothing", r"(?i)\bgive\b", needs=r"(?i)\bbegin\b", lacks=True),
    Lint("loops", "ERROR", "loop and next differ in number", r"(?i)\bloop\b", closing=r"(?i)\bnext\b"),
    Lint("whens", "ERROR", "when and over differ in number", r"(?i)\bwhen\b", closing=r"(?i)\bover\b"),
)
REPAIRS = ((r"--[ \t]*([^\n]*)", "{ $1 }"), (r"\bclip *\(", "part("))
# Code that is put into the answers, one body after another by doc_id, and a second block in every third.
BODIES = [
    "loop always\nx = 1\nnext\ngive x",
    "when a > 0\nx = 10 / 4\ngive x",
    "-- note\nshare total = 5\ngive today()",
    "loop 3\nx = clip(a)\n{ two\nlines } give x / 0",
    "x = 1\n{ never closed",
    "give Count(a) + Half(b)",
]
SECOND = "begin q\nx = 7 / 0\nend"
CASES = [(0, ["the", "an"], ["Zz"]), (1, ["ou"], ["Qu"]), (2, ["er", "ing"], []), (3, [], ["Th", "En"]), (4, ["e"], ["xyzzy"])]
NOTICE = "Loops are not for this account."


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def screen_texts(spark, sf_dir):
    """Each turn of a conversation as the current text, with all its earlier turns as history."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    now = turns.withColumn("now", rules.alerts(F.col("text"), SCREENS))
    # an alert of any earlier turn: as flags, so that no history is put together
    flags = F.array_compact(F.array(*[F.when(F.max(F.array_contains("now", r.label)).over(earlier), F.lit(r.label)) for r in SCREENS]))
    both = now.withColumn("before", flags)
    stop = rules.blocked(F.col("now"), SCREENS) | rules.blocked(F.col("before"), SCREENS, escalate=False)
    return both.select("conv_id", "turn", F.array_join(F.array_distinct(F.concat("now", "before")), "; ").alias("alerts"), stop.alias("blocked"))


def screen_documents(spark, sf_dir):
    found = rules.alerts(F.col("text"), SCREENS)
    return documents(spark, sf_dir).select("doc_id", F.array_join(found, "; ").alias("alerts"), rules.blocked(found, SCREENS).alias("blocked"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, answer)``: a whole text, a block of code, and in every third a second block."""
    body = F.element_at(F.array(*map(F.lit, BODIES)), (F.pmod("doc_id", F.lit(len(BODIES))) + 1).cast("int"))
    block = lambda code: F.concat(F.lit("\n```code\n"), code, F.lit("\n```\n"))
    more = F.when(F.pmod("doc_id", F.lit(3)) == 0, block(F.lit(SECOND))).otherwise("")
    return documents(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), block(F.concat(F.lit("begin p\n"), body)), F.lit("then"), more).alias("answer"))


def _issues(spark, sf_dir):
    each = answers(spark, sf_dir).select("doc_id", F.posexplode(rules.blocks(F.col("answer"))).alias("block", "code"))
    return each.select("doc_id", F.col("block").cast("long").alias("block"), rules.lint(F.col("code"), CHECKS).alias("issues"))


def lint_blocks(spark, sf_dir):
    """The issues of every block of every answer."""
    shown = F.transform(F.col("issues"), lambda x: F.concat_ws(":", x["rule_id"], F.coalesce(x["line"].cast("string"), F.lit("-"))))
    return _issues(spark, sf_dir).select(
        "doc_id", "block", rules.severity_count(F.col("issues"), "ERROR").cast("long").alias("n_errors"), rules.severity_count(F.col("issues"), "WARNING").cast("long").alias("n_warnings"),
        F.array_join(shown, ",").alias("issues"),
    )


#: Checks of whole texts that report each place.
EVERYWHERE = (
    rules.Lint("number", "INFO", "a long number", "[0-9]{4,}", raw=True, every=True),
    rules.Lint("tag", "WARNING", "markup in the text", "<[a-z]+|&[a-z]+;", raw=True, every=True),
    rules.Lint("address", "INFO", "a plain address", "[a-z]+://[^ \n]+", raw=True, every=True),
)


def lint_matches(spark, sf_dir):
    """Each place in the whole texts that a check finds, with its line."""
    found = documents(spark, sf_dir).select("doc_id", F.explode(rules.lint(F.col("text"), EVERYWHERE)).alias("x"))
    return found.groupBy("doc_id", "x.rule_id", "x.line").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("x.excerpt")), "|").cast("binary")).alias("excerpts_md5"))


def lint_reports(spark, sf_dir):
    """Each block's issues of weight as a report, by severity."""
    return _issues(spark, sf_dir).select("doc_id", "block", rules.lint_report(F.col("issues"), "WARNING").alias("report"))


WORDS = {"ERROR": "error(s)", "WARNING": "warning(s)", "INFO": "hint(s)"}
WARNING = "Mend these errors first."


def lint_markdown(spark, sf_dir):
    """Each block's issues as Markdown, put under the block with a note on the model that gave it."""
    rows = _issues(spark, sf_dir)
    report = rules.lint_markdown(F.col("issues"), WORDS, "no issues")
    used = F.when(F.col("doc_id") % 4 == 0, "small").otherwise("large")
    shown = rules.banner(F.concat(F.lit("block "), F.col("block").cast("string")), F.lit("large"), used, F.when(F.size("issues") == 0, "").otherwise(report), rules.severity_count(F.col("issues"), "ERROR") > 0, WARNING)
    return rows.select("doc_id", "block", report.alias("report"), shown.alias("shown"))


def repair_blocks(spark, sf_dir):
    fixed = rules.in_blocks(F.col("answer"), lambda p: rules.repaired(p, REPAIRS))
    return answers(spark, sf_dir).select("doc_id", (fixed != F.col("answer")).alias("changed"), F.md5(fixed.cast("binary")).alias("fixed_md5"))


def gate_loops(spark, sf_dir):
    shown = rules.loop_gate(F.col("answer"), F.pmod("doc_id", F.lit(2)) == 0, NOTICE, ["loop", "repeat"])
    return answers(spark, sf_dir).select("doc_id", F.md5(shown.cast("binary")).alias("shown_md5"))


def strip_reasoning(spark, sf_dir):
    """An answer after its reasoning, the whole text: what precedes the marker goes if it says so or is long."""
    said = F.concat(F.col("text"), F.when(F.pmod("doc_id", F.lit(3)) == 0, " let me think ").otherwise(" "), F.lit("## Answer\nyes"))
    kept = rules.answer_only(said, ["## Answer", "**Answer**"], ["let me think"])
    return documents(spark, sf_dir).filter("text is not null").select("doc_id", F.md5(kept.cast("binary")).alias("kept_md5"))


def certainty_levels(spark, sf_dir):
    """The level that a whole answer states in its section on certainty, and why."""
    mark = F.element_at(F.array(*map(F.lit, ["[HIGH] seen twice", "[LOW]", "none"])), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    shown = F.concat(F.coalesce("text", F.lit("")), F.lit("\n## Certainty\n"), mark, F.lit("\n## Sources\nall"))
    level, reason = rules.certainty(shown, "Certainty", [("[HIGH]", "high"), ("[LOW]", "low")])
    return documents(spark, sf_dir).select("doc_id", level.alias("level"), reason.alias("reason"), rules.section(shown, "Certainty").alias("part"))


def _results(spark, sf_dir):
    said = documents(spark, sf_dir).select("doc_id", F.pmod("doc_id", F.lit(len(CASES))).cast("long").alias("case_id"), F.col("text").alias("answer"))
    return evals.evaluate(said, readers.inline(spark, CASES, "case_id LONG, must ARRAY<STRING>, must_not ARRAY<STRING>"))


def eval_results(spark, sf_dir):
    return _results(spark, sf_dir).select("doc_id", "status", F.col("score").cast("long").alias("score"), F.array_join("errors", "; ").alias("errors"))


def eval_summary(spark, sf_dir):
    return evals.summary(_results(spark, sf_dir), "case_id")


def eval_weighted(spark, sf_dir):
    return evals.weighted(evals.summary(_results(spark, sf_dir), "case_id", digits=12))


def compare_runs(spark, sf_dir):
    """Each document's capitalised words against those of the one before it, as two runs of one case."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Z][a-z]+"), 0))
    new = documents(spark, sf_dir).select("doc_id", words.alias("a"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m"))
    old = new.select((F.col("doc_id") + 1).alias("doc_id"), F.col("a").alias("b"), F.col("m").alias("n"))
    both = new.join(old, "doc_id").withColumn("similarity", F.round(evals.jaccard(F.col("a"), F.col("b")), 6))
    return both.select(
        "doc_id", "similarity", evals.verdict(F.col("m") == F.col("n"), F.col("similarity")).alias("verdict"),
        F.size(F.array_except("b", "a")).cast("long").alias("n_lost"), F.size(F.array_except("a", "b")).cast("long").alias("n_added"),
    )


def run_verdicts(spark, sf_dir):
    return compare_runs(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


def called_names(spark, sf_dir):
    names = evals.calls(F.col("answer"), [], "code", r"\b([A-Z][A-Za-z0-9]+)\s*\(")
    return answers(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(names), ",").alias("names"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _list_sql(items: list[str]) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def _alert_sql(column: str) -> str:
    return _list_sql([f"CASE WHEN regexp_matches(coalesce({column}, ''), {_quoted(r.pattern)}) THEN '{r.label}' END" for r in SCREENS])


_STOPS = "[" + ", ".join(f"'{r.label}'" for r in SCREENS if r.blocking) + "]"
_IDENTIFYING = "[" + ", ".join(f"'{r.label}'" for r in SCREENS if r.identifying) + "]"
_BLOCKS = "len(list_intersect({0}, " + _STOPS + ")) > 0 OR len(list_intersect({0}, " + _IDENTIFYING + ")) >= 2"
_ANSWERS = f"""w AS (SELECT doc_id, [{", ".join(map(_quoted, BODIES))}][CAST(doc_id % {len(BODIES)} AS INT) + 1] AS body, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t || chr(10) || '```code' || chr(10) || 'begin p' || chr(10) || body || chr(10) || '```' || chr(10) || 'then'
  || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '```code' || chr(10) || {_quoted(SECOND)} || chr(10) || '```' || chr(10) ELSE '' END AS answer FROM w)"""


def _line_sql(column: str, pattern: str) -> str:
    before = f"regexp_extract({column}, {_quoted('(?s)^(.*?)(?:' + pattern + ')')}, 1)"
    return f"CAST(length({before}) - length(replace({before}, chr(10), '')) + 1 AS VARCHAR)"


def _issue_sql(check: Lint) -> str:
    """DuckDB has no look-ahead: a division by 0 followed by no digit is said otherwise."""
    on, pattern = "code" if check.raw else "plain", check.pattern.replace("(?![.0-9])", r"(?:[^.0-9]|$)")
    if check.closing:
        at = f"len(regexp_extract_all({on}, {_quoted(pattern)})) <> len(regexp_extract_all({on}, {_quoted(check.closing)}))"
    else:
        at = ("NOT " if check.lacks else "") + f"regexp_matches({on}, {_quoted(pattern)})"
    if check.needs:
        at += f" AND regexp_matches({on}, {_quoted(check.needs)})"
    line = "NULL" if check.closing or check.lacks else _line_sql(on, pattern)
    return f"CASE WHEN {at} THEN {{'id': '{check.rule_id}', 'severity': '{check.severity}', 'message': {_quoted(check.message)}, 'line': {line}}} END"


_ISSUES = f"""{_ANSWERS},
c AS (SELECT doc_id, unnest(b) AS code, unnest(range(len(b))) AS block FROM (SELECT doc_id, list_transform(regexp_extract_all(answer, '(?is)```code[ \\n\\t]*(.*?)```', 1), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))) AS b FROM a)),
p AS (SELECT *, replace(regexp_replace(code, '--[^\\n]*', '', 'g'), {_quoted("{ two" + chr(10) + "lines }")}, chr(10)) AS plain FROM c),
i AS (SELECT doc_id, block, {_list_sql([_issue_sql(c) for c in CHECKS])} AS issues FROM p)"""


_CASES = "k(case_id, must, must_not) AS (VALUES " + ", ".join(f"({i}, {a}::VARCHAR[], {b}::VARCHAR[])" for i, a, b in CASES) + ")"
_RESULTS = f"""{_CASES},
r AS (SELECT doc_id, case_id, text AS answer, must, must_not FROM documents JOIN k ON doc_id % {len(CASES)} = case_id),
e AS (SELECT *, list_concat(list_transform(list_filter(must, lambda t: NOT contains(lower(answer), lower(t))), lambda t: 'missing: ' || t), list_transform(list_filter(must_not, lambda t: contains(answer, t)), lambda t: 'forbidden: ' || t)) AS found FROM r),
v AS (SELECT doc_id, case_id, CASE WHEN answer IS NULL THEN 'ERROR' WHEN len(found) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
  CAST(CASE WHEN answer IS NULL THEN 0 ELSE greatest(0, 10 - 3 * len(found)) END AS BIGINT) AS score, CASE WHEN answer IS NULL THEN 'no answer' ELSE coalesce(array_to_string(found, '; '), '') END AS errors FROM e)"""
_RUNS = """x AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+')) AS a, md5(coalesce(text, '')) AS m FROM documents),
y AS (SELECT n.doc_id, n.a, o.a AS b, n.m, o.m AS n FROM x n JOIN x o ON n.doc_id = o.doc_id + 1),
z AS (SELECT *, len(list_intersect(a, b)) AS i FROM y),
c AS (SELECT doc_id, CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE round(i / CAST(len(a) + len(b) - i AS DOUBLE), 6) END AS similarity, m = n AS same, len(b) - i AS n_lost, len(a) - i AS n_added FROM z),
g AS (SELECT doc_id, similarity, CASE WHEN same THEN 'IDENTICAL' WHEN similarity >= 0.7 THEN 'EQUIVALENT' ELSE 'DIFFERENT' END AS verdict, CAST(n_lost AS BIGINT) AS n_lost, CAST(n_added AS BIGINT) AS n_added FROM c)"""

ORACLE = {
    "screen_texts": f"""WITH s AS (SELECT conv_id, turn, {_alert_sql("text")} AS a FROM conversations),
h AS (SELECT conv_id, turn, a, [l FOR l IN [{", ".join(f"'{r.label}'" for r in SCREENS)}] IF list_contains(flatten(coalesce(list(a) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])), l)] AS b FROM s)
SELECT conv_id, turn, coalesce(array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), '; '), '') AS alerts,
  ({_BLOCKS.format("a")}) OR len(list_intersect(b, {_STOPS})) > 0 AS blocked FROM h""",
    "screen_documents": f"""SELECT doc_id, coalesce(array_to_string(a, '; '), '') AS alerts, {_BLOCKS.format("a")} AS blocked FROM (SELECT doc_id, {_alert_sql("text")} AS a FROM documents)""",
    "lint_blocks": f"""WITH {_ISSUES} SELECT doc_id, block, len(list_filter(issues, lambda x: x.severity = 'ERROR')) AS n_errors, len(list_filter(issues, lambda x: x.severity = 'WARNING')) AS n_warnings,
  coalesce(array_to_string(list_transform(issues, lambda x: x.id || ':' || coalesce(x.line, '-')), ','), '') AS issues FROM i""",
    "lint_matches": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''),
c(rule_id) AS (VALUES ('number'), ('tag'), ('address')),
m AS (SELECT doc_id, rule_id, line, left(unnest(CASE rule_id WHEN 'number' THEN regexp_extract_all(s, '[0-9]{4,}') WHEN 'tag' THEN regexp_extract_all(s, '<[a-z]+|&[a-z]+;') ELSE regexp_extract_all(s, '[a-z]+://[^ ]+') END), 50) AS excerpt FROM l, c)
SELECT doc_id, rule_id, line, count(*) AS n, md5(string_agg(excerpt, '|' ORDER BY excerpt)) AS excerpts_md5 FROM m GROUP BY ALL""",
    "lint_reports": f"""WITH {_ISSUES} SELECT doc_id, block, coalesce(array_to_string(list_transform(list_concat(list_filter(issues, lambda x: x.severity = 'ERROR'), list_filter(issues, lambda x: x.severity = 'WARNING')),
  lambda x: x.severity || ' ' || x.id || coalesce(':' || x.line, '') || ' ' || x.message), chr(10)), '') AS report FROM i""",
    "lint_markdown": f"""WITH {_ISSUES}, counted AS (SELECT *, len(list_filter(issues, lambda x: x.severity = 'ERROR')) AS ne, len(list_filter(issues, lambda x: x.severity = 'WARNING')) AS nw FROM i),
written AS (SELECT *, CASE WHEN len(issues) = 0 THEN 'no issues' ELSE concat_ws(', ', CASE WHEN ne > 0 THEN ne || ' error(s)' END, CASE WHEN nw > 0 THEN nw || ' warning(s)' END) || chr(10) || chr(10) || array_to_string(list_transform(
  list_concat(list_filter(issues, lambda x: x.severity = 'ERROR'), list_filter(issues, lambda x: x.severity = 'WARNING'), list_filter(issues, lambda x: x.severity = 'INFO')),
  lambda x: '**' || CASE x.severity WHEN 'ERROR' THEN 'error(s)' WHEN 'WARNING' THEN 'warning(s)' ELSE 'hint(s)' END || '**' || coalesce(' *(line ' || x.line || ')*', '') || ': ' || x.message), chr(10)) END AS report FROM counted)
SELECT doc_id, block, report, CASE WHEN doc_id % 4 = 0 THEN '*(answered by small; large was not available)*' || chr(10) || chr(10) ELSE '' END || 'block ' || block ||
  CASE WHEN len(issues) = 0 THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || report || CASE WHEN ne > 0 THEN chr(10) || chr(10) || '{WARNING}' ELSE '' END END AS shown FROM written""",
    "repair_blocks": f"""WITH {_ANSWERS}, f AS (SELECT doc_id, answer, CASE doc_id % {len(BODIES)} WHEN 2 THEN replace(answer, '-- note' || chr(10), '{{ note }}' || chr(10)) WHEN 3 THEN replace(answer, 'clip(a)', 'part(a)') ELSE answer END AS fixed FROM a)
SELECT doc_id, fixed <> answer AS changed, md5(fixed) AS fixed_md5 FROM f""",
    "gate_loops": f"""WITH {_ANSWERS} SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 AND len(list_filter(regexp_extract_all(answer, '(?is)```code[ \\n\\t]*(.*?)```', 1), lambda x: regexp_matches(x, '(?i)\\b(loop|repeat)\\b'))) > 0 THEN '{NOTICE}' ELSE answer END) AS shown_md5 FROM a""",
    "strip_reasoning": """WITH s AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' let me think ' ELSE ' ' END AS pre, '## Answer' || chr(10) || 'yes' AS rest FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(CASE WHEN contains(lower(pre), 'let me think') OR length(trim(pre, ' ' || chr(10) || chr(9) || chr(13))) > 150 THEN rest ELSE pre || rest END) AS kept_md5 FROM s""",
    "certainty_levels": """WITH s AS (SELECT doc_id, regexp_extract(coalesce(text, '') || chr(10) || '## Certainty' || chr(10) || ['[HIGH] seen twice', '[LOW]', 'none'][CAST(doc_id % 3 AS INT) + 1] || chr(10) || '## Sources' || chr(10) || 'all', '(?s)(?:^|\\n)## Certainty[ ]*\\n(.*?)\\n## ', 1) AS part FROM documents)
SELECT doc_id, CASE WHEN contains(part, '[HIGH]') THEN 'high' WHEN contains(part, '[LOW]') THEN 'low' END AS level, CASE WHEN contains(part, '[HIGH]') THEN 'seen twice' END AS reason, part FROM s""",
    "eval_results": f"WITH {_RESULTS} SELECT doc_id, status, score, errors FROM v",
    "eval_summary": f"WITH {_RESULTS} SELECT CAST(case_id AS BIGINT) AS case_id, count(*) AS n, count(*) FILTER (status = 'PASS') AS n_pass, round(avg(score), 6) AS mean_score FROM v GROUP BY case_id",
    "eval_weighted": f"WITH {_RESULTS} SELECT round(avg(score), 6) AS mean_score, count(*) AS n FROM v",
    "compare_runs": f"WITH {_RUNS} SELECT * FROM g",
    "run_verdicts": f"WITH {_RUNS} SELECT verdict, count(*) AS n FROM g GROUP BY verdict",
    "called_names": f"""WITH {_ANSWERS} SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(answer, '\\b([A-Z][A-Za-z0-9]+)\\s*\\(', 1))), ','), '') AS names FROM a""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
