"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's pattern gives a Boolean query over trigrams: an OR of the strings one of which a
match must hold, each an AND of that string's trigrams. The index has a posting for each
trigram of the queries and each text that holds it; intersecting postings leaves the
candidates whose texts the pattern is run on. A rule whose pattern has no mandatory string of
three characters has no query and is run on every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, save, text_key

#: More alternatives than this are no query worth asking.
MOST_STRINGS = 64

SPAN = "struct<start:bigint,rank:int,kind:string,stop:bigint>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the group that must have ``least`` characters.

    ``exact`` is a pattern that finds just those matches of the other which are long enough, if there is one.
    """

    kind: str
    pattern: str
    group: int
    least: int
    exact: str | None = None

    @property
    def run(self) -> str:
        return self.exact or self.pattern


# The kinds, patterns and least lengths that the query's contract states.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]+", 0, 16, "[0-9a-f]{16,}"),
)


def _strings(items) -> tuple[set[str] | None, list[set[str]]]:
    """Of a parsed sequence: all the strings it can be, if few, and the sets of strings of which each match holds one."""
    run, found = {""}, []

    def end() -> None:
        nonlocal run
        if run != {""}:
            found.append(run)
        run = {""}

    whole = True
    for kind, value in items:
        options: set[str] | None = None
        if kind is kinds.LITERAL:
            options = {chr(value).lower()}
        elif kind is kinds.SUBPATTERN:
            options, inner = _strings(value[-1])
            if options is None:
                found += inner
        elif kind is kinds.BRANCH:
            each = [_strings(x) for x in value[1]]
            if all(x is not None for x, _ in each):
                options = set().union(*[x for x, _ in each])
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            least, most, of = value
            of, inner = _strings(of)
            if of is not None and (least, most) in ((0, 1), (1, 1)):
                options = of | ({""} if least == 0 else set())
            elif least:
                found += inner if of is None else [of]
        if options is None or len(run) * len(options) > MOST_STRINGS:
            whole = False
            end()
            run = options if options is not None and len(options) <= MOST_STRINGS else {""}
        else:
            run = {a + b for a in run for b in options}
    if whole:
        return run, found
    end()
    return None, found


@cache
def mandatory(pattern: str) -> tuple[str, ...]:
    """Lower-case strings of three characters or more, one of which each match of the pattern holds in any case; none if there are no such."""
    whole, found = _strings(parser.parse(pattern))
    sets = [x for x in [*found, whole] if x and min(map(len, x)) >= 3]
    return tuple(sorted(max(sets, key=lambda x: (min(map(len, x)), -len(x))))) if sets else ()


def trigram_query(rule: Rule) -> list[list[str]] | None:
    """The rule's query as an OR of ANDs of lower-case trigrams; None if some match need hold no trigram."""
    return [sorted({x[i : i + 3] for i in range(len(x) - 2)}) for x in mandatory(rule.pattern)] or None


def trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for rule in rules for literal in trigram_query(rule) or [] for t in literal})


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(trigram, k1, k2)``: the inverted index, for the rules' trigrams; a text is known by its two hashes."""
    lower = F.lower(F.coalesce(F.col("text"), F.lit("")))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("lower"), F.lit(t)), F.lit(t)) for t in trigrams(rules)]))
    return docs.select(*text_key(), lower.alias("lower")).select("k1", "k2", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(k1, k2, kinds)``: the texts whose postings satisfy some rule's query, and those rules.

    Postings are intersected per text: each text's trigrams are or-ed into bit masks of 60
    before the shuffle, so that a trigram which many texts hold gathers nowhere.
    """
    names = trigrams(rules)
    place = {t: divmod(i, 60) for i, t in enumerate(names)}
    of = lambda i: F.create_map(*[F.lit(x) for t in names if place[t][0] == i for x in (t, 1 << place[t][1])])
    words = range(-(-len(names) // 60))
    masks = index.groupBy("k1", "k2").agg(F.count("*").alias("n"), *[F.bit_or(F.coalesce(F.try_element_at(of(i), F.col("trigram")).cast("long"), F.lit(0).cast("long"))).alias(f"m{i}") for i in words])
    found = []
    for rule in rules:
        any_of = F.lit(False)
        for literal in trigram_query(rule) or []:
            every = F.lit(True)
            for i in words:
                need = sum(1 << place[t][1] for t in literal if place[t][0] == i)
                every = every & (F.col(f"m{i}").bitwiseAND(F.lit(need).cast("long")) == need)
            any_of = any_of | every
        found.append(F.when(any_of, F.lit(rule.kind)))
    return masks.select("k1", "k2", F.array_compact(F.array(*found)).alias("kinds")).filter(F.size("kinds") > 0)


def _matches(rule: Rule, rank: int) -> Column:
    """The rule's leftmost matches in ``text``: of each its number, the gap before it, its size and whether it holds."""
    decides = lambda x: F.length(F.regexp_extract(x, rule.run, rule.group))
    found = F.transform(F.regexp_extract_all("text", F.lit(rule.run), F.lit(0)), lambda x: F.struct(F.length(x).alias("size"), (decides(x) >= rule.least).alias("holds")))
    gaps = F.transform(F.split("text", rule.run, -1), lambda x: F.length(x))
    both = F.zip_with(gaps, found, lambda gap, x: F.struct(gap.alias("gap"), x["size"].alias("size"), x["holds"].alias("holds")))
    return F.transform(both, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("no"), x["gap"].alias("gap"), x["size"].alias("size"), x["holds"].alias("holds")))


def _spans(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(_j1, _j2, secrets)`` of the ``texts(text, _k1, _k2, _kinds)`` that have any.

    Gaps and matches are a row each, so that places are running sums within a text and rule
    and no array grows by a copy for each span. A text that many rows hold is taken once.
    """
    none = F.array().cast("array<struct<rank:int,no:int,gap:int,size:int,holds:boolean>>")
    parts = []
    for rank, rule in enumerate(rules):
        may = F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False)) if trigram_query(rule) else F.col("text").rlike(rule.run)
        parts.append(F.when(may, _matches(rule, rank)).otherwise(none))
    rows = texts.select("_k1", "_k2", F.explode(F.concat(*parts)).alias("x")).select("_k1", "_k2", "x.*").filter("size is not null").distinct()
    so_far = Window.partitionBy("_k1", "_k2", "rank").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(so_far)).filter("holds")
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    span = F.struct((F.col("stop") - F.col("size")).alias("start"), "rank", kind.alias("kind"), "stop")
    return rows.groupBy(F.col("_k1").alias("_j1"), F.col("_k2").alias("_j2")).agg(F.array_sort(F.collect_list(span)).cast(f"array<{SPAN}>").alias("_spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secrets``, an array of structs (start, rank, kind, stop) by start, then rank.

    Matches are leftmost and do not overlap within a kind; those whose deciding group is too
    short are dropped afterwards. Patterns match no empty string and look neither ahead nor
    back. A null text is empty. Repeated rows get the same result;
    other columns stay, whatever their names (``secrets`` is replaced). Candidates and spans meet their texts by
    hash, with rows split where many rows hold one text.
    """
    first, second = text_key()
    texts = docs.select("text").withColumns({"_k1": first, "_k2": second})
    if trigrams(rules):
        found = save(candidates(postings(docs.select("text"), rules), rules), "candidates").withColumnsRenamed({"k1": "_j1", "k2": "_j2", "kinds": "_kinds"})
        texts = texts.join(found, (F.col("_k1") == F.col("_j1")) & (F.col("_k2") == F.col("_j2")), "left")
    else:
        texts = texts.withColumn("_kinds", F.array().cast("array<string>"))
    k1, k2, j1, j2, found = fresh(docs, "_k1", "_k2", "_j1", "_j2", "_spans")
    spans = save(_spans(texts, rules), "spans").withColumnsRenamed({"_j1": j1, "_j2": j2, "_spans": found})
    joined = docs.withColumns({k1: first, k2: second}).join(spans, (F.col(k1) == F.col(j1)) & (F.col(k2) == F.col(j2)), "left")
    return joined.withColumn("secrets", F.coalesce(found, F.array().cast(f"array<{SPAN}>"))).drop(k1, k2, j1, j2, found)


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts by kind, the spans as text and their sha256.

    The method adds no spans to the base ones: a verified candidate's spans are the pattern's.
    """
    found = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = F.array_join(F.transform("secrets", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return found.select("doc_id", *[count(r.kind) for r in RULES], text.alias("spans")).withColumn("base_sha256", F.sha2("spans", 256)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"
    )
