"""op11 against a plain version, and the selection by histograms where many values tie."""

import random

import pytest
from cairnkb.llm import divergence, queries
from cairnkb.llm.divergence import divergence as audit
from pyspark.sql import functions as F


def plain(rows, least):
    """``{(lang, source, part, item, value, rank)}`` of ``[(text, lang, source)]``."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    inside = lambda c: ord(c) > 127 or "a" <= c <= "z"
    words = lambda t: "".join(c if inside(c) else " " for c in t.translate(lower)).split(" ")
    out = set()
    for lang in {r[1] for r in rows}:
        own = [([w for w in words(t) if w], s) for t, x, s in rows if x == lang]
        kept = {w for ws, _ in own for w in ws}
        kept = {w for w in kept if sum(w in ws for ws, _ in own) >= least}
        count = {}
        for ws, s in own:
            mine = count.setdefault(s, dict.fromkeys(kept, 0))
            for w in ws:
                if w in kept:
                    mine[w] += 1
        count[None] = {w: sum(c[w] for c in count.values()) for w in kept}
        rate = {s: {w: 1 + 1_000_000_000 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for w, n in c.items()} for s, c in count.items()}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s in count.keys() - {None}:
            pairs = [(sum(gap(rate[s][w], rate[o][w]) for w in kept), o) for o in count.keys() - {s, None}]
            marked = [(gap(rate[s][w], rate[None][w]), w) for w in kept if count[s][w] and rate[s][w] > rate[None][w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", marked, 10)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


def rows(spark, data):
    return spark.createDataFrame([(*r, 7) for r in data], "text string, lang string, source string, term int")


@pytest.mark.parametrize("cells", [{}, {"cell_terms": 3, "cell_sources": 2}])
def test_plain(spark, cells):
    rng = random.Random(4)
    pool = ["one", "Two", "éa", "日本", "a", "ab", "abc", "Ωmega", "x" * 300]
    data = [(" ".join(rng.choices(pool, k=rng.randint(0, 12))) + rng.choice(["", ".-1", " \n"]), rng.choice(["en", "fr", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "é", None])) for _ in range(120)]
    data += [(None, "en", "empty"), ("", "lone", "s"), ("rare words", "de", "s1"), ("other", "de", "s2"), ("one " * 5000, "en", "s0")] + [data[0]] * 3
    got = audit(rows(spark, data), least_docs=3, **cells).collect()
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got} == plain(data, 3)
    assert len(got) == len(plain(data, 3))


def test_empty(spark):
    assert audit(rows(spark, [("a", "en", "s")]).limit(0)).count() == 0


def test_on_documents(spark, sf_dir):
    docs = queries.documents(spark, sf_dir, "text", "lang", "source").collect()
    got = queries.op11_divergence(spark, sf_dir).collect()
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got} == plain([tuple(r) for r in docs], 10)


@pytest.mark.parametrize("few_rows", [1, 5, 10_000])
@pytest.mark.parametrize("bits", [16, 3])
def test_selection(spark, few_rows, bits, monkeypatch):
    """Ties at the k-th value, items that begin alike or are each other's beginnings, groups of fewer rows."""
    monkeypatch.setattr(divergence, "BITS", bits)
    rng = random.Random(few_rows)
    data = []
    for g in range(6):
        items = {"same/start/" * rng.randint(0, 2) + "".join(rng.choices("abéÿ", k=rng.randint(0, 5))) for _ in range((3, 60)[g % 2 or g > 3])}
        data += [(g, rng.choice([0, 7, 7, 7, 2**33] if g < 5 else [4]), x) for x in sorted(items)]
    table = spark.createDataFrame(data, "g int, v long, item string")
    got = {(r.g, r.item, r["rank"]) for r in divergence.radix_top(table, ["g"], "v", "item", 8, few_rows=few_rows).collect()}
    want = set()
    for g in range(6):
        mine = sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2].encode()))
        want |= {(g, item, i + 1) for i, (_, _, item) in enumerate(mine[:8])}
    assert got == want
    assert divergence.radix_top(table.filter(F.lit(False)), ["g"], "v", "item", 8).count() == 0
