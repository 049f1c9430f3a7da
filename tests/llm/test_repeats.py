"""op1 and op3 against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from cairnkb.llm import queries, repeats, substrings, suffixes


def brute(parts: list, window: int) -> list[bool]:
    """For each sequence, which symbols a window covers that starts anywhere else too."""
    seen = Counter(tuple(p[i : i + window]) for p in parts for i in range(len(p) - window + 1))
    out = []
    for p in parts:
        gone = [False] * len(p)
        for i in range(len(p) - window + 1):
            if seen[tuple(p[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def want_bytes(rows, window, passage):
    data = [(t or "").encode() for _, t in rows]
    out = []
    for (doc, _), raw, gone, shared in zip(rows, data, brute(data, window), brute(data, passage), strict=True):
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest(), sum(shared)))
    return sorted(out, key=str)


def want_words(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    out = []
    for (doc, _), words, gone in zip(rows, split, brute(split, window), strict=True):
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed: int, alphabet: list[str], joint: str, n: int = 40):
    rng = random.Random(seed)
    shared = [joint.join(rng.choices(alphabet, k=30)) for _ in range(3)]
    rows = [(1, None), (2, ""), (None, "short"), (3, "é" * 50), (3, "é" * 50)]
    for i in range(n):
        parts = [joint.join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared))
        rows.append((10 + i, joint.join(parts)))
    rows += rows[-3:]
    return rows


@pytest.mark.parametrize(("seed", "window", "passage"), [(1, 12, 9), (2, 12, 12), (3, 40, 25)])
def test_bytes(spark, seed, window, passage):
    rows = texts(seed, list("ab") + ["é"], "")
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, p1 int, _ranges string")
    got = suffixes.dedup_bytes(docs, window, passage, with_text=True).collect()
    assert sorted([tuple(r)[:6] for r in got], key=str) == want_bytes(rows, window, passage)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = texts(seed, ["a", "b", "ccc", "é", "a b"], " ") + [(900, " \t lead  and\ntrail \x0b"), (901, "b \r\n a")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, p2 int")
    got = substrings.dedup_words(docs, 7, 2).collect()
    assert sorted([tuple(r) for r in got], key=str) == want_words(rows, 7)


def test_doubling():
    assert substrings.doubling(35) == (8, 16, 32, 35)
    assert substrings.doubling(8) == (8,)
    assert substrings.doubling(3) == (3,)


def test_long_text_and_segments(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh", k=60_000))
    rows = [(1, long), (2, long[30_000:31_000]), (3, "x" * 3000)]
    monkeypatch.setattr("cairnkb.llm.repeats.SEGMENT", 1 << 12)
    got = {r.doc_id: r for r in suffixes.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, got[3].n_removed) == (1000, 1, 1000, 3000)


def test_common_prefixes_of_sorted_suffixes(spark):
    rng = random.Random(3)
    rows = [(i, 0, rng.randrange(3), "".join(rng.choices("ab", k=rng.randint(0, 12))).encode()) for i in range(400)]
    found = suffixes.common_prefixes(spark.createDataFrame(rows, "p1 long, p2 long, gram long, key binary"))
    got = {r.p1: r.common for r in found.groupBy("p1").agg({"common": "max"}).withColumnRenamed("max(common)", "common").collect()}

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905

    assert got == {i: max(common(k, y) for j, _, h, y in rows if h == g and i != j) for i, _, g, k in rows}


@pytest.mark.parametrize("unit", ["x", "ab", "abc def "])
def test_periodic_text_takes_few_rows(spark, unit):
    text = unit * (1_000_000 // len(unit))
    docs = spark.createDataFrame([(1, text), (2, "y" + text[: 50_000])], "doc_id long, text string")
    parts = docs.selectExpr("doc_id p1", "0L p2", "cast(text as binary) data")
    assert repeats._cut(parts, suffixes.Bytes, 240, 48).count() < 500
    got = {r.doc_id: r for r in suffixes.dedup_bytes(docs).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans) == (len(text), 50_000, 1)
    words = {r.doc_id: r for r in substrings.dedup_words(docs).collect()}
    assert words[1].n_removed == (words[1].n_words if " " in unit else 0)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.dedup_bytes(docs).count() == 0
    assert substrings.dedup_words(docs).count() == 0


def test_op1_on_the_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf_dir, "doc_id", "text").collect()]
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(hash(p[i : i + 400]) for p in data for i in range(len(p) - 399))
    passages = Counter(hash(p[i : i + 240]) for p in data for i in range(len(p) - 239))
    got = {r.doc_id: r for r in queries.op1_suffixes(spark, sf_dir).collect()}
    for (doc, _), raw in zip(rows, data, strict=True):
        gone, shared = bytearray(len(raw)), bytearray(len(raw))
        for i in range(len(raw) - 239):
            if i + 400 <= len(raw) and seen[hash(raw[i : i + 400])] > 1:
                gone[i : i + 400] = b"\x01" * 400
            if passages[hash(raw[i : i + 240])] > 1:
                shared[i : i + 240] = b"\x01" * 240
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert (got[doc].n_removed, got[doc].n_shared, got[doc].kept_sha256) == (sum(gone), sum(shared), hashlib.sha256(kept).hexdigest())
