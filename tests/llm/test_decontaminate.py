"""op2 against a plain version: windows, blocks, edges."""

import hashlib
import random
import re

import pytest
from cairnkb.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def want(docs, items, size):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item or "")
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for window, of in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= of
        names = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [500_000, 7])
def test_brute_force(spark, block):
    rng = random.Random(3)
    vocabulary = ["the", "The", "a", "red-fox", "fox", "é7", "9", "end.", "İx"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [("i1", text(9)), ("i2", "Fox a"), ("i3", None), ("i4", ""), (None, text(6)), ("i1", text(7)), ("i5", "zebra")]
    docs = [(i, text(rng.randint(0, 40))) for i in range(30)] + [(40, None), (41, ""), (None, "fox A"), (42, text(2000) + " fox a"), (42, "fox a")]
    table = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, n_words string, k1 int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.contamination(table, bench, 5, block)
    assert got.columns == [*table.columns, "contamination"]
    assert sorted([tuple(r) for r in got.select("doc_id", "contamination.*").collect()], key=str) == want(docs, items, 5)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    r = decontaminate.contamination(docs, bench).first().contamination
    assert (r.n_words, r.n_hit, r.contaminated) == (2, 0, False)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
