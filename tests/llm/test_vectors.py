"""op12 and op13 against all pairs, and what takes part in them."""

import math
import random

import numpy as np
import pytest
from cairnkb.llm import negatives, onebit, queries
from pyspark.sql import functions as F

ODD = [(900, None, 1), (901, [1.0, None], 1), (902, [math.nan, 1.0], 1), (903, [math.inf, 1.0], 2), (904, [0.0] * 8, 2), (905, [], 1), (906, [1.0] * 8, None), (None, [0.5] * 8, 1), (907, [2.0] * 5, 1), (908, [1.5] * 5, 2), (920, [1.0] * 5, 1)]


def rows(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<float>, label int, score string").repartition(3)


def vectors(seed, n, copies=0):
    """Clustered vectors, some far longer than others; the last ``copies`` are the first one again."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, 8))
    found = (centres[rng.integers(0, 5, n)] + 0.4 * rng.standard_normal((n, 8))) * rng.choice([0.01, 1, 1, 1, 5], n)[:, None]
    found[len(found) - copies :] = found[0]
    return [(i, x.astype(np.float32).tolist(), int(rng.integers(0, 3))) for i, x in enumerate(found)]


def own(data):
    """Those that take part, once each."""
    fine = [r for r in data if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return list({(r[0], tuple(r[1]), r[2]): r for r in fine}.values())


def plain_negatives(data, every, k=5):
    data = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in own(data) if y is not None]
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1], strict=True))
    key = lambda x: (-x[0], x[1] is None, x[1])
    out = []
    for a in data:
        if a[0] is None or a[0] % every:
            continue
        others = [(score(a, b), b[0], b[2] == a[2]) for b in data if b[0] != a[0] and len(b[1]) == len(a[1])]
        for p, pid, _ in sorted((x for x in others if x[2]), key=key)[:k]:
            fit = sorted((x for x in others if not x[2] and 80 * p <= 100 * x[0] <= 100 * p), key=key)[:k]
            out += [(a[0], pid, i + 1, n, p, s) for i, (s, n, _) in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("least, block", [(1024, 16384), (40, 60)])
def test_negatives(spark, least, block, monkeypatch):
    """One part, and many parts of several blocks, asked by anchors in chunks."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ASKED", block)
    monkeypatch.setattr(negatives, "LEAF", 16)
    data = vectors(3, 900, copies=300) + ODD + vectors(3, 3) + [(10, [0.3] * 8, 2)]
    got = negatives.mine(rows(spark, data), F.col("id") % 10 == 0, least=least).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_negatives(data, 10)
    assert len({r.anchor_id for r in got}) > 30


def test_negatives_whose_scores_are_large(spark):
    data = [(i, [x * 2**17 for x in v], y) for i, v, y in vectors(5, 300)] + [(400, [3e30] * 8, 1)]
    got = negatives.mine(rows(spark, data), F.col("id") % 10 == 0).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_negatives(data[:-1], 10)
    assert max(r.positive_score for r in got) > 2**53


def plain_nearest(data, every, k):
    data = [(i, v) for i, v in {(i, tuple(v)) for i, v, _ in own(data)} if any(v)]
    out = []
    for q in data:
        if q[0] is None or q[0] % every:
            continue
        scores = []
        for i, v in data:
            if i != q[0] and len(v) == len(q[1]):
                total = 0.0
                for x, y in zip(q[1], v, strict=True):
                    total += x * y
                scores.append((-total, i is None, i))
        out += [(q[0], r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [32768, 64])
def test_neighbours(spark, block, monkeypatch):
    """Exactly the nearest, on clustered vectors with copies, in one block or many."""
    monkeypatch.setattr(onebit, "QUERIES", block)
    monkeypatch.setattr(onebit, "_STEP", block)
    data = vectors(7, 700, copies=200) + ODD + vectors(7, 3)
    got = onebit.nearest(rows(spark, data), F.col("id") % 10 == 0, 6, block=block).collect()
    want = plain_nearest(data, 10, 6)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert len(want) > 400


def test_recall_and_rescoring():
    """On unit vectors of no structure, the hardest case: recall, and what part of all rows is scored in full."""
    rng = np.random.default_rng(1)
    v = rng.standard_normal((20_000, 64)).astype(np.float32).astype(np.float64)
    v /= np.sqrt((v**2).sum(1))[:, None]
    ids, asked = np.arange(len(v)), v[:200]
    scored, inner = [], onebit.inner
    codes = onebit.encode(v, v.mean(0), onebit.code_bits(64))
    try:
        onebit.inner = lambda a, b, i, j: scored.append(len(i)) or inner(a, b, i, j)
        query, row, score = onebit.search_block(asked, ids[:200], v, ids, codes, v.mean(0), 20, onebit.SPREADS)
    finally:
        onebit.inner = inner
    exact = asked @ v.T
    exact[np.arange(200), np.arange(200)] = -np.inf
    true = np.argsort(-exact, axis=1)[:, :20]
    hits = sum(len(set(row[query == i]) & set(true[i])) for i in range(200))
    print("recall", hits / 4000, "scored", sum(scored) / exact.size)
    assert hits / 4000 > 0.999
    assert sum(scored) / exact.size < 0.2
    estimate = (np.unpackbits(codes[0], axis=1) * 2.0 - 1) @ (onebit.rotation(64, onebit.code_bits(64)) @ v[0]) * codes[1] + v.mean(0) @ v[0]
    off = np.abs(estimate - v @ v[0]) > onebit.SPREADS * codes[2]
    assert off.mean() < 0.01


def test_recall_of_the_query(spark, sf_dir):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {(r.query_id, r.vec_id) for r in queries.op13_neighbours(spark, sf_dir).collect()}
    want = {(q, i) for q, _, i, _ in plain_nearest(data, 20, 20)}
    assert len(got & want) / len(want) >= 0.9
    hard = queries.op12_negatives(spark, sf_dir).collect()
    shifted = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in data]
    assert sorted([tuple(r) for r in hard], key=str) == plain_negatives(shifted, 100)


def test_empty(spark):
    none = rows(spark, vectors(1, 3)).limit(0)
    assert negatives.mine(none, F.col("id") % 10 == 0).count() == 0
    assert onebit.nearest(none, F.col("id") % 10 == 0).count() == 0
    alone = rows(spark, [(0, [1.0, 2.0], 1)])
    assert negatives.mine(alone, F.col("id") % 10 == 0).count() == 0
    assert onebit.nearest(alone, F.col("id") % 10 == 0).count() == 0


@pytest.mark.parametrize("copies", [0, 900])
def test_tree_holds_every_row_once(copies):
    points = np.array([x[1] for x in vectors(2, 1000, copies)])
    tree = negatives.Tree(points, 10)
    assert sorted(tree.order.tolist()) == list(range(1000))
    rng = random.Random(1)
    for at in rng.sample(range(len(tree.nodes)), min(5, len(tree.nodes))):
        assert tree.nodes[at][3] <= tree.nodes[at][0] and tree.nodes[at][5] >= tree.nodes[at][0]
