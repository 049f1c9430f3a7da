"""BM25 against a plain version, in small slices and blocks of questions; nothing is joined by question and document."""

import math
import random
from collections import Counter

from cairnkb.functions import stem
from cairnkb.operators import bm25, text
from pyspark.sql import functions as F


def plain(docs, asked, k):
    words = [(d, (t or "").split()) for d, t in docs]
    n, avgdl = len(words), sum(len(w) for _, w in words) / len(words)
    df = Counter(w for _, ws in words for w in set(ws))
    raw = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    mean = sum(raw.values()) / len(raw)
    counts, scores = Counter(), Counter()
    for d, ws in words:
        counts.update((d, len(ws), w) for w in ws)
    for q, t in asked:
        for w, m in Counter((t or "").split()).items():
            for (d, dl, x), tf in counts.items():
                if x == w:
                    scores[q, d] += m * (raw[w] if raw[w] >= 0 else mean / 4) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    out = []
    for q in {q for q, _ in asked}:
        best = sorted((-round(s, 6), d) for (x, d), s in scores.items() if x == q and round(s, 6) > 0)[:k]
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(best)]
    return sorted(out)


def test_slices_blocks_and_repeated_ids(spark, monkeypatch):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % 50}" for _ in range(n))
    docs = [(i, say(rng.choice([3, 12, 12]))) for i in range(80)] + [(5, say(3)), (5, say(12)), (6, None), (200, ""), (201, "w1 w2"), (202, "w1 w2"), (203, "w1 w2")]
    asked = [(i, say(4)) for i in range(12)] + [(50, "nowhere"), (51, None), (52, "w1 w1 w2")]
    want = plain(docs, asked, 4)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    for rows, cells in ((1_000_000, 2_000_000), (9, 30)):
        monkeypatch.setattr(bm25, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(bm25, "CELLS", cells)
        found = bm25.bm25_topk(a, b, 4)
        assert sorted(tuple(r) for r in found.collect()) == want
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_stemmed_terms(spark):
    texts = ["Les maisons chantaient, maison", "", None, "continuellement CamelWord été", "maisons maisons"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(text.terms(F.col("text")).alias("t"), text.stemmed_terms(F.col("text")).alias("s"))
    for r in rows.coalesce(1).collect():
        stems = [stem.stem(w) for w in r.t if len(w) > 3 and w.islower() and w.isalpha()]
        assert r.s == r.t + list(dict.fromkeys(s for s in stems if s not in r.t))
