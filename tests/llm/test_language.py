"""op9: held-out accuracy, mixtures, rejects, and training, EM and choice against a plain version."""

import math
import random
import zlib
from collections import Counter

import corpus_pipeline
from cairnkb.llm import language, queries


def test_held_out_accuracy(spark, sf_dir):
    docs = queries.documents(spark, sf_dir, "doc_id", "lang")
    rows = queries.op9_language(spark, sf_dir).join(docs, "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 10
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures_and_rejects(spark, sf_dir):
    train = queries.documents(spark, sf_dir, "doc_id", "text", "lang")
    best = {r.lang: r.text for r in train.filter("length(text) > 1500").collect()}
    mixed = best["en"][:1500] + " " + best["de"][:1500]
    rows = [(1, None, 0), (2, "", 0), (3, "12 !?", 0), (None, best["fr"], 0), (5, mixed, 0), (6, "日本語", 0), (7, best["en"] * 50, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {r.doc_id: r.language for r in language.with_language(docs, train).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[None].lang_pred == "fr" and got[7].lang_pred == "en"
    assert {x.split(":")[0] for x in got[5].languages.split(",")} == {"en", "de"}
    assert got[6].lang_pred in best


def plain_trigrams(text):
    """Counts of hashed byte trigrams with at most one blank, one trigram at a time."""
    low = text.lower().encode("utf-8")
    data = b" " + bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in low) + b" "
    counts = Counter()
    for i in range(len(data) - 2):
        gram = data[i : i + 3]
        if gram.count(b" ") < 2:
            counts[int.from_bytes(gram, "big") * 2654435761 % 2**32 >> 16] += 1
    return counts


def plain_model(rows):
    sums = {}
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 5:
            sums.setdefault(lang, Counter()).update(plain_trigrams(text))
    buckets, smoothing = language.BUCKETS, language.SMOOTHING
    return {x: (c, sum(c.values()) + smoothing * buckets) for x, c in sorted(sums.items())}


def plain_em(counts, model, names):
    """Proportions and log-likelihood of a mixture of ``names``."""
    chance = {g: [(model[x][0][g] + language.SMOOTHING) / model[x][1] for x in names] for g in counts}
    share, total = [1 / len(names)] * len(names), sum(counts.values())
    for _ in range(language.ROUNDS):
        new = [0.0] * len(names)
        for g, n in counts.items():
            whole = sum(p * q for p, q in zip(chance[g], share, strict=True))
            for i, p in enumerate(chance[g]):
                new[i] += n * p * share[i] / whole / total
        moved, share = max(abs(a - b) for a, b in zip(new, share, strict=True)), new
        if moved < 1e-3:
            break
    return share, sum(n * math.log(sum(p * q for p, q in zip(chance[g], share, strict=True))) for g, n in counts.items())


def plain_set(text, model):
    """The languages chosen for a text, with their proportions: more as long as they pay the penalty."""
    counts, names = plain_trigrams(text), list(model)
    penalty = math.log(max(2.0, sum(counts.values()) / language.OVERLAP))
    share, _ = plain_em(counts, model, names)
    order = sorted(names, key=lambda x: -share[names.index(x)])
    alone = {x: plain_em(counts, model, [x])[1] for x in names}
    best = max(names, key=alone.get)
    value, chosen = alone[best], {best: 1.0}
    for k in range(2, len(names) + 1):
        part, reached = plain_em(counts, model, order[:k])
        if 2 * (reached - value) / language.OVERLAP <= penalty:
            break
        value, chosen = reached, dict(zip(order[:k], part, strict=True))
    return chosen


def test_against_plain_version(spark, sf_dir):
    train = queries.documents(spark, sf_dir)
    rows = train.select("doc_id", "text", "lang").collect()
    model = plain_model(rows)
    names, logs = language.train(train)
    assert names == list(model)
    for i, x in enumerate(names):
        counts, total = model[x]
        for g in [*list(counts)[:200], 0, 1]:
            assert abs(logs[i][g] - math.log((counts[g] + language.SMOOTHING) / total)) < 1e-4

    by = {x: [r.text for r in rows if r.lang == x and r.text and len(r.text) > 300] for x in names}
    texts = [t[0][:500] for t in by.values()] + [by[a][1][:300] + " " + by[b][1][:300] for a in names for b in names if a < b]
    texts += [by[names[0]][2][:400] + " " + by[names[1]][2][:60], " ".join(by[x][0][:250] for x in names[:3])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    several = 0
    for r in language.with_language(docs, train).collect():
        want = plain_set(r.text, model)
        got = {x.split(":")[0]: float(x.split(":")[1]) for x in r.language.languages.split(",")}
        assert r.language.lang_pred == max(want, key=want.get)
        if len(want) > 1:
            several += 1
            assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 0.005 for x in want)
            assert abs(r.language.score - max(want.values())) < 0.005
        else:
            assert got.keys() == want.keys()
    assert several >= 5


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.with_language(docs, none).first().language.lang_pred == "und"
    assert language.with_language(docs.limit(0), none).count() == 0


def test_stage_rejects_what_no_language_explains(spark, sf_dir):
    train = queries.documents(spark, sf_dir)
    rng = random.Random(4)
    junk = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=400)), "日本語の文章はここにあります。" * 20]
    bad = spark.createDataFrame([(10**9 + i, t, "source") for i, t in enumerate(junk)], "doc_id long, text string, source string")
    kept = corpus_pipeline.language_id(spark, train.unionByName(bad, allowMissingColumns=True), sf_dir)
    assert kept.filter(f"doc_id >= {10**9}").count() == 0
    assert kept.count() == train.count()


def test_stage_keeps_lettered_texts_where_nothing_was_learned(spark, sf_dir):
    rows = [(1, "clean words", None), (2, "12 !?", None), (3, None, None), (None, "held out words", "en")]
    for seen in (rows, [*rows, (4, "other", "fr"), (6, "99", "de")]):
        docs = spark.createDataFrame(seen, "doc_id long, text string, lang string")
        got = {r.text for r in corpus_pipeline.language_id(spark, docs, sf_dir).collect()}
        assert got == {t for _, t, _ in seen if t and any(c.isalpha() for c in t)}
