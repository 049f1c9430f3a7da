"""Tables by key, the lexical index, cells of vectors: what they hold, and what they leave unread."""

import datetime as dt
import random

import numpy as np
import pytest
from cairnkb.operators import bm25, cells, lexical, ranking, sequences, usage
from cairnkb.sources.tables import KeyedTable
from cairnkb.streaming import usage as streams
from pyspark.sql import functions as F


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"], 8)
    rows = spark.range(100).select("id", (F.col("id") * 2).alias("v"), F.lit(1).alias("ts"))
    with pytest.raises(ValueError):
        table.read()
    assert table.upsert(rows, writer="w", batch=0)
    assert not table.upsert(rows.withColumn("v", F.lit(-1).cast("long")), writer="w", batch=0)
    assert table.upsert(rows.filter("id = 7").withColumn("v", F.lit(0).cast("long")), writer="w", batch=1)
    assert not table.upsert(rows, writer="w", batch=0)
    assert pairs(table.get(spark.createDataFrame([(7,), (8,), (700,)], "id long"))) == [(7, 0, 1), (8, 16, 1)]
    assert table.read().count() == 100 and table.read(1).filter("v = 14").count() == 1
    # later by timestamp only; of several rows of a key the latest
    new = spark.createDataFrame([(1, 11, 0), (2, 22, 5), (2, 23, 9), (2, 24, 3), (200, 1, 1)], "id long, v long, ts int")
    table.upsert(new, latest="ts")
    assert pairs(table.get(new)) == [(1, 2, 1), (2, 23, 9), (200, 1, 1)]
    table.delete(spark.range(50))
    assert table.read().count() == 51
    assert table.vacuum(1) > 0 and table.versions() == [4] and table.read().count() == 51
    table.delete(spark.range(300))
    assert table.read().count() == 0
    table.upsert(rows)
    assert table.read().count() == 100


def test_only_the_buckets_asked_for_are_read_and_written(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"], 16)
    rows = spark.range(1000).withColumn("v", F.col("id"))
    table.upsert(rows)
    one = table.get(rows.filter("id = 5"))
    assert len(one.inputFiles()) == 1 and len(table.read().inputFiles()) == 16
    before = table._listed()["folders"]
    table.upsert(rows.filter("id = 5").withColumn("v", F.lit(0).cast("long")))
    after = table._listed()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_streamed_upserts(spark, tmp_path):
    """Two files, two batches; a batch that comes again adds nothing, and only two versions are kept."""
    day = dt.date(2024, 1, 30)
    table = KeyedTable(spark, str(tmp_path / "daily"), ["user_id", "day"], 4)
    write = streams.merge_into(table)
    fact = lambda *x: spark.createDataFrame([(1, day, *x, 1)], "user_id long, day date, prompt_tokens long, completion_tokens long, request_count long")
    for n, x in enumerate([(100, 50), (20, 5)]):
        write(usage.daily(fact(*x)), n)
        write(usage.daily(fact(*x)), n)
    assert pairs(table.read()) == [(1, day, 120, 55, 2)]
    write(usage.daily(fact(1, 1)), 2)
    assert len(table.versions()) == 2


@pytest.mark.parametrize("block, first", [(64, 8), (2, 6)])
def test_lexical_index(spark, tmp_path, block, first):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([3, 20, 20, 200])))) for i in range(600)] + [(900, None), (901, "")]
    asked = [(i, " ".join(rng.choices(words, k=4))) for i in range(20)] + [(50, "w0 w0 w1"), (51, "nowhere"), (52, None), (53, "w399 w398 nowhere")]
    docs, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    path = str(tmp_path / "index")
    lexical.build(docs, path, block=block)
    found, report = lexical.search(spark, path, asked, 5, first=first)
    assert pairs(found) == pairs(bm25.bm25_topk(docs, asked, 5))
    r = report.first()
    print(r)
    assert r.postings_scored <= r.postings and r.blocks_read <= r.blocks
    if block == 2:
        assert r.postings_scored < 0.7 * r.postings
    none, _ = lexical.search(spark, path, asked.filter("query_id = 51"), 5)
    assert none.count() == 0


def test_lexical_search_once(spark, tmp_path, monkeypatch):
    """Postings are dealt out once for all questions, and rows of one doc_id are one document, whatever their lengths."""
    docs = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1 + i % 40))) for i in range(400)] + [(7, "w3 " * 90), (9, "w3 w5"), (9, "w3")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(i, "w3 w5 w7 w9 w11") for i in range(60)], "query_id long, text string")
    path = str(tmp_path / "index")
    lexical.build(docs, path, block=8)
    dealt, ranked = [], lexical._ranked
    monkeypatch.setattr(lexical, "_ranked", lambda lists, *x: dealt.append(lists.count()) or ranked(lists, *x))
    found, report = lexical.search(spark, path, asked, 5)
    assert pairs(found) == pairs(bm25.bm25_topk(docs, asked, 5))
    assert report.first().postings_scored <= report.first().postings
    lists = spark.read.parquet(f"{path}/postings").filter("term in ('w3', 'w5', 'w7', 'w9', 'w11')").count()
    assert dealt == [lists]


def test_cells(spark, tmp_path):
    """Clustered vectors: the same result as over all of them, and most cells are passed over."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 12)) * 3
    data = [(i, (centres[i % 30] + 0.3 * rng.standard_normal(12)).astype(np.float32).tolist()) for i in range(1500)]
    data += [(5000, None), (5001, [0.0] * 12), (5002, data[3][1]), (5003, [x * 2 for x in data[3][1]])]
    rows = spark.createDataFrame(data, "id long, embedding array<float>")
    path = str(tmp_path / "cells")
    cells.build(rows, path, 30)
    asked = rows.filter("id % 50 = 3 or id >= 5000").withColumnRenamed("id", "query_id")
    found, report = cells.search(spark, path, asked, 7)
    assert pairs(found) == pairs(ranking.cosine_topk(rows, asked, 7))
    total = report.agg(F.sum("cells"), F.sum("visited"), F.sum("rows"), F.sum("scored")).first()
    print(total)
    assert total[1] < total[0] / 4 and total[3] < total[2] / 4
    cells.build(rows.limit(0), str(tmp_path / "none"))
    few = spark.createDataFrame(data[:3], "id long, embedding array<float>")
    cells.build(few, str(tmp_path / "few"))
    assert pairs(cells.search(spark, str(tmp_path / "few"), asked, 7)[0]) == pairs(ranking.cosine_topk(few, asked, 7))


def test_next_numbers(spark, tmp_path):
    marks = KeyedTable(spark, str(tmp_path / "marks"), ["name"], 2)
    rows = spark.range(0, 1000, 1, 7)
    a = sequences.next_numbers(rows, marks, "a")
    assert sorted(r.number for r in a.collect()) == list(range(1, 1001))
    other = sequences.next_numbers(rows.limit(3), marks, "b")
    b = sequences.next_numbers(rows.limit(10), marks, "a", batch=4)
    again = sequences.next_numbers(rows.limit(10), marks, "a", batch=4)
    assert sorted(r.number for r in b.collect()) == sorted(r.number for r in again.collect()) == list(range(1001, 1011))
    assert sorted(r.number for r in other.collect()) == [1, 2, 3]
    assert sequences.next_numbers(rows.limit(0), marks, "a").count() == 0
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "Sort [_at" not in plan


def test_cells_are_read_in_any_slices(spark, tmp_path, monkeypatch):
    """A task's rows are those of a file and not of a cell: no row is dealt out before it is known to be near; all blocks and slices give the same."""
    rng = np.random.default_rng(7)
    data = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(600)] + [(700 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.5]) for i in range(30)]
    rows = spark.createDataFrame(data, "id long, embedding array<float>")
    asked = rows.filter("id % 40 = 3 or id > 727").withColumnRenamed("id", "query_id")
    path = str(tmp_path / "cells")
    monkeypatch.setattr(cells, "SAMPLE", 200)
    cells.build(rows, path, 8)
    want = pairs(ranking.cosine_topk(rows, asked, 7))
    for block, at_once in ((10_000, 2_000_000), (5, 40)):
        monkeypatch.setattr(cells, "QUERY_BLOCK", block)
        monkeypatch.setattr(cells, "PAIRS", at_once)
        found, _ = cells.search(spark, path, asked, 7)
        assert pairs(found) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(cell" not in plan and "MapInArrow" in plan
