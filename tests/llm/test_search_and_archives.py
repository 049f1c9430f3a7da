"""op6 and op7 against plain versions."""

import hashlib
import random

import pytest
from cairnkb.llm import hamming, warc
from pyspark.sql import functions as F


def signed(v):
    return v - 2**64 if v >= 2**63 else v


@pytest.mark.parametrize("hot", [hamming.HOT, 3])
def test_top_k(spark, hot):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(20)]
    codes = [(i, rng.choice(base) ^ (1 << rng.randrange(64)) if i % 3 else rng.getrandbits(64)) for i in range(400)]
    codes += [(1000 + i, base[0]) for i in range(30)]
    rows = spark.createDataFrame([(i, signed(c)) for i, c in codes] + [(None, 5)], "id long, code long")
    got = {}
    for r in hamming.top_k(rows.filter("id % 20 = 0"), rows, 7, hot).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.distance, r.id)
    for q, c in codes:
        if q % 20 == 0:
            want = sorted(((c ^ x).bit_count(), i) for i, x in codes if i != q)[:7]
            assert [got[q][k] for k in range(1, 8)] == want


def test_top_k_edges(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (2, 5)], "id long, code long")
    assert [(r.query_id, r.id, r.distance) for r in hamming.top_k(rows.filter("id = 1"), rows).collect()] == [(1, 2, 0)]
    assert hamming.top_k(rows.limit(0), rows).count() == 0
    assert hamming.top_k(rows, rows.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, -1.0, 2.0], "x"), (2, None, "x"), (3, [], "x")], "vec_id long, embedding array<double>, code string")
    assert {r.id: r.code for r in hamming.with_codes(vectors).collect()} == {1: 5, 3: 0}


def test_top_k_of_copies(spark):
    """Rows of one code, all of them queries; a row without code takes no part."""
    rows = spark.createDataFrame([(i, 77) for i in range(60)] + [(100, 78), (101, -1), (102, None)], "id long, code long")
    got = {}
    for r in hamming.top_k(rows, rows, 3, hot=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.distance))
    assert len(got) == 62
    for q in range(60):
        assert sorted(got[q]) == [(n + 1, i, 0) for n, i in enumerate([i for i in range(4) if i != q][:3])]
    assert sorted(got[100]) == [(1, 0, 2), (2, 1, 2), (3, 2, 2)]
    assert sorted(got[101]) == [(1, 0, 60), (2, 1, 60), (3, 2, 60)]


def test_merkle_audit_finds_what_differs(spark):
    digest = lambda i, v="": hashlib.sha256(f"{i}{v}".encode()).hexdigest()
    one = spark.createDataFrame([(0, i, digest(i), 10 * i, 10 * i + 10) for i in range(300)], "archive long, seq long, sha256 string, start long, stop long")
    other = one.filter("seq <> 299").withColumn("sha256", F.when(F.col("seq").isin(7, 130), F.lit(digest(7, "x"))).otherwise(F.col("sha256")))
    height = warc.levels(300)
    assert height == 3
    a, b, none = (warc.tree(x, height) for x in (one, other, one.limit(0)))
    assert sorted((r.seq, r.start, r.stop) for r in warc.audit(a, b, height).collect()) == [(7, 70, 80), (130, 1300, 1310), (299, 2990, 3000)]
    assert warc.audit(a, a, height).count() == 0
    assert warc.audit(none, none, height).count() == 0
    assert [(r.start, r.stop) for r in a.filter(f"level = {height}").collect()] == [(0, 3000)]


def test_records_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>"), (2, None, None), (3, "http://c", "x" * 100_000)], "page_id long, url string, html string")
    raw = b"".join(bytes(r.r) for r in pages.orderBy("page_id").select(warc.record(F.col("url"), F.col("html")).alias("r")).collect())
    (tmp_path / "a.warc").write_bytes(raw)
    got = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.url, r.body) for r in got] == [("http://a", "<p>é</p>"), ("", ""), ("http://c", "x" * 100_000)]
    assert got[-1].offset + got[-1].length == len(raw)


def test_damaged_archives_are_reported(spark, tmp_path):
    good = [b"WARC/1.0\r\nWARC-Target-URI: u%d\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n" % i for i in range(4)]
    broken = good[1].replace(b"Content-Length: 4\r\n", b"")
    raw = b"junk\r\n" + good[0] + broken + good[2].replace(b"body", b"bo") + good[3] + good[0][:-6]
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc").write_bytes(b"WARC/1.0\r\nno end")
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("path", "offset").collect()
    a = [r for r in rows if r.path.endswith("a.warc")]
    assert [(r.url, r.problem) for r in a] == [(None, "no record begins here"), ("u0", None), (None, "no length"), (None, "no end where the length says"), ("u3", None), (None, "cut short")]
    assert sum(r.length for r in a) == len(raw) and [r.problem for r in rows if r not in a] == ["the header does not end"]


def test_moved_ranges_are_found_where_contents_are_alike(spark):
    """An index that gives two records each other's place, and one that is a byte off from some record on."""
    one = spark.createDataFrame([(0, i, f"h{i}", 10 * i, 10 * i + 10) for i in range(40)], "archive long, seq long, sha256 string, start long, stop long")
    swapped = one.withColumns({c: F.when(F.col("seq") == 5, F.col(c) + 10).when(F.col("seq") == 6, F.col(c) - 10).otherwise(F.col(c)) for c in ("start", "stop")})
    late = one.withColumns({"start": F.when(F.col("seq") > 37, F.col("start") + 1).otherwise(F.col("start")), "stop": F.when(F.col("seq") > 36, F.col("stop") + 1).otherwise(F.col("stop"))})
    height = warc.levels(40)
    trees = [warc.tree(x, height) for x in (one, swapped, late)]
    assert [sorted(r.seq for r in warc.audit(trees[0], x, height, by="ranges").collect()) for x in trees] == [[], [5, 6], [37, 38, 39]]
    assert warc.audit(trees[0], trees[1], height).count() == 0


def test_report_edges(spark):
    schema = "page_id long, url string, html string, rotten string, archive string, seq int"
    assert warc.fixity_report(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None, "x", 0), (1, "u", "h", "h", "x", 0), (1, "u", "h", "h", "x", 0), (2, "u", "h", "", "x", 0)]
    r = warc.fixity_report(spark.createDataFrame(rows, schema)).first()
    assert (r.n_records, r.n_bad, r.bad_ids, r.root != r.replica_root) == (4, 1, "2", True)
    assert r.bad_ranges.endswith(f"-{r.n_bytes}")
    assert r.n_moved == 1 and r.index_root != r.replica_index_root
