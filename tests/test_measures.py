"""Overlaps, quantiles, merged counts, limits on streams, headers and accents."""

import datetime as dt
import random
import unicodedata

import pytest
from cairnkb.functions import strings
from cairnkb.operators import intervals, quantiles, text, usage
from cairnkb.plans.streams import drained
from cairnkb.streaming import limits
from cairnkb.streaming import usage as streams
from pyspark.sql import functions as F


@pytest.mark.parametrize("hot", [10_000, 3])
def test_overlaps(spark, hot):
    rng = random.Random(1)
    make = lambda n: [(i, rng.choice([1, 1, 1, 2, None]), s, s + rng.choice([0, 3, 10, 40, -1])) for i in range(n) for s in [rng.choice([5, rng.randrange(100)])]]
    a, b = make(80), make(60) + [(99, 1, None, 5), (98, 1, 3, None)]
    left, right = (spark.createDataFrame(x, "id int, g int, a long, z long") for x in (a, b))
    met = intervals.overlaps(left, right, "a", "z", 10, ("g",), hot)
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and None not in y and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r[0], r[1]) for r in met.select("left.id", "right.id").collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("bins, few", [(1024, 1024), (4, 1)])
def test_quantiles(spark, bins, few):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.choice([0.0, -0.0, 1.5, rng.random() * 1e6, -rng.random(), 1e-300])) for _ in range(500)]
    data += [("c", 7.0)] * 50 + [("d", 1.0), ("e", None), ("a", None), ("a", float("nan"))]
    rows = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.n, r.q0, r.q1, r.q2) for r in quantiles.exact(rows, ["k"], "v", [0.0, 0.5, 0.9], bins, few).collect()}
    clean = rows.filter("v is not null and not isnan(v)").groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*[F.lit(x) for x in (0.0, 0.5, 0.9)])).alias("p"))
    want = {r.k: (r.n, *r.p) for r in clean.collect()}
    assert got.keys() == want.keys()
    for k, x in got.items():
        assert x == pytest.approx(want[k], rel=1e-12, abs=1e-300)
    assert quantiles.exact(rows.limit(0), ["k"], "v", [0.5]).count() == 0
    assert quantiles.exact(rows.filter("k = 'c'"), [], "v", [0.5]).first().q0 == 7.0


def test_merged_counts(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.randrange(3), rng.choice([rng.randrange(-50_000, 100_000), 7, None])) for _ in range(3000)]
    rows = spark.createDataFrame(data, "k string, day int, u long")
    kept = quantiles.bitmaps(rows, ["k", "day"], "u")
    got = {r.k: r.n for r in quantiles.merged(kept.filter("day < 2"), ["k"]).collect()}
    assert got == {k: len({u for x, d, u in data if x == k and d < 2 and u is not None}) for k in "ab"}


def _files(spark, folder, rows, n):
    for i in range(n):
        part = spark.createDataFrame(rows[i::n] if i < n - 1 else rows[n - 1 :: n], streams.EVENTS.replace("TIMESTAMP_NTZ", "TIMESTAMP")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        part.coalesce(1).write.mode("append").parquet(folder)


def test_streamed_limits_are_those_of_the_batch(spark, tmp_path):
    """Several files, out of order; what the watermark has passed is what the batch form gives for it."""
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=rng.randrange(40_000)), rng.randrange(6), rng.choice(["error", "error", "signup", "click"]), 1.0, "{}") for i in range(400)]
    _files(spark, str(tmp_path / "in"), rows, 1)
    tries = limits.attempts(streams.events(spark, str(tmp_path / "in")))
    plain = spark.read.parquet(str(tmp_path / "in")).filter("event_type in ('error', 'signup')")
    plain = plain.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") == "signup").alias("success"))
    over = plain.agg(F.floor(F.max("at") / 3_600_000_000) * 3_600_000_000).first()[0]
    for stream, batch in ((limits.rate_limited(tries, 2, 3_000_000_000), usage.rate_limited(plain, 2, 3_000_000_000)), (limits.account_lock(tries, 2, 3_000_000_000), usage.account_lock(plain, 2, 3_000_000_000))):
        got = drained(stream, "limits", **limits.CONF).collect()
        want = batch.filter(F.col("at") < over).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 200


def test_state_goes(spark, tmp_path):
    """After the window's end no user's accepted times are left in state, and no rows wait."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=i), i % 3, "error", 1.0, "{}") for i in range(30)]
    _files(spark, str(tmp_path / "in"), rows, 1)
    seen = []
    for n, at in enumerate([None, start + dt.timedelta(days=1)]):
        if at:
            _files(spark, str(tmp_path / "in"), [(1000, at, 99, "error", 1.0, "{}")], 1)
        tries = limits.attempts(streams.events(spark, str(tmp_path / "in")))
        for key, value in limits.CONF.items():
            spark.conf.set(key, value)
        query = limits.rate_limited(tries, 3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        states = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
        seen.append(states[-1])
        for key in limits.CONF:
            spark.conf.unset(key)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    assert seen[0] > seen[1]  # what is left is the one late row that waits


def test_headers(spark):
    head = "---\nid: 12\nnone: null\nalso: ~\nempty:\ntags:\n- a\n  - \"b c\"\n# a remark\ninline: [x, 'y z', ]\nnothing: []\nplain: a, b\nid: 'last'\n---\nbody\nkey: no"
    rows = spark.createDataFrame([(head,), ("no header",), (None,), ("---\nx: 1\n---\n",)], "t string").select(text.front_fields(F.col("t")).alias("f"), *[text.front_list(F.col("t"), x).alias(x) for x in ("tags", "plain", "inline", "none")])
    got = rows.collect()
    first = {k: (v["kind"], v["items"]) for k, v in got[0].f.items()}
    assert first == {
        "none": ("null", []), "also": ("null", []), "empty": ("null", []), "tags": ("list", ["a", "b c"]), "inline": ("list", ["x", "y z"]),
        "nothing": ("list", []), "plain": ("scalar", ["a, b"]), "id": ("scalar", ["last"]),
    }
    assert (got[0].tags, got[0].plain, got[0].inline, got[0].none) == (["a", "b c"], ["a", "b"], ["x", "y z"], [])
    assert got[1].f == got[2].f == {} and got[3].f["x"]["items"] == ["1"]


def test_long_sections_have_ordinals_of_their_own(spark):
    paragraph = "p" * 900
    body = "## Same\n" + "\n\n".join([paragraph] * 1500) + "\n## Same\n" + "\n\n".join(["q" * 900] * 1500)
    found = text.chunks(spark.createDataFrame([("a", body)], "path string, text string")).collect()
    assert len(found) == 3000 == len({r.ordinal for r in found}) == len({r.chunk_id for r in found})
    in_order = [r.text.removeprefix("## Same\n") for r in sorted(found, key=lambda r: r.ordinal)]
    assert in_order == ["p" * 900] * 1500 + ["q" * 900] * 1500


def test_accents(spark):
    words = ["š", "ā", "ő", "ș", "ễ", "Ǻ", "é", "ø", "日本", "Ünïcödé", "ASCII"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(strings.fold_accents(F.col("w"))).collect()]
    assert got == ["s", "a", "o", "s", "e", "A", "e", "", "", "Unicode", "ASCII"]
    assert all(unicodedata.normalize("NFD", a)[0] == p for a, p in zip(strings.ACCENTED, strings.PLAIN, strict=True))
