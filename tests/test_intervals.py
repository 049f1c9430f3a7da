"""Counts and minima over intervals against all pairs, and no more rows on the way than there are points and intervals."""

import random

from cairnkb.operators import intervals
from pyspark.sql import functions as F


def test_summed_within(spark):
    rng = random.Random(2)
    ranges = [(i % 90, lo := rng.randrange(-3000, 3000), lo + rng.choice([0, 1, 2, 7, 8, 63, 900, 5000])) for i in range(150)] + [(200, 5, 4), (201, None, 4), (None, 0, 15), (203, 16, 31)]
    points = [(rng.randrange(10_000), rng.randrange(-3500, 3500)) for _ in range(800)] + [(1, 31), (1, 31), (7, None), (None, 16)]
    want = {}
    for key, lo, hi in ranges:
        for value, at in points:
            if None not in (lo, at) and lo <= at <= hi:
                n, least = want.get(key, (0, None))
                want[key] = (n + 1, least if value is None else value if least is None else min(least, value))
    a, b = spark.createDataFrame(ranges, "key int, lo long, hi long"), spark.createDataFrame(points, "value long, at long")
    found = intervals.summed_within(a, b, ("key",), "lo", "hi", "at", "value")
    assert {r.key: (r.n, r.least) for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert intervals.summed_within(a.limit(0), b, ("key",), "lo", "hi", "at", "value").count() == 0


def test_many_in_one_place(spark):
    """20,000 intervals and points that all meet: 400 million pairs."""
    rows = spark.range(20_000)
    found = intervals.summed_within(rows.select("id", F.lit(0).cast("long").alias("lo"), F.lit(700).cast("long").alias("hi")), rows.select((F.col("id") % 500).alias("at"), "id"), ("id",), "lo", "hi", "at", "id")
    assert found.agg(F.count("*"), F.min("n"), F.max("n"), F.max("least")).first()[:] == (20_000, 20_000, 20_000, 0)
