"""Exact quantiles by repeated narrowing of histograms, and distinct counts kept by day and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared

#: Bins of a histogram, and distinct values of a bin that are sorted as they are.
BINS, FEW = 1024, 1024
#: Ranks that are broadcast (some 60 bytes each); more are joined by a shuffle.
BROADCAST_RANKS = 1_000_000


def exact(rows: DataFrame, keys: list[str], value: str, probabilities: Sequence[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """``(keys, n, q0, q1, ...)``: each group's number of values and its quantiles, between two values in proportion.

    Equal values of a group are counted first. Each round puts the values of the bin that
    holds a rank into ``bins`` bins of equal width, so that no group is gathered or sorted:
    what is at last ranked is ``few`` distinct values of a bin. Nulls and NaN do not count; a
    group without values has no row. Null keys are a group like others.
    """
    spark = rows.sparkSession
    names = [f"_g{i}" for i in range(len(keys))]
    own = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    own = own.select(F.struct(*names).alias("g") if names else F.lit(0).alias("g"), (F.col("v") + 0.0).alias("v"))

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = shared(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    counted = kept(own.groupBy(F.hash("g").alias("h"), "g", "v").agg(F.count("*").alias("w")), "values")
    groups = counted.groupBy("h", "g").agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("distinct"))
    at = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(p)), F.ceil(at(p))) for p in probabilities])))
    open_ = kept(groups.select("h", "g", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi", "distinct"), "ranks")
    n_ranks = open_.count()
    cheap = F.broadcast if n_ranks <= BROADCAST_RANKS else lambda x: x
    same = lambda a, b: a["h"].eqNullSafe(b["h"]) & a["g"].eqNullSafe(b["g"])
    found = None
    while True:
        known = open_.filter((F.col("lo") == F.col("hi")) | (F.col("distinct") <= few))
        met = counted.join(cheap(known.withColumnsRenamed({"h": "_h", "g": "_of"})), (counted["h"] == F.col("_h")) & counted["g"].eqNullSafe(F.col("_of")) & F.col("v").between(F.col("lo"), F.col("hi")))
        upto = F.sum("w").over(Window.partitionBy("_h", "_of", "rank").orderBy("v")) + F.col("below")
        got = kept(met.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("w"))).select(F.col("_h").alias("h"), F.col("_of").alias("g"), "rank", "v"), "found")
        found = got if found is None else found.unionByName(got)
        rest = kept(open_.filter((F.col("lo") < F.col("hi")) & (F.col("distinct") > few)), "open").withColumnsRenamed({"h": "_h", "g": "_of"})
        if rest.isEmpty():
            break
        place = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
        within = counted.join(cheap(rest), (counted["h"] == F.col("_h")) & counted["g"].eqNullSafe(F.col("_of")) & F.col("v").between(F.col("lo"), F.col("hi")))
        hist = within.groupBy(F.col("_h").alias("h"), F.col("_of").alias("g"), "rank", "below", place.alias("bin")).agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("distinct"))
        before = F.coalesce(F.sum("w").over(Window.partitionBy("h", "g", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
        inside = hist.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("w")))
        open_ = kept(inside.select("h", "g", "rank", F.col("before").alias("below"), "lo", "hi", "distinct"), "ranks")
    values = found.groupBy("h", "g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    other = values.withColumnsRenamed({"h": "_h", "g": "_of"})
    both = groups.join(other, (groups["h"] == other["_h"]) & groups["g"].eqNullSafe(other["_of"]))

    def quantile(p: float) -> Column:
        low, high = F.try_element_at("at", F.floor(at(p))), F.try_element_at("at", F.ceil(at(p)))
        return F.when(F.floor(at(p)) == F.ceil(at(p)), low).otherwise((F.ceil(at(p)) - at(p)) * low + (at(p) - F.floor(at(p))) * high)

    return both.select(*[F.col(f"g.{n}").alias(k) for n, k in zip(names, keys, strict=True)], "n", *[quantile(p).alias(f"q{i}") for i, p in enumerate(probabilities)])


def bitmaps(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``(keys, bucket, bits)``: the distinct numbers (longs) of each group as bitmaps of 32,768 numbers, to be kept and merged."""
    bucket, place = F.bitmap_bucket_number(number), F.bitmap_bit_position(number)
    return rows.filter(F.col(number).isNotNull()).groupBy(*keys, bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))


def merged(maps: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n)``: the exact distinct counts over the bitmaps of many groups, such as days."""
    whole = maps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("n"))
