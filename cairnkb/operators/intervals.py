"""Joins of intervals by overlap, through bins of time; counts and minima over intervals, without pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Left intervals of a bin that meet its right ones in one group; bins with more are split. Bins known to be hot that are broadcast.
HOT, BROADCAST_BINS = 10_000, 1_000_000


def overlaps(left: DataFrame, right: DataFrame, start: str, stop: str, width: int, by: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """The pairs of rows whose closed intervals ``[start, stop]`` (longs) share a point: struct columns ``left`` and ``right``.

    Both sides are cut at multiples of ``width`` and joined where they share a bin and the
    columns ``by``; a pair comes from the first bin that both are in. An interval is sent to
    as many bins as it is long, so ``width`` should be near the usual length. The left side of
    a bin with more than ``hot`` intervals is dealt to several groups, and the right side
    copied to each. Rows with a null end, or a start after the stop, overlap nothing.
    """

    def binned(rows: DataFrame, name: str) -> DataFrame:
        whole = F.struct(*rows.columns).alias(name)
        bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))
        return rows.filter(F.col(start) <= F.col(stop)).select(*by, whole, F.explode(bins).alias("bin"))

    key = [*by, "bin"]
    a, b = binned(left, "left"), binned(right, "right")
    crowded = a.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > hot).select(*key, F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    few = F.broadcast if crowded.limit(BROADCAST_BINS + 1).count() <= BROADCAST_BINS else lambda x: x
    parts: Column = F.coalesce("parts", F.lit(1))
    a = a.join(few(crowded), key, "left").withColumn("part", F.pmod(F.xxhash64("left"), parts).cast("int")).drop("parts")
    b = b.join(few(crowded), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    met = a.join(b, [*key, "part"])
    first = F.floor(F.greatest(f"left.{start}", f"right.{start}") / width)
    share = (F.col(f"left.{start}") <= F.col(f"right.{stop}")) & (F.col(f"right.{start}") <= F.col(f"left.{stop}"))
    return met.filter(share & (F.col("bin") == first)).select("left", "right")


def summed_within(ranges: DataFrame, points: DataFrame, by: tuple[str, ...], low: str, high: str, at: str, value: str) -> DataFrame:
    """``(*by, n, least)`` for each row of ``ranges``: how many ``points`` have ``low <= at <= high`` (longs), and their least ``value``.

    No pairs are formed. A range of 2^j to 2^(j+1) - 1 instants is put together from bins of
    2^j: the end of its first, the beginning of its last, and the one between, if there is one.
    Each is a running count and minimum over a bin's points in order. Points are repeated
    twice for each j among the ranges. Ranges of equal ``by`` are one row; those without a
    point have none.
    """
    level = (F.length(F.bin(F.col(high) - F.col(low) + 1)) - 1).cast("int")
    asked = ranges.filter(F.col(low) <= F.col(high)).select(*by, F.col(low).alias("low"), F.col(high).alias("high"), level.alias("level"))
    levels = sorted(r[0] for r in asked.select("level").distinct().collect())
    width = F.expr("shiftleft(1L, level)")
    first, last = F.expr("low - pmod(low, shiftleft(1L, level))"), F.expr("high - pmod(high, shiftleft(1L, level))")

    def probe(bin_: Column, from_: Column, back: bool) -> Column:
        """What is asked in a bin: all from an instant on (``back``), or all up to it."""
        return F.struct(bin_.alias("bin"), (-from_ if back else from_).alias("place"), F.lit(back).alias("back"))

    middle = F.when(last - first > width, F.array(probe(first + width, first + width, True))).otherwise(F.array())
    probes = F.concat(F.array(probe(first, F.col("low"), True)), F.when(last > first, F.array(probe(last, F.col("high"), False))).otherwise(F.array()), middle)
    asks = asked.select(F.struct(*by).alias("of"), "level", F.explode(probes).alias("p")).select("of", "level", "p.*", F.lit(None).cast(points.schema[value].dataType).alias("value"), F.lit(1).alias("kind"))

    each = points.filter(F.col(at).isNotNull()).select(F.col(at).alias("at"), F.col(value).alias("value"), F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")).alias("level"), F.lit(0).alias("kind"))
    each = each.select("value", "level", "kind", "at", F.expr("at - pmod(at, shiftleft(1L, level))").alias("bin"), F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    each = each.withColumn("place", F.when(F.col("back"), -F.col("at")).otherwise(F.col("at"))).withColumn("of", F.lit(None).cast(asks.schema["of"].dataType))
    order = Window.partitionBy("level", "bin", "back").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = asks.unionByName(each.select(*asks.columns)).withColumns({"n": F.sum(1 - F.col("kind")).over(order), "least": F.min("value").over(order)})
    found = met.filter("kind = 1 and n > 0").select("of.*", "n", "least")
    return found.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"))
