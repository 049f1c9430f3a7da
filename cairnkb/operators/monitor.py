"""Series of resource samples: peaks, averages, counters as differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def peaks(samples: DataFrame, key: str, value: str, interval: float, digits: int = 6) -> DataFrame:
    """By series the peak, the mean, both durations (n x interval; last - first) and whether any value is there."""
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(1e6)
    return samples.groupBy(key).agg(
        F.round(F.max(value), digits).alias("peak"), F.round(F.avg(value), digits).alias("mean"), F.count("*").alias("n"),
        F.round(F.count("*") * F.lit(interval), digits).alias("sampled_seconds"), F.round(seconds, digits).alias("spanned_seconds"),
        F.bool_or(F.col(value).isNotNull()).alias("has_values"),
    )


def since_first(samples: DataFrame, key: str, counter: str, order: list[str]) -> DataFrame:
    """With ``delta``: a counter less its first reading in the series."""
    first = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("delta", F.col(counter) - F.first(counter).over(first))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` of the same key at or before ``at``.

    Both sides are put in one order per key and the last value is carried on: one shuffle and
    one sort, no pairs. Rows of ``right`` at the same instant: the one of the largest ``tie``.
    """
    a = left.select("*", F.lit(1).alias("_side"))
    b = right.select(F.col(key), F.col(at), F.col(tie), F.col(value).alias("_value"), F.lit(0).alias("_side"))
    frame = Window.partitionBy(key).orderBy(at, "_side", tie).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn("as_of_value", F.last("_value", ignorenulls=True).over(frame)).filter("_side = 1").drop("_side", "_value")
