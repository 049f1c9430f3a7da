"""Numbers without gaps, continued from run to run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared
from ..sources.tables import KeyedTable


def next_numbers(rows: DataFrame, marks: KeyedTable, name: str, column: str = "number", batch: int | None = None) -> DataFrame:
    """``rows`` with ``column``: 1 and on, or on from the last number that ``marks`` has for ``name``; each number once.

    ``marks`` is a table ``(name, last)`` keyed by name. Rows are written with their place in
    their partition; what precedes a partition is the sum of the counts of those before, a row
    for each partition. The mark is moved before the rows are returned, so a run that fails
    later leaves a gap and never a number twice. With ``batch``, a batch given again gets the
    numbers that it had, as long as its mark is the last.
    """
    spark = rows.sparkSession
    path = shared(spark, "numbered")
    rows.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.schema(rows.schema).schema(rows.withColumn("_at", F.lit(0).cast("long")).schema).parquet(path)
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = marks.read().filter(F.col("name") == name).first() if marks.versions() else None
    last = known["last"] if known else 0
    if batch is not None and known and known["batch"] == batch:
        last -= total
    else:
        marks.upsert(spark.createDataFrame([(name, last + total, batch)], "name string, last long, batch long"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    number = F.lit(last) + F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.withColumn(column, number).drop("_part", "_before", "_at")
