"""Sinks. A table is rewritten beside the old one and switched by path, never deleted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def version(df: DataFrame, root: str, number: int, *partition_by: str) -> str:
    """Write a new version of a table and return its path; readers switch once it is whole."""
    path = f"{root}/v{number:06d}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def session_log(df: DataFrame, path: str) -> None:
    """Nested JSON by day."""
    df.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").json(path)


def manifest(df: DataFrame, path: str) -> None:
    """A one-row table as JSON."""
    df.write.mode("overwrite").json(path)


def purge(rows: DataFrame, at: str, cutoff, path: str) -> int:
    """Write the rows not older than the cutoff to a new path and return how many were left out."""
    rows.filter(F.col(at) >= cutoff).write.mode("errorifexists").parquet(path)
    return rows.filter(F.col(at) < cutoff).count()


def cascade(parents: DataFrame, children: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the keys of ``gone``."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def transcript(messages: DataFrame) -> DataFrame:
    """``(conv_id, transcript)``: a conversation's messages in order as text; the conversation is what is gathered."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.upper("role"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("transcript"))


def html_report(results: DataFrame) -> DataFrame:
    """``(html)``: one table row a result, escaped."""
    from ..functions.strings import xml_escaped

    cell = lambda c: F.concat(F.lit("<td>"), xml_escaped(F.col(c).cast("string"), quotes=False), F.lit("</td>"))
    return results.select(F.concat(F.lit("<tr>"), *[cell(c) for c in results.columns], F.lit("</tr>")).alias("html"))
