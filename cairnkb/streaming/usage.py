"""Structured Streaming forms of the usage operators, over a folder of event files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship
from ..sources.tables import KeyedTable

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def events(spark: SparkSession, folder: str, files: str = "*.parquet") -> DataFrame:
    """The files of a folder as a stream of events, with ``ts`` as a timestamp (event times are taken in the session's zone)."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_usage(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Tumbling days by user; events later than ``late`` are left out in append mode."""
    day = F.window("ts", "1 day")
    return (
        stream.withWatermark("ts", late)
        .groupBy("user_id", day.alias("w"))
        .agg(F.sum(F.col("value").cast("long")).alias("prompt_tokens"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("completion_tokens"), F.count("*").alias("request_count"))
        .select("user_id", F.col("w.start").cast("date").alias("day"), "prompt_tokens", "completion_tokens", "request_count")
    )


def sliding_counts(stream: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("*").alias("n"))


def user_sessions(stream: DataFrame, gap: str = "8 hours", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("last_seen"))


def first_seen(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without those of an id seen before, within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def clicks_after_views(stream: DataFrame, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Each click with the same user's views at most ``within`` before it: a stream-stream join with bounded state."""
    views = stream.filter("event_type = 'view'").select(F.col("user_id").alias("viewer"), F.col("ts").alias("viewed"), F.col("event_id").alias("view_id")).withWatermark("viewed", late)
    clicks = stream.filter("event_type = 'click'").select("user_id", "ts", "event_id").withWatermark("ts", late)
    near = F.expr(f"user_id = viewer AND ts >= viewed AND ts <= viewed + INTERVAL {within}")
    return clicks.join(views, near)


def rate_limited(stream: DataFrame, limit: int = 10, window: float = 300.0) -> DataFrame:
    """The login limiter with state: at most ``limit`` accepted times a user, kept until they are ``window`` seconds old."""
    ship(stream.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        accepted = []
        for at in rows["at"]:
            times = [t for t in times if at - t < window * 1e6]
            accepted.append(len(times) < limit)
            if accepted[-1]:
                times.append(int(at))
        state.update((times,))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "accepted": accepted})

    attempts = stream.select("user_id", "event_id", F.unix_micros("ts").alias("at"))
    return attempts.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, accepted boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def upsert_into(path: str):
    """A foreachBatch function that adds each batch's daily usage to a table of versions below ``path``, once a batch."""

    def write(batch: DataFrame, number: int) -> None:
        from ..operators.usage import upsert

        spark, before = batch.sparkSession, f"{path}/v{number - 1:06d}"
        out = batch if number == 0 else upsert(spark.read.parquet(before), batch)
        out.write.mode("overwrite").parquet(f"{path}/v{number:06d}")

    return write


def merge_into(table: KeyedTable, writer: str = "usage"):
    """A foreachBatch function that adds each batch's daily usage to a table kept by user and day.

    Only the buckets that a batch touches are written anew, a batch that is given again changes
    nothing, and versions before the last two are deleted.
    """
    from ..operators.usage import upsert

    def write(batch: DataFrame, number: int) -> None:
        if table.upsert(batch, merge=upsert, writer=writer, batch=number):
            table.vacuum(2)

    return write
