"""Streaming queries run to the end of what is there: a stream over the events, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage as batch_usage
from ..session import shared
from ..sources.tables import KeyedTable
from ..streaming import limits, usage
from . import usage as usage_plans


def drained(stream: DataFrame, name: str, **conf: str) -> DataFrame:
    """All that a stream in append mode gives for its present input; output and checkpoint are in the shared folder.

    ``conf`` holds while the stream runs.
    """
    spark = stream.sparkSession
    path = shared(spark, name)
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.events(spark, sf_dir, "events.parquet")


def stream_daily_usage(spark, sf_dir):
    """The days that are over by the stream's watermark."""
    return drained(usage.daily_usage(events(spark, sf_dir), "0 seconds"), "daily").withColumn("day", F.col("day").cast("string"))


def stream_first_seen(spark, sf_dir):
    return drained(usage.first_seen(events(spark, sf_dir)), "first").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


def stream_sliding_counts(spark, sf_dir):
    found = drained(usage.sliding_counts(events(spark, sf_dir), late="0 seconds"), "sliding")
    return found.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("started"), "event_type", "n")


def stream_clicks_after_views(spark, sf_dir):
    return drained(usage.clicks_after_views(events(spark, sf_dir), "10 MINUTES"), "clicks").select("user_id", "event_id", "view_id")


def stream_rate_limit(spark, sf_dir):
    """``rate_limit`` on a stream: the attempts of the hours that are over by the watermark."""
    return drained(limits.rate_limited(limits.attempts(events(spark, sf_dir)), 2, 86_400_000_000), "limited", **limits.CONF)


def stream_account_lock(spark, sf_dir):
    found = drained(limits.account_lock(limits.attempts(events(spark, sf_dir)), 2, 172_800_000_000), "locked", **limits.CONF)
    return found.withColumn("failures", F.col("failures").cast("long"))


def stream_usage_upsert(spark, sf_dir):
    """The daily usage of a stream's batches, merged into a table; the last batch given twice changes nothing."""
    table = KeyedTable(spark, shared(spark, "daily"), ["user_id", "day"], 16)
    write, last = usage.merge_into(table), []

    def both(batch: DataFrame, number: int) -> None:
        write(batch, number)
        write(batch, number)
        last.append(number)

    facts = events(spark, sf_dir).select("user_id", F.col("ts").cast("date").alias("day"), F.col("value").cast("long").alias("prompt_tokens"), F.get_json_object("props", "$.k").cast("long").alias("completion_tokens"), F.lit(1).cast("long").alias("request_count"))
    facts.writeStream.foreachBatch(lambda batch, number: both(batch_usage.daily(batch), number)).option("checkpointLocation", shared(spark, "upsert-state")).trigger(availableNow=True).start().awaitTermination()
    return table.read().withColumn("day", F.col("day").cast("string"))


ORACLE = {
    "stream_rate_limit": f"SELECT x.* FROM ({usage_plans.ORACLE['rate_limit']}) x WHERE \"at\" < (SELECT epoch_us(max(ts)) // 3600000000 * 3600000000 FROM events WHERE event_type IN ('signup', 'error'))",
    "stream_account_lock": f"SELECT x.* FROM ({usage_plans.ORACLE['account_lock']}) x WHERE \"at\" < (SELECT epoch_us(max(ts)) // 3600000000 * 3600000000 FROM events WHERE event_type IN ('signup', 'error'))",
    "stream_usage_upsert": """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS completion_tokens, count(*) AS request_count
FROM events GROUP BY ALL""",
    "stream_daily_usage": """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS completion_tokens, count(*) AS request_count
FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) AS DATE) FROM events) GROUP BY ALL""",
    "stream_first_seen": "SELECT event_type, count(DISTINCT event_id) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY event_type",
    "stream_sliding_counts": """WITH w AS (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS started, event_type, count(*) AS n FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) GROUP BY ALL""",
    "stream_clicks_after_views": """SELECT c.user_id, c.event_id, v.event_id AS view_id FROM events c JOIN events v ON c.user_id = v.user_id AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 10 MINUTE
WHERE c.event_type = 'click' AND v.event_type = 'view'""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
