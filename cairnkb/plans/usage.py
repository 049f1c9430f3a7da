"""Usage, session, limit and monitoring queries over ``events``, ``customer`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, strings
from ..operators import intervals, knowledge, monitor, ranking, usage
from ..sources import writers


def today() -> Column:
    """The day that the queries take for today; clocks would not repeat."""
    return F.lit("2024-01-30").cast("date")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "user_id", F.col("ts").cast("date").alias("day"), F.col("value").cast("long").alias("prompt_tokens"),
        F.get_json_object("props", "$.k").cast("long").alias("completion_tokens"), F.lit(1).cast("long").alias("request_count"),
    )


def _day(df: DataFrame, *columns: str) -> DataFrame:
    """Dates as text, so that results compare as written."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def usage_daily_rollup(spark, sf_dir):
    return _day(usage.daily(facts(spark, sf_dir)), "day")


def usage_upsert(spark, sf_dir):
    every = facts(spark, sf_dir)
    early = F.col("day") < "2024-01-15"
    return _day(usage.upsert(usage.daily(every.filter(early)), every.filter(~early)), "day")


def usage_30d_per_user(spark, sf_dir):
    return _day(usage.totals(usage.daily(facts(spark, sf_dir)), today()), "last_day")


def users_with_usage(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_name")
    joined = users.join(usage.totals(usage.daily(facts(spark, sf_dir)), today()), "user_id", "left")
    return joined.select(
        "user_id", "c_name", F.coalesce("tokens", F.lit(0)).alias("tokens"), strings.compact_count(F.coalesce("tokens", F.lit(0))).alias("shown"),
        strings.initials(F.col("c_name")).alias("initials"), dates.last_active(F.col("last_day"), today()).alias("last_active"),
    )


def usage_gap_filled(spark, sf_dir):
    daily = usage.daily(facts(spark, sf_dir))
    return _day(usage.gap_filled(daily, daily.select("user_id").distinct(), today(), 30), "day")


def usage_cube(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("ts").cast("date").cast("string").alias("day"), "event_type", "user_id")
    out = rows.cube("event_type", "day").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))
    return out.select("event_type", "day", F.col("level").cast("long").alias("level"), "n", "n_users")


def rolling_30d(spark, sf_dir):
    return _day(usage.rolling(usage.daily(facts(spark, sf_dir))).select("user_id", "day", "rolling_tokens"), "day")


def bar_heights(spark, sf_dir):
    by_day = facts(spark, sf_dir).groupBy("day").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total"))
    top = F.max("total").over(Window.partitionBy())  # a row for each day
    height = F.greatest(F.round(F.col("total") / F.nullif(top, F.lit(0)) * 116, 6), F.lit(3.0))
    return _day(by_day.withColumn("height", height), "day")


def sliding_sessions(spark, sf_dir):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return usage.sessions(events(spark, sf_dir)).select("user_id", stamp("started"), stamp("last_seen"), "n_events")


def overlapping_sessions(spark, sf_dir):
    """Sessions of half an hour's gap, each with the errors of all users that were less than ten minutes old within it."""
    mine = usage.sessions(events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes").select("user_id", F.unix_micros("started").alias("start"), F.unix_micros("last_seen").alias("stop"))
    errors = events(spark, sf_dir).filter("event_type = 'error'").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    asked = mine.withColumn("low", F.col("start") - 599_999_999)
    met = intervals.summed_within(asked, errors, ("user_id", "start"), "low", "stop", "at", "event_id")
    return met.select("user_id", F.date_format(F.timestamp_micros("start"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started"), F.col("n").alias("n_errors"), F.col("least").alias("first_error"))


def attempts(spark, sf_dir):
    at = F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp"))
    return events(spark, sf_dir).filter(F.col("event_type").isin("signup", "error")).select("user_id", "event_id", at.alias("at"), (F.col("event_type") == "signup").alias("success"))


def rate_limit(spark, sf_dir):
    """At most 2 accepted attempts in 24 hours, so that the small tables reach the limit."""
    return usage.rate_limited(attempts(spark, sf_dir), 2, 86_400_000_000)


def account_lock(spark, sf_dir):
    """Two failures lock for two days, so that the small tables reach the lock."""
    return usage.account_lock(attempts(spark, sf_dir), 2, 172_800_000_000).withColumn("failures", F.col("failures").cast("long"))


def rate_limit_default(spark, sf_dir):
    """At most 10 accepted attempts in five minutes."""
    return usage.rate_limited(attempts(spark, sf_dir))


def account_lock_default(spark, sf_dir):
    """Five failures lock for a quarter of an hour."""
    return usage.account_lock(attempts(spark, sf_dir)).withColumn("failures", F.col("failures").cast("long"))


def recent_attempts(spark, sf_dir):
    return usage.recent_attempts(attempts(spark, sf_dir), 86_400_000_000).select("event_id", "recent")


def cached_answers(spark, sf_dir):
    """Of the entries that events put for their users the latest of each that is whole and less than ten days old on the last day."""
    rows = attempts(spark, sf_dir).select("user_id", "event_id", (F.col("at") / 1_000_000).alias("ts"))
    whole = F.to_json(F.struct("ts", F.concat(F.lit("answer "), "event_id").alias("response"), F.array(F.col("event_id").cast("string")).alias("docs")))
    raw = F.when(F.col("event_id") % 5 == 0, F.left(whole, F.lit(9))).when(F.col("event_id") % 7 == 0, '{"response": "no time"}').otherwise(whole)
    found = knowledge.cached(rows.select(F.col("user_id").alias("key"), raw.alias("raw")), F.unix_micros(F.lit("2024-01-31T00:00:00Z").cast("timestamp")) / 1_000_000, 864_000)
    return found.select(F.col("key").alias("user_id"), "response", F.array_join("docs", ",").alias("docs"))


def date_buckets(spark, sf_dir):
    last = events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("ts"))
    return last.groupBy(dates.bucket(F.col("ts"), F.lit("2024-01-31").cast("date")).alias("bucket")).agg(F.count("*").alias("n"))


def resource_peaks(spark, sf_dir):
    return monitor.peaks(events(spark, sf_dir), "event_type", "value", 2.0)


def counter_deltas(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = events(spark, sf_dir).withColumn("counter", F.sum(F.round(F.col("value") * 100).cast("long")).over(order))
    return monitor.since_first(counted, "user_id", "counter", ["ts", "event_id"]).select("event_id", "counter", "delta")


def as_of_value(spark, sf_dir):
    every = events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value")
    clicks = every.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    views = every.filter("event_type = 'view'").select("user_id", "event_id", "ts", "value")
    return monitor.as_of(clicks, views, "user_id", "ts", "value", "event_id").select("event_id", "user_id", "as_of_value")


def messages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").filter(F.col("role").isin("user", "assistant"))


def last_n_history(spark, sf_dir):
    return ranking.last_n(messages(spark, sf_dir).select("conv_id", "turn", "role"), 6, "conv_id", "turn", "role")


def conversation_titles(spark, sf_dir):
    first = messages(spark, sf_dir).filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", strings.headline(F.col("text")).alias("title"))


def conversation_export(spark, sf_dir):
    return writers.transcript(messages(spark, sf_dir)).select("conv_id", F.md5(F.col("transcript").cast("binary")).alias("transcript_md5"), F.length("transcript").cast("long").alias("n_chars"))


def prompt_budget(spark, sf_dir):
    kept = ranking.budgeted(messages(spark, sf_dir).select("conv_id", "turn", "text"), 1000, "conv_id", "turn", "text")
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_parts"), F.sum(F.length("text")).alias("n_chars"))


_FACTS = "f AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(trunc(value) AS BIGINT) AS p, CAST(json_extract(props, '$.k') AS BIGINT) AS c FROM events)"
_DAILY = _FACTS + ", d AS (SELECT user_id, day, CAST(sum(p) AS BIGINT) AS p, CAST(sum(c) AS BIGINT) AS c, count(*) AS n FROM f GROUP BY ALL)"
_NAMED = "p AS prompt_tokens, c AS completion_tokens, n AS request_count"
_TOTALS = "t AS (SELECT user_id, CAST(coalesce(sum(p + c) FILTER (day >= DATE '2024-01-30' - {days}), 0) AS BIGINT) AS tokens, max(day) AS last_day FROM d GROUP BY user_id)"
_TRY = '''a AS (SELECT user_id, event_id, epoch_us(ts) AS "at", event_type = 'signup' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('signup', 'error'))'''

def _rate_sql(limit: int, window: int) -> str:
    return f"""WITH RECURSIVE {_TRY},
x AS (SELECT user_id, event_id, "at", r, ["at"] AS kept, true AS accepted FROM a WHERE r = 1
  UNION ALL SELECT user_id, event_id, "at", r, CASE WHEN len(live) < {limit} THEN list_append(live, "at") ELSE live END, len(live) < {limit}
  FROM (SELECT a.user_id, a.event_id, a."at", a.r, list_filter(x.kept, lambda t: a."at" - t < {window}) AS live FROM x JOIN a ON a.user_id = x.user_id AND a.r = x.r + 1))
SELECT user_id, event_id, "at", accepted FROM x"""


def _lock_sql(threshold: int, locked: int) -> str:
    return f"""WITH RECURSIVE {_TRY},
x AS (SELECT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS "at", CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS failures, CAST(NULL AS BIGINT) AS until, '' AS outcome FROM (SELECT DISTINCT user_id FROM a)
  UNION ALL SELECT a.user_id, a.event_id, a."at", a.r,
    CASE WHEN x.until > a."at" THEN x.failures WHEN a.ok THEN 0 ELSE x.failures + 1 END,
    CASE WHEN x.until > a."at" THEN x.until WHEN a.ok THEN NULL WHEN x.failures + 1 >= {threshold} THEN a."at" + {locked} ELSE x.until END,
    CASE WHEN x.until > a."at" THEN 'locked' WHEN a.ok THEN 'ok' ELSE 'failed' END
  FROM x JOIN a ON a.user_id = x.user_id AND a.r = x.r + 1)
SELECT user_id, event_id, "at", outcome, failures FROM x WHERE r > 0"""


ORACLE = {
    "usage_daily_rollup": f"WITH {_DAILY} SELECT user_id, CAST(day AS VARCHAR) AS day, {_NAMED} FROM d",
    "usage_upsert": f"WITH {_DAILY} SELECT user_id, CAST(day AS VARCHAR) AS day, {_NAMED} FROM d",
    "usage_30d_per_user": f"WITH {_DAILY}, {_TOTALS.format(days=29)} SELECT user_id, tokens, CAST(last_day AS VARCHAR) AS last_day FROM t",
    "users_with_usage": f"""WITH {_DAILY}, {_TOTALS.format(days=29)}
SELECT c_custkey AS user_id, c_name, coalesce(tokens, 0) AS tokens,
  CASE WHEN coalesce(tokens, 0) < 1000 THEN CAST(coalesce(tokens, 0) AS VARCHAR) ELSE (tokens + 50) // 1000 || ',' || (tokens + 50) // 100 % 10 || 'k' END AS shown,
  upper(c_name[1:2]) AS initials,
  CASE WHEN last_day IS NULL THEN 'never' WHEN DATE '2024-01-30' - last_day <= 0 THEN 'today' WHEN DATE '2024-01-30' - last_day = 1 THEN 'yesterday' ELSE CAST(DATE '2024-01-30' - last_day AS VARCHAR) || ' d ago' END AS last_active
FROM customer LEFT JOIN t ON user_id = c_custkey""",
    "usage_gap_filled": f"""WITH {_DAILY}, k AS (SELECT user_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM d))
SELECT user_id, CAST(day AS VARCHAR) AS day, coalesce(p, 0) AS prompt_tokens, coalesce(c, 0) AS completion_tokens, coalesce(n, 0) AS request_count FROM k LEFT JOIN d USING (user_id, day)""",
    "usage_cube": """SELECT event_type, day, CAST(grouping(event_type) * 2 + grouping(day) AS BIGINT) AS level, count(*) AS n, count(DISTINCT user_id) AS n_users
FROM (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id FROM events) GROUP BY CUBE (event_type, day)""",
    "rolling_30d": f"""WITH {_DAILY} SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(sum(p + c) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_tokens FROM d""",
    "bar_heights": f"""WITH {_FACTS}, b AS (SELECT day, CAST(sum(p + c) AS BIGINT) AS total FROM f GROUP BY day)
SELECT CAST(day AS VARCHAR) AS day, total, greatest(round(total / max(total) OVER () * 116, 6), 3.0) AS height FROM b""",
    "sliding_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, count(*) AS n_events FROM s GROUP BY user_id, s""",
    "rate_limit": _rate_sql(2, 86_400_000_000),
    "rate_limit_default": _rate_sql(10, 300_000_000),
    "account_lock": _lock_sql(2, 172_800_000_000),
    "account_lock_default": _lock_sql(5, 900_000_000),
    "overlapping_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g),
m AS (SELECT user_id, min(ts) AS a, max(ts) AS z FROM s GROUP BY user_id, s)
SELECT m.user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS started, count(*) AS n_errors, min(event_id) AS first_error FROM m JOIN events e ON e.event_type = 'error' AND m.a < e.ts + INTERVAL 10 MINUTE AND e.ts <= m.z GROUP BY m.user_id, a""",
    "recent_attempts": f'''WITH {_TRY} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY "at" RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent FROM a''',
    "cached_answers": f'''WITH {_TRY}, w AS (SELECT * FROM a WHERE event_id % 5 <> 0 AND event_id % 7 <> 0)
SELECT user_id, 'answer ' || event_id AS response, CAST(event_id AS VARCHAR) AS docs FROM w WHERE 1706659200000000 - "at" <= 864000000000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC, 'answer ' || event_id DESC) = 1''',
    "date_buckets": """SELECT CASE WHEN d >= DATE '2024-01-31' THEN 'today' WHEN d >= DATE '2024-01-30' THEN 'yesterday' WHEN d >= DATE '2024-01-24' THEN 'last 7 days' ELSE 'older' END AS bucket, count(*) AS n
FROM (SELECT user_id, CAST(max(ts) AS DATE) AS d FROM events GROUP BY user_id) GROUP BY ALL""",
    "resource_peaks": """SELECT event_type, round(max(value), 6) AS peak, round(avg(value), 6) AS mean, count(*) AS n, round(count(*) * 2.0::DOUBLE, 6) AS sampled_seconds,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS spanned_seconds, bool_or(value IS NOT NULL) AS has_values FROM events GROUP BY event_type""",
    "counter_deltas": """WITH c AS (SELECT event_id, user_id, ts, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS counter FROM events)
SELECT event_id, counter, counter - first_value(counter) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM c""",
    "as_of_value": """WITH v AS (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
SELECT c.event_id, c.user_id, v.value AS as_of_value FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts""",
    "last_n_history": """WITH k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS b FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) - b + 1 AS position FROM k WHERE b <= 6""",
    "conversation_titles": """SELECT conv_id, CASE WHEN length(t) <= 50 THEN t ELSE rtrim(t[1:50]) || '…' END AS title FROM (SELECT conv_id, trim(arg_min(text, turn)) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)""",
    "conversation_export": """SELECT conv_id, md5(t) AS transcript_md5, length(t) AS n_chars FROM (SELECT conv_id, string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS t FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)""",
    "prompt_budget": """WITH k AS (SELECT conv_id, length(text) AS l, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, count(*) AS n_parts, CAST(sum(least(l, 1000 - used)) AS BIGINT) AS n_chars FROM k WHERE used < 1000 GROUP BY conv_id""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
