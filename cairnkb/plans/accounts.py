"""Account queries over ``customer`` and ``conversations``, and the window and grouping functions of SQL over ``events``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import accounts, quantiles, sequences
from ..session import shared
from ..sources import readers
from ..sources.tables import KeyedTable
from .rulings import NOTICE
from .usage import events

LABELS = [(0, "zero"), (1, "one"), (2, "two")]


def _users(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("user_id"), "c_name", F.when(F.col("c_custkey") % 40 == 0, "admin").otherwise("member").alias("role"), (F.col("c_acctbal") > 0).alias("is_active"))


def active_admins(spark, sf_dir):
    return accounts.active(_users(spark, sf_dir), "admin")


def last_admin_guard(spark, sf_dir):
    """Every user demoted, with one admin left active, and with all."""
    users = _users(spark, sf_dir)
    one = users.withColumn("is_active", F.col("is_active") & ((F.col("role") != "admin") | (F.col("user_id") == 40)) | (F.col("user_id") == 40))
    changes = users.select("user_id", F.lit("member").alias("new_role"), F.lit(True).alias("new_active"))
    both = [accounts.guarded(changes, u).withColumn("case", F.lit(case)) for case, u in (("all", users), ("one", one))]
    return both[0].unionByName(both[1]).groupBy("case", "allowed").agg(F.count("*").alias("n"))


def owned_conversations(spark, sf_dir):
    """The conversations that a user may see: their own, newest first."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    convs = turns.groupBy("conv_id").agg(F.max("turn").cast("long").alias("last_turn"), F.count("*").alias("n_turns")).withColumn("user_id", F.length(F.col("conv_id").cast("string")))
    order = Window.partitionBy("user_id").orderBy(F.desc("last_turn"), "conv_id")
    return convs.withColumn("position", F.row_number().over(order).cast("long")).select(F.col("user_id").cast("long").alias("user_id"), "conv_id", "last_turn", "n_turns", "position")


def conversation_access(spark, sf_dir):
    """Who may see which conversation: each is asked for by its owner, by another user and, past the last, for none that exists.

    The customer whose number is the conversation's within their count owns it.
    """
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.count("*").alias("n"))
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").filter("conv_id is not null").distinct().crossJoin(F.broadcast(users))
    own = convs.select("conv_id", (F.pmod("conv_id", "n") + 1).alias("user_id"), "n")
    asked = own.select("user_id", "conv_id").unionByName(own.select((F.pmod("user_id", "n") + 1).alias("user_id"), "conv_id")).unionByName(own.select("user_id", (-F.col("conv_id") - 1).alias("conv_id")))
    return accounts.owned(asked, own)


def addresses(spark, sf_dir):
    raw = F.concat(F.lit(" \t"), F.col("c_name"), F.lit("@Example.ORG \n"))
    return _users(spark, sf_dir).select("user_id", accounts.address(raw).alias("address"), accounts.restriction(F.col("user_id") % 2 == 0, NOTICE).alias("restriction"))


def health_counts(spark, sf_dir):
    """The documents as checks: one without text fails, a short one warns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    status = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, "fail").when(F.length("text") < 100, "warn").otherwise("ok")
    return accounts.health(docs.select(F.col("doc_id").alias("name"), status.alias("status")))


def forbidden_tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy("lang").agg(F.count_if(F.contains("text", F.lit("password"))).alias("n_password"), F.count_if(F.contains("text", F.lit("AKIA"))).alias("n_key"), F.count("*").alias("n"))


def labelled_results(spark, sf_dir):
    """Answers by case with the case's label, '' where it has none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 5).cast("long").alias("case_id"), "text")
    labels = readers.inline(spark, LABELS, "case_id LONG, label STRING")
    counted = docs.groupBy("case_id").agg(F.count("*").alias("n"), F.count("text").alias("n_answered"))
    return counted.join(F.broadcast(labels), "case_id", "left").select("case_id", F.coalesce("label", F.lit("")).alias("label"), "n", "n_answered")


def token_usage(spark, sf_dir):
    """Counts out of a JSON column, 0 where one is missing."""
    rows = events(spark, sf_dir)
    of = lambda path: F.coalesce(F.get_json_object("props", path).cast("long"), F.lit(0).cast("long"))
    return rows.select("event_id", of("$.k").alias("completion_tokens"), of("$.missing").alias("prompt_tokens"))


def event_windows(spark, sf_dir):
    """Ranks, quartiles and gaps of each user's events; -1 where there is none before or after."""
    mine = Window.partitionBy("user_id").orderBy("ts", "event_id")
    by_value = Window.partitionBy("user_id").orderBy(F.desc("value"))
    rows = events(spark, sf_dir).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("value"))
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(mine))
    return rows.select(
        "event_id", F.rank().over(by_value).cast("long").alias("rank"), F.dense_rank().over(by_value).cast("long").alias("dense_rank"), F.ntile(4).over(mine).cast("long").alias("quartile"),
        F.coalesce(gap, F.lit(-1)).alias("gap_micros"), F.coalesce(F.lead("event_id").over(mine), F.lit(-1)).alias("next_event"), F.first("event_id").over(mine).alias("first_event"),
    )


def event_rollup(spark, sf_dir):
    """Subtotals by type and day, with exact percentiles, where there are more than two events."""
    rows = events(spark, sf_dir).select(F.col("ts").cast("date").cast("string").alias("day"), "event_type", F.col("value").cast("double").alias("value"))
    level = lambda n, kind, day: F.struct(F.lit(n).cast("long").alias("level"), kind.alias("event_type"), day.alias("day"))
    none = F.lit(None).cast("string")
    levels = F.explode(F.array(level(0, F.col("event_type"), F.col("day")), level(1, F.col("event_type"), none), level(3, none, none)))
    every = rows.select("value", levels.alias("of")).select("value", "of.*")
    keys = ["event_type", "day", "level"]
    n = every.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 2")
    found = quantiles.exact(every, keys, "value", [0.5, 0.9]).withColumnRenamed("n", "n_values").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = n["event_type"].eqNullSafe(found["_event_type"]) & n["day"].eqNullSafe(found["_day"]) & (n["level"] == found["_level"])
    return n.join(found, same, "left").select(*keys, "n", F.round("q0", 6).alias("median"), F.round("q1", 6).alias("p90"))


def approximate_users(spark, sf_dir):
    """Whether the approximate number of users is within a tenth of the exact one, by type."""
    # each user of a type once: a sketch for each user and type, as a distinct count beside it would make, is some kB
    once = events(spark, sf_dir).select("event_type", "user_id").distinct()
    rows = once.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.count("user_id").alias("n_users"))
    return rows.select("event_type", "n_users", (F.abs(F.col("about") - F.col("n_users")) <= F.col("n_users") / 10).alias("close"))


def merged_users(spark, sf_dir):
    """Users by type over all days and over the last ten, out of bitmaps that were kept by day."""
    path = shared(spark, "users-by-day")
    rows = events(spark, sf_dir).select("event_type", F.col("ts").cast("date").alias("day"), "user_id")
    quantiles.bitmaps(rows, ["event_type", "day"], "user_id").write.parquet(path)
    kept = spark.read.parquet(path)
    late = quantiles.merged(kept.filter("day >= date'2024-01-21'"), ["event_type"]).withColumnRenamed("n", "n_late")
    return quantiles.merged(kept, ["event_type"]).join(late, "event_type", "left").select("event_type", F.col("n").alias("n_users"), F.coalesce("n_late", F.lit(0)).alias("n_late"))


def numbered_conversations(spark, sf_dir):
    """The conversations numbered in two runs, first the even ones: by run the first and the last number, and how many there are."""
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").filter("conv_id is not null").distinct()
    marks = KeyedTable(spark, shared(spark, "marks"), ["name"], 4)
    runs = [sequences.next_numbers(convs.filter(F.col("conv_id") % 2 == i), marks, "conversations").withColumn("run", F.lit(i)) for i in (0, 1)]
    return runs[0].unionByName(runs[1]).groupBy("run").agg(F.count("*").alias("n"), F.count_distinct("number").alias("n_numbers"), F.min("number").alias("first"), F.max("number").alias("last"))


_USERS = "u AS (SELECT c_custkey AS user_id, c_name, CASE WHEN c_custkey % 40 = 0 THEN 'admin' ELSE 'member' END AS role, c_acctbal > 0 AS is_active FROM customer)"

ORACLE = {
    "active_admins": f"WITH {_USERS} SELECT count(*) AS n FROM u WHERE is_active AND role = 'admin'",
    "last_admin_guard": f"""WITH {_USERS}, n AS (SELECT count(*) AS n FROM u WHERE is_active AND role = 'admin'),
a AS (SELECT 'all' AS "case", NOT (role = 'admin' AND is_active) OR n > 1 AS allowed FROM u, n UNION ALL SELECT 'one', user_id <> 40 FROM u)
SELECT "case", allowed, count(*) AS n FROM a GROUP BY ALL""",
    "owned_conversations": """WITH c AS (SELECT CAST(length(CAST(conv_id AS VARCHAR)) AS BIGINT) AS user_id, conv_id, CAST(max(turn) AS BIGINT) AS last_turn, count(*) AS n_turns FROM conversations GROUP BY conv_id)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_turn DESC, conv_id) AS position FROM c""",
    "conversation_access": """WITH n AS (SELECT count(*) AS n FROM customer), o AS (SELECT DISTINCT conv_id, conv_id % n + 1 AS user_id, n FROM conversations, n WHERE conv_id IS NOT NULL)
SELECT user_id, conv_id, true AS found FROM o UNION ALL SELECT user_id % n + 1, conv_id, n = 1 FROM o UNION ALL SELECT user_id, -conv_id - 1, false FROM o""",
    "addresses": f"WITH {_USERS} SELECT user_id, lower(c_name) || '@example.org' AS address, CASE WHEN user_id % 2 = 0 THEN '{NOTICE}' ELSE '' END AS restriction FROM u",
    "health_counts": """WITH s AS (SELECT CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'fail' WHEN length(text) < 100 THEN 'warn' ELSE 'ok' END AS s FROM documents),
c AS (SELECT count(*) FILTER (s = 'ok') AS n_ok, count(*) FILTER (s = 'warn') AS n_warn, count(*) FILTER (s = 'fail') AS n_fail FROM s)
SELECT *, CASE WHEN n_fail > 0 THEN 'fail' WHEN n_warn > 0 THEN 'warn' ELSE 'ok' END AS overall FROM c""",
    "forbidden_tokens": "SELECT lang, count(*) FILTER (contains(text, 'password')) AS n_password, count(*) FILTER (contains(text, 'AKIA')) AS n_key, count(*) AS n FROM documents GROUP BY lang",
    "labelled_results": f"""WITH l(case_id, label) AS (VALUES {", ".join(map(repr, LABELS))}), c AS (SELECT CAST(doc_id % 5 AS BIGINT) AS case_id, count(*) AS n, count(text) AS n_answered FROM documents GROUP BY 1)
SELECT case_id, coalesce(label, '') AS label, n, n_answered FROM c LEFT JOIN l USING (case_id)""",
    "token_usage": "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS completion_tokens, CAST(0 AS BIGINT) AS prompt_tokens FROM events",
    "event_windows": """WITH e AS (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS value FROM events)
SELECT event_id, rank() OVER v AS rank, dense_rank() OVER v AS dense_rank, ntile(4) OVER m AS quartile, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER m), -1) AS gap_micros, coalesce(lead(event_id) OVER m, -1) AS next_event, first_value(event_id) OVER m AS first_event
FROM e WINDOW m AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY value DESC)""",
    "event_rollup": """SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(grouping(event_type, CAST(CAST(ts AS DATE) AS VARCHAR)) AS BIGINT) AS level, count(*) AS n, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST(value AS DOUBLE), 0.9), 6) AS p90
FROM events GROUP BY ROLLUP (event_type, CAST(CAST(ts AS DATE) AS VARCHAR)) HAVING count(*) > 2""",
    "merged_users": """SELECT event_type, count(DISTINCT user_id) AS n_users, count(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN user_id END) AS n_late FROM events GROUP BY event_type""",
    "numbered_conversations": """WITH c AS (SELECT conv_id % 2 AS run, count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1), t AS (SELECT *, coalesce(sum(n) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c)
SELECT CAST(run AS INT) AS run, n, n AS n_numbers, CAST(b + 1 AS BIGINT) AS first, CAST(b + n AS BIGINT) AS last FROM t""",
    "approximate_users": "SELECT event_type, count(DISTINCT user_id) AS n_users, true AS close FROM events GROUP BY event_type",
}
QUERIES = {name: globals()[name] for name in ORACLE}
