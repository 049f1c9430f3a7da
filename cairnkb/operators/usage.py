"""Usage analytics: daily sums, upserts, windows of days, gap filling, sessions, limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

FACTS = ("prompt_tokens", "completion_tokens", "request_count")


def daily(facts: DataFrame) -> DataFrame:
    """``facts(user_id, day, *FACTS)`` summed by user and day."""
    return facts.groupBy("user_id", "day").agg(*[F.sum(c).alias(c) for c in FACTS])


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Daily sums with more facts added to them."""
    return daily(old.select("user_id", "day", *FACTS).unionByName(new.select("user_id", "day", *FACTS)))


def totals(usage: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """By user the tokens since ``days`` - 1 days before today, without upper bound, and the last day of all time."""
    recent = F.when(F.col("day") >= F.date_sub(today, days - 1), F.col("prompt_tokens") + F.col("completion_tokens"))
    return usage.groupBy("user_id").agg(F.coalesce(F.sum(recent), F.lit(0)).alias("tokens"), F.max("day").alias("last_day"))


def gap_filled(usage: DataFrame, users: DataFrame, today: Column, days: int) -> DataFrame:
    """A row for each user and each of the last ``days`` days, zeros where there is no usage."""
    calendar = users.select("user_id", F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    return calendar.join(usage, ["user_id", "day"], "left").select("user_id", "day", *[F.coalesce(c, F.lit(0)).alias(c) for c in FACTS])


def rolling(usage: DataFrame, days: int = 30) -> DataFrame:
    """With ``rolling_tokens``: the user's tokens of the day and the ``days`` - 1 before it."""
    number = F.unix_date("day")
    frame = Window.partitionBy("user_id").orderBy(number).rangeBetween(-(days - 1), 0)
    return usage.withColumn("rolling_tokens", F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).over(frame))


def sessions(events: DataFrame, gap: str = "8 hours") -> DataFrame:
    """``(user_id, started, last_seen, n_events)``: accesses that each come within ``gap`` of the one before, to the instant."""
    by = events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("n_events")).drop("w")


def revoke(sessions: DataFrame, user: Column, now: Column) -> DataFrame:
    """The user's open sessions revoked now; others as they are."""
    return sessions.withColumn("revoked_at", F.when((F.col("user_id") == user) & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at")))


def valid(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions neither revoked nor expired, to the instant, of active users."""
    live = sessions.filter(F.col("revoked_at").isNull() & (F.col("expires_at") >= now))
    return live.join(users.filter("is_active").select(F.col("id").alias("user_id")), "user_id", "left_semi")


def fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple]], out: str) -> DataFrame:
    """A state machine over each key's rows in order, fed row by row.

    Rows are dealt by key and sorted within their tasks, which may spill; a task holds one
    key's state and a batch of rows, never a key's rows. A key's rows depend on each other in
    order, so they do pass one task.
    """
    ship(rows.sparkSession)
    names = [x.split()[0] for x in out.split(", ")]
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False, name=None):
                at = row[columns.index(key)]
                if at != last:
                    last, state = at, start()
                state, result = step(state, row)
                made.append(result)
            yield pd.DataFrame(made, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, out)


def limiter(limit: int, window: int) -> tuple[Callable, Callable]:
    """Start and step of a machine over ``(user_id, event_id, at, success)`` whose state is the accepted times within ``window``."""

    def step(state, row):
        user, event, at, _ = row
        times = [t for t in state[0] if at - t < window]
        ok = len(times) < limit
        return (times + [at] if ok else times,), (user, event, at, ok)

    return lambda: ([],), step


def locker(threshold: int, locked: int) -> tuple[Callable, Callable]:
    """Start and step of a machine over ``(user_id, event_id, at, success)`` whose state is the failures and the end of the lock."""

    def step(state, row):
        failures, until = state
        user, event, at, success = row
        if until is not None and until > at:
            return state, (user, event, at, "locked", failures)
        if success:
            return (0, None), (user, event, at, "ok", 0)
        failures += 1
        return (failures, at + locked if failures >= threshold else until), (user, event, at, "failed", failures)

    return lambda: (0, None), step


def rate_limited(attempts: DataFrame, limit: int = 10, window: int = 300_000_000) -> DataFrame:
    """``attempts(user_id, event_id, at)`` (microseconds) with ``accepted``: fewer than ``limit`` accepted ones less than ``window`` before.

    Rejected attempts do not count against later ones.
    """
    ordered = attempts.select("user_id", "event_id", "at", F.lit(True).alias("success"))
    return fold(ordered, "user_id", ["at", "event_id"], *limiter(limit, window), "user_id long, event_id long, at long, accepted boolean")


def account_lock(attempts: DataFrame, threshold: int = 5, locked: int = 900_000_000) -> DataFrame:
    """``attempts(user_id, event_id, at, success)`` with ``outcome`` and ``failures`` after it.

    ``locked`` while a lock lasts (nothing counts then), else ``ok``, which clears the
    failures, or ``failed``; from ``threshold`` failures on each failure locks anew.
    """
    ordered = attempts.select("user_id", "event_id", "at", "success")
    return fold(ordered, "user_id", ["at", "event_id"], *locker(threshold, locked), "user_id long, event_id long, at long, outcome string, failures int")


def recent_attempts(attempts: DataFrame, window: int = 300_000_000) -> DataFrame:
    """A cheap stand-in for the limiter, with ``recent``: attempts of the last ``window``, this one included, accepted or not."""
    frame = Window.partitionBy("user_id").orderBy("at").rangeBetween(-window + 1, 0)
    return attempts.withColumn("recent", F.count("*").over(frame))
