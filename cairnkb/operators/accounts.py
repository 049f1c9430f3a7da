"""Accounts: guards on roles, ownership, normalised addresses, modes; counts of checks and of tokens in answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def address(raw: Column) -> Column:
    """A mail address as it is compared."""
    return F.lower(F.btrim(raw, F.lit(" \n\t\r")))


def active(users: DataFrame, role: str) -> DataFrame:
    """One row ``(n)``: the active users of a role."""
    return users.filter(F.col("is_active") & (F.col("role") == role)).agg(F.count("*").alias("n"))


def guarded(changes: DataFrame, users: DataFrame, role: str = "admin") -> DataFrame:
    """``changes(user_id, new_role, new_active)`` with ``allowed``: none may leave no active user of the role.

    Each change is judged by itself against ``users(user_id, role, is_active)``; one of an unknown user is not allowed.
    """
    joined = changes.join(users.select("user_id", "role", "is_active"), "user_id", "left").crossJoin(F.broadcast(active(users, role)))
    was = F.col("is_active") & (F.col("role") == role)
    stays = F.col("new_active") & (F.col("new_role") == role)
    allowed = F.col("role").isNotNull() & (~was | stays | (F.col("n") > 1))
    return joined.withColumn("allowed", F.coalesce(allowed, F.lit(False))).drop("role", "is_active", "n")


def restriction(restricted: Column, said: str) -> Column:
    """What an account's mode adds to its instructions; '' in the full mode."""
    return F.when(F.coalesce(restricted, F.lit(False)), said).otherwise("")


def health(checks: DataFrame) -> DataFrame:
    """``checks(name, status)`` as one row: how many passed, warned and failed, and the overall status."""
    n = lambda status: F.count_if(F.col("status") == status).alias(f"n_{status}")
    counted = checks.agg(n("ok"), n("warn"), n("fail"))
    return counted.withColumn("overall", F.when(F.col("n_fail") > 0, "fail").when(F.col("n_warn") > 0, "warn").otherwise("ok"))


def owned(asked: DataFrame, conversations: DataFrame) -> DataFrame:
    """``asked(user_id, conv_id)`` with ``found``: whether there is such a conversation and it is that user's.

    One that is another's and one that does not exist look the same. Nulls own nothing.
    """
    own = conversations.select("user_id", "conv_id").distinct().withColumn("_owned", F.lit(True))
    return asked.join(own, ["user_id", "conv_id"], "left").withColumn("found", F.coalesce("_owned", F.lit(False))).drop("_owned")
