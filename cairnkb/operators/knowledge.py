"""Keeping a chunk table: additive ingest, replacement by prefix, manifest, names, retention, cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def additive(new: DataFrame, old: DataFrame, key: str = "content_hash") -> DataFrame:
    """The new rows whose key is not there yet. Keyed by content, so edited sections are new."""
    return new.join(old.select(key).distinct(), key, "left_anti").select(*new.columns)


def merged(old: DataFrame, new: DataFrame, prefix: str, key: str = "chunk_id") -> DataFrame:
    """Old rows of other prefixes, and all new ones."""
    return old.filter(~F.col(key).startswith(prefix)).unionByName(new, allowMissingColumns=True)


def manifest(chunks: DataFrame) -> DataFrame:
    """One row of counts; shares in whole percent of at least one chunk."""
    n = F.greatest(F.count("*"), F.lit(1))
    share = lambda c: F.floor(100 * F.count_if(c) / n).cast("long")
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.count_distinct("path").alias("n_files"), F.count_if(F.col("function_name") != "").alias("n_named"),
        share(F.col("has_code")).alias("code_percent"), share(F.col("function_name") != "").alias("named_percent"),
    )


def known_names(chunks: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The distinct function names, with those known before."""
    names = chunks.filter("function_name <> ''").select(F.col("function_name").alias("name"))
    return (names if before is None else names.union(before.select("name"))).distinct()


def coverage(inventory: DataFrame, chunks: DataFrame) -> DataFrame:
    """``inventory(code, entry)``, entry a struct with functions, as rows with whether a chunk covers the name."""
    rows = inventory.select("code", F.explode("entry.functions").alias("name"))
    return rows.join(known_names(chunks).withColumn("covered", F.lit(True)), "name", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def retained(rows: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """Rows not older than the cutoff."""
    return rows.filter(F.col(at) >= cutoff)


def fresh(entries: DataFrame, at: str, now: Column, seconds: int = 86_400) -> DataFrame:
    """Cache entries of at most that age whose payload can be read."""
    return entries.filter((now - F.col(at) <= seconds) & F.col("payload").isNotNull())


def cache_key(question: Column, model: Column, top_k: Column, skills: Column, mode: Column, history: Column, version: str = "v1") -> Column:
    """16 hex digits of a hash over all that an answer depends on; the order of skills does not matter."""
    said = F.substring(F.sha2(F.coalesce(history, F.lit("")), 256), 1, 12)
    whole = F.concat_ws("|", F.lit(version), F.trim(question), model, top_k.cast("string"), F.array_join(F.array_sort(skills), ","), mode, said)
    return F.substring(F.sha2(whole, 256), 1, 16)


def violations(rows: DataFrame, allowed: dict[str, list[str]], unique: list[str]) -> DataFrame:
    """``(check, n)``: rows outside the allowed values, and keys that occur more than once."""
    out = None
    for column, values in allowed.items():
        bad = rows.filter(~F.col(column).isin(*values)).agg(F.lit(f"{column} not allowed").alias("check"), F.count("*").alias("n"))
        out = bad if out is None else out.unionByName(bad)
    for column in unique:
        bad = rows.groupBy(column).count().filter("count > 1").agg(F.lit(f"{column} not unique").alias("check"), F.count("*").alias("n"))
        out = bad if out is None else out.unionByName(bad)
    return out


def is_urgent(priority: Column, urgent: tuple[str, ...] = ("critical", "high")) -> Column:
    """Whether a priority is one of the urgent ones; an unknown or null one is not."""
    return F.coalesce(priority.isin(*urgent), F.lit(False))


def cached(entries: DataFrame, now: Column, keep_seconds: int = 86_400) -> DataFrame:
    """Of raw cache entries ``(key, raw)`` the latest of each key that is whole and not too old: ``(key, ts, response, docs)``.

    ``raw`` is a JSON object ``{ts, response, docs}``, ``ts`` in seconds. An entry that is no
    such object, or lacks the time or the response, is passed over, and an older whole one is
    not put in its place if that is too old. Equal times go to the greater response.
    """
    parsed = F.from_json("raw", "ts DOUBLE, response STRING, docs ARRAY<STRING>")
    rows = entries.select("key", parsed.alias("e")).filter("e.ts is not null and e.response is not null")
    last = rows.groupBy("key").agg(F.max_by("e", F.struct("e.ts", "e.response")).alias("e"))
    return last.filter(now - F.col("e.ts") <= keep_seconds).select("key", "e.ts", "e.response", "e.docs")


def preview(rows: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """The first n rows in the given order: what a dry run shows of an ingest."""
    return rows.orderBy(*order).limit(n)
