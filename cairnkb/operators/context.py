"""What surrounds retrieval: synonyms for the index, exact rows by name, context blocks and sources for the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expand import bare_name

#: Names of a lookup table that are broadcast (some 200 bytes each); more are joined by a shuffle.
BROADCAST_NAMES = 1_000_000


def with_synonyms(chunks: DataFrame, synonyms: DataFrame, name: str, bare: str, text: str) -> DataFrame:
    """``chunks`` with the synonyms of their name after the text; those of the bare name where the full one has none.

    ``synonyms`` has ``(name, words)``; names of several rows have all their words, in order.
    A table of up to BROADCAST_NAMES rows is broadcast.
    """
    few = F.broadcast if synonyms.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else lambda x: x
    lookup = synonyms.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("words")), " ").alias("words"))
    full = lookup.select(F.col("name").alias("_full"), F.col("words").alias("_own"))
    short = lookup.select(F.col("name").alias("_short"), F.col("words").alias("_other"))
    joined = chunks.join(few(full), F.col(name) == F.col("_full"), "left").join(few(short), F.col(bare) == F.col("_short"), "left")
    return joined.withColumn(text, F.concat_ws(" ", text, F.coalesce("_own", "_other"))).drop("_full", "_own", "_short", "_other")


def bare_keys(synonyms: DataFrame, prefixes: list[str]) -> DataFrame:
    """``synonyms(name, words)`` with the words of each prefixed name under its bare name, too, each pair once."""
    bare = synonyms.withColumn("name", bare_name(F.col("name"), prefixes))
    return synonyms.select("name", "words").unionByName(bare.select("name", "words")).distinct()


def exact_rows(named: DataFrame, rows: DataFrame, most: int = 3) -> DataFrame:
    """``(query_id, id, score, position)``: the first ``most`` rows, by id, of the name that a question has; score 1.

    ``named`` has ``(query_id, name)``, ``rows`` ``(id, name)``. A question without a known name has none.
    """
    first = Window.partitionBy("query_id").orderBy("id")
    found = named.join(rows, "name").withColumn("position", F.row_number().over(first).cast("long")).filter(F.col("position") <= most)
    return found.select("query_id", "id", F.lit(1.0).alias("score"), "position")


def other_names(words: DataFrame, names: DataFrame, most: int = 2, bonus: int = 20) -> DataFrame:
    """``(query_id, name, position)``: the known names among ``words(query_id, name, original)``, longest first.

    A name that stands in the original question counts as ``bonus`` characters longer than one of its expansion alone.
    """
    found = words.join(names.select("name").distinct(), "name").groupBy("query_id", "name").agg(F.max("original").alias("original"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.length("name") + F.when(F.col("original"), bonus).otherwise(0)), "name")
    return found.withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= most).select("query_id", "name", "position")


def named_exact(known: DataFrame, others: DataFrame, rows: DataFrame, most: int = 3) -> DataFrame:
    """``exact_rows`` of the name that a question has, and after them those of its other names; each row once.

    ``others`` has ``(query_id, name, position)``, of which the known name is left out.
    """
    first = known.select("query_id", "name", F.lit(0).cast("long").alias("turn"))
    more = others.select("query_id", "name", F.col("position").alias("turn")).join(known.select("query_id", "name"), ["query_id", "name"], "left_anti")
    by_name = Window.partitionBy("query_id", "name").orderBy("id")
    met = first.unionByName(more).join(rows.select("id", "name"), "name").withColumn("place", F.row_number().over(by_name)).filter(F.col("place") <= most)
    once = met.groupBy("query_id", "id").agg(F.min(F.struct("turn", "place")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "id")
    return once.select("query_id", "id", F.lit(1.0).alias("score"), F.row_number().over(order).cast("long").alias("position"))


def block(position: Column, title: Column, signature: Column, text: Column, score: Column) -> Column:
    """A source as the answering model sees it; the score is rounded by its exact value, as C's ``%.3f`` does (Java's goes by the shortest decimal)."""
    score = score.cast("double")
    # format_number takes the one half below a thousandth, 0.0005, for even
    shown = F.when(F.abs(score) < 0.001, F.format_string("%.3f", score)).otherwise(F.call_function("format_number", score, F.lit("0.000")))
    head = F.format_string("[%d] %s (%s)", position.cast("long"), title, shown)
    return F.concat_ws("\n", head, F.nullif(F.trim(signature), F.lit("")), text)


def source_label(title: Column, separator: str = " — ") -> Column:
    """The first two parts of a composite title."""
    return F.array_join(F.slice(F.split(title, rf"\Q{separator}\E", -1), 1, 2), separator)


def profile(words: Column, profiles: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first profile one of whose keywords is among the words."""
    found = F.lit(otherwise)
    for name, keys in reversed(profiles):
        found = F.when(F.arrays_overlap(words, F.array(*map(F.lit, keys))), name).otherwise(found)
    return F.coalesce(found, F.lit(otherwise))
