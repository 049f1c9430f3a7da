"""Question expansion by trigger phrases, and names known to the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each question is compared with each trigger.
MOST_TRIGGERS = 10_000


def triggered(question: Column, trigger: Column, least: int = 6, share: float = 0.8) -> Column:
    """Whether a lower-case question holds the trigger, or the first 80 % (6 characters at least) of a one-word trigger."""
    stem = F.left(trigger, F.greatest(F.lit(least), F.floor(F.length(trigger) * share).cast("int")))
    fuzzy = ~F.contains(trigger, F.lit(" ")) & (F.length(trigger) >= least) & F.contains(question, stem)
    return F.contains(question, trigger) | fuzzy


def expand(questions: DataFrame, triggers: DataFrame) -> DataFrame:
    """``questions(query_id, text)`` with ``expanded``: the text, then the expansions of all triggered intents in table order.

    ``triggers`` has ``(intent_id, trigger, expansion)``: a lookup table, which is broadcast for
    the substring join; more than MOST_TRIGGERS rows are refused. An intent counts once however
    many triggers match.
    """
    if triggers.limit(MOST_TRIGGERS + 1).count() > MOST_TRIGGERS:
        raise ValueError(f"a table of triggers has at most {MOST_TRIGGERS} rows")
    low = questions.select("query_id", F.lower("text").alias("_q"))
    hits = low.join(F.broadcast(triggers), triggered(F.col("_q"), F.col("trigger"))).select("query_id", "intent_id", "expansion").distinct()
    added = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("intent_id", "expansion"))), lambda x: x["expansion"]), " ").alias("_added"))
    return questions.join(added, "query_id", "left").withColumn("expanded", F.concat_ws(" ", "text", "_added")).drop("_added")


def known_name(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``(query_id, name)``: the longest known name among the question's words, ties by name."""
    words = questions.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), 0))).alias("name"))
    found = words.join(names.select("name").distinct(), "name")
    longest = Window.partitionBy("query_id").orderBy(F.desc(F.length("name")), "name")
    return found.withColumn("_r", F.row_number().over(longest)).filter("_r = 1").select("query_id", "name")


def bare_name(name: Column, prefixes: list[str]) -> Column:
    """``OrderTotal`` without its table prefix: ``Total``. A prefix must be followed by a capital."""
    return F.regexp_replace(name, "^(?:" + "|".join(prefixes) + ")(?=[A-Z])", "")
