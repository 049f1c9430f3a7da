"""Scores of answers against cases, summaries, and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cases that are broadcast (some 1 kB each); more are joined by a shuffle.
BROADCAST_CASES = 100_000


def errors(answer: Column, must: Column, must_not: Column) -> Column:
    """What fails: required terms that are missing in any case, forbidden terms that are there as written."""
    missing = F.filter(must, lambda t: ~F.contains(F.lower(answer), F.lower(t)))
    found = F.filter(must_not, lambda t: F.contains(answer, t))
    return F.concat(F.transform(missing, lambda t: F.concat(F.lit("missing: "), t)), F.transform(found, lambda t: F.concat(F.lit("forbidden: "), t)))


def score(n_errors: Column, n_warnings: Column) -> Column:
    return F.greatest(F.lit(0), 10 - 3 * n_errors - n_warnings)


def evaluate(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """``answers(case_id, ..., answer)`` against ``cases(case_id, must, must_not)``: status, score and errors; a null answer is an ERROR of 0."""
    few = F.broadcast if cases.limit(BROADCAST_CASES + 1).count() <= BROADCAST_CASES else lambda x: x
    joined = answers.join(few(cases), "case_id")
    found = errors(F.col("answer"), F.col("must"), F.col("must_not"))
    return joined.withColumns({
        "errors": F.when(F.col("answer").isNull(), F.array(F.lit("no answer"))).otherwise(found),
        "status": F.when(F.col("answer").isNull(), "ERROR").when(F.size(found) == 0, "PASS").otherwise("FAIL"),
        "score": F.when(F.col("answer").isNull(), 0).otherwise(score(F.size(found), F.lit(0))),
    })


def summary(results: DataFrame, *by: str, digits: int = 6) -> DataFrame:
    """Cases, passes and mean score over all cases, errors included."""
    return results.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "PASS").alias("n_pass"), F.round(F.avg(F.col("score").cast("double")), digits).alias("mean_score"))


def weighted(summaries: DataFrame, digits: int = 6) -> DataFrame:
    """The mean over all batteries, each by its number of cases."""
    return summaries.agg(F.round(F.sum(F.col("mean_score") * F.col("n")) / F.sum("n"), digits).alias("mean_score"), F.sum("n").alias("n"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.nullif(union, F.lit(0)))


def calls(text: Column, keywords: list[str], tag: str, call: str) -> Column:
    """Names called in the tagged blocks, distinct, without keywords; the first group of ``call`` is a name."""
    code = F.array_join(F.regexp_extract_all(text, F.lit(rf"(?s)```{tag}(.*?)```"), 1), "\n")
    return F.array_except(F.regexp_extract_all(code, F.lit(call), 1), F.array(*map(F.lit, keywords)))


def verdict(same: Column, similarity: Column, least: float = 0.7) -> Column:
    return F.when(same, "IDENTICAL").when(similarity >= least, "EQUIVALENT").otherwise("DIFFERENT")
