"""Ranking: dense search, rank fusion, boosts, exact rows first, edge loading, budgets, last N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 25
#: Query vectors broadcast at once (some 6 kB each with 768 components).
QUERY_BLOCK = 10_000
#: Boost factors: an exactly named row, a row of a preferred category, a row with a signature.
BOOSTS = (1.12, 1.08, 1.04)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6, block: int = QUERY_BLOCK, within: tuple[str, ...] = ()) -> DataFrame:
    """``(query_id, rank, id, score)``: the k vectors of the largest cosine, exactly; ties by id.

    ``vectors`` has ``(id, embedding)``, ``queries`` ``(query_id, embedding)``: a stated set
    of queries, broadcast in blocks of ``block`` against all rows. ``within`` names columns of
    both sides that must be equal, so that the filter precedes the ranking. Each task keeps k
    rows a query before the shuffle. A zero or null vector has no cosine and never ranks.
    """
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    rows = vectors.select("id", F.col("embedding").alias("v"), norm.alias("nv"), *within)
    asked = queries.select("query_id", F.col("embedding").alias("q"), norm.alias("nq"), *[F.col(c).alias(f"_{c}") for c in within])
    same = F.lit(True)
    for c in within:
        same = same & (F.col(c) == F.col(f"_{c}"))
    score = F.round(dot(F.col("v"), F.col("q")) / F.nullif(F.col("nv") * F.col("nq"), F.lit(0.0)), digits)
    parts = max(1, -(-queries.count() // block))
    scored = None
    for part in range(parts):
        mine = F.broadcast(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part) if parts > 1 else asked)
        found = rows.join(mine, same) if within else rows.crossJoin(mine)
        found = found.select("query_id", "id", score.alias("score")).filter("score is not null")
        scored = found if scored is None else scored.unionByName(found)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(ranked).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def rrf(lists: DataFrame, k: int = RRF_K, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of ``lists(query_id, source, rank, id)``, rank from 1: ``(query_id, id, score, source, rank)``.

    source and rank are those of an id's first list, by source and rank; they break ties.
    """
    first = F.min(F.struct("source", "rank"))
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), digits).alias("score"), first.alias("first"))
    return fused.select("query_id", "id", "score", F.col("first.source").alias("source"), F.col("first.rank").cast("long").alias("rank"))


def cut(ranked: DataFrame, k: int, *order: Column, name: str = "position") -> DataFrame:
    """The first k rows of each query in the given order, numbered from 1."""
    by = Window.partitionBy("query_id").orderBy(*order)
    return ranked.withColumn(name, F.row_number().over(by).cast("long")).filter(F.col(name) <= k)


def boost(fused: DataFrame, k: int, factors: tuple[float, float, float] = BOOSTS, digits: int = 9) -> DataFrame:
    """``fused(query_id, id, score, source, rank, named, preferred, signed)`` cut to 2k, boosted and sorted anew.

    The cut comes first: what the fusion ranks below 2k cannot be boosted back in.
    """
    top = cut(fused, 2 * k, F.desc("score"), F.col("source"), F.col("rank"), F.col("id"), name="fused_position")
    factor = F.lit(1.0)
    for flag, by in zip(("named", "preferred", "signed"), factors, strict=True):
        factor = factor * F.when(F.col(flag), by).otherwise(1.0)
    boosted = top.withColumn("score", F.round(F.col("score") * factor, digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fused_position")
    return boosted.withColumn("position", F.row_number().over(order).cast("long"))


def exact_then_fused(exact: DataFrame, boosted: DataFrame, k: int) -> DataFrame:
    """Exact rows first, then the fused ones that are not among them, k in all; both ``(query_id, id, score, position)``."""
    rest = boosted.join(exact.select("query_id", "id"), ["query_id", "id"], "left_anti")
    columns = ("query_id", "id", "score", "position")
    both = exact.select(*columns, F.lit(0).alias("stage")).unionByName(rest.select(*columns, F.lit(1).alias("stage")))
    ordered = Window.partitionBy("query_id").orderBy("stage", "position", "id")
    return both.withColumn("position", F.row_number().over(ordered).cast("long")).filter(F.col("position") <= k).drop("stage")


def edge_load(ranked: DataFrame) -> DataFrame:
    """Positions for a reader who attends to both ends: the best first, the second best last.

    Rows are ranked by score, ties by their position. One or two rows stay where they are.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    r, n = F.row_number().over(best), F.count("*").over(Window.partitionBy("query_id"))
    place = F.when(n <= 2, F.col("position")).when(r == 1, 1).when(r == 2, n).otherwise(r - 1)
    return ranked.withColumn("place", place.cast("long"))


def adaptive_k(question: Column, markers: list[str], base: int = 6) -> Column:
    """10 at least for five markers in the question, 8 for three; each marker counts once, nested ones too."""
    n = sum((F.contains(F.lower(question), F.lit(m)).cast("int") for m in markers), F.lit(0))
    return F.when(n >= 5, F.greatest(F.lit(base), F.lit(10))).when(n >= 3, F.greatest(F.lit(base), F.lit(8))).otherwise(base)


def budgeted(rows: DataFrame, budget: int, key: str, order: str, text: str) -> DataFrame:
    """Each key's texts in order until ``budget`` characters are used; the one that runs over is cut."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(so_far), F.lit(0))
    return rows.withColumn("_used", used).filter(F.col("_used") < budget).withColumn(text, F.left(F.col(text), (budget - F.col("_used")).cast("int"))).drop("_used")


def last_n(rows: DataFrame, n: int, key: str, *order: str) -> DataFrame:
    """The last n rows of each key in the given order, with ``position`` from 1, oldest first."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    kept = rows.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= n)
    size = F.count("*").over(Window.partitionBy(key))
    return kept.withColumn("position", (size - F.col("_back") + 1).cast("long")).drop("_back")


def distinct_first(items: Column, n: int) -> Column:
    """The first n distinct items of a list, in order of first occurrence, without nulls and blanks."""
    return F.slice(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))), 1, n)
