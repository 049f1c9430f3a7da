"""Exact top-k search among binary codes by incremental multi-index hashing.

A code of 64 bits is cut into m segments. If two codes differ in at most m * r + a bits, one
of the first a + 1 segments differs in at most r bits or a later one in at most r - 1. So
segments are probed with growing radius, and a query ends once its k-th verified distance is
at most the distance provably covered.

Distinct codes are keyed by the value of each segment, and the queries' probes of a radius
are shuffled to them. Of all segments at which a pair meets, one is the first, and both codes
tell which: the pair is taken there alone, so nothing is ever compared twice or made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save

K = 10
BITS = 64
#: Bits of a segment: as many as tell the distinct codes apart, within these bounds.
LEAST_BITS, MOST_BITS = 4, 20
#: Codes that share a segment's value beyond this are dealt to several tasks, and its probes go to all of them.
HOT = 20_000
#: Values known to be hot that are broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_VALUES = 100_000


def with_codes(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, code)``: bit i is set where component i, counted modulo 64, is positive; a null vector has no code."""
    ones = F.transform(
        F.col(vector),
        lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (i % BITS).cast("int"))).otherwise(F.lit(0).cast("long")),
    )
    code = F.aggregate(ones, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return rows.filter(F.col(vector).isNotNull()).select(F.col(row_id).cast("long").alias("id"), code.alias("code"))


def segments(n: int) -> list[tuple[int, int]]:
    """``(first bit, bits)`` of each segment for n distinct codes: some log2 n bits each, as even as can be."""
    most = max(LEAST_BITS, min(MOST_BITS, n.bit_length() - 1))
    m = -(-BITS // most)
    ends = [BITS * j // m for j in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _part(code: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _keys(parts: list[tuple[int, int]], code: str) -> Column:
    return F.array(*[F.struct(F.lit(j).alias("segment"), F.lit(x[1]).alias("bits"), _part(F.col(code), *x).alias("value")) for j, x in enumerate(parts)])


def _masks(spark: SparkSession, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """``(bits, mask)``: all numbers of a segment's bits of which ``radius`` are set, at most 184,756."""
    first, *more = [spark.range(1 << bits).filter(F.bit_count("id") == radius).select(F.lit(bits).alias("bits"), F.col("id").alias("mask")) for bits in sorted({x[1] for x in parts})]
    for x in more:
        first = first.unionByName(x)
    return first


def _probes(state: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """The values at this radius from those of each query, of the segments still needed to cover the distance ``within``."""
    needed = F.filter(_keys(parts, "query"), lambda x: F.col("within") >= len(parts) * radius + x["segment"])
    at = state.select("query", "within", F.explode(needed).alias("at")).select("query", "within", "at.*")
    masks = F.broadcast(_masks(state.sparkSession, parts, radius))
    return at.join(masks, "bits").select("segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"), "query", "within")


def _first_met(parts: list[tuple[int, int]], segment: Column, differ: Column, radius: int) -> Column:
    """Whether two codes meet at this segment and radius for the first time."""
    met = F.lit(True)
    for j, x in enumerate(parts):
        apart = F.bit_count(_part(differ, *x))
        met = met & F.when(segment > j, apart > radius).when(segment < j, apart >= radius).otherwise(True)
    return met


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, hot: int = HOT) -> DataFrame:
    """``(query_id, rank, id, distance)``: the k rows nearest to each query by Hamming distance, ties by id.

    Both sides have ``(id, code)``. A row is not its own neighbour: rows of the query's id are
    left out. Rows without id cannot be told apart and are left out too, as are those without
    code; ids should be unique (repeated rows of one id and code count once). Fewer than k other
    rows give fewer ranks, and an empty side gives no rows. Other columns are not looked at.
    Segment values that more than ``hot`` codes share are split.
    """
    there = "id is not null and code is not null"
    rows, asked = rows.filter(there).select("id", "code").distinct(), queries.filter(there).select("id", "code").distinct()
    need = k + 1  # a query's own row is among the nearest to its code, and left out at the end
    # ties go to the smaller id, so no more than the first ids of a code can be needed
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    kept = rows.withColumn("place", place).filter(F.col("place") <= need)
    codes = save(kept.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    parts = segments(codes.count())
    m, widest = len(parts), max(bits for _, bits in parts)

    keyed = codes.select("code", "ids", F.explode(_keys(parts, "code")).alias("at")).select("at.segment", "at.value", "code", "ids")
    full = save(keyed.groupBy("segment", "value").count().filter(F.col("count") > hot).select("segment", "value", F.ceil(F.col("count") / hot).cast("int").alias("n")), "hot_values")
    n_full = full.limit(BROADCAST_VALUES + 1).count()
    few = F.broadcast if n_full <= BROADCAST_VALUES else lambda x: x

    def dealt(keys: DataFrame, salt: Column) -> DataFrame:
        if not n_full:
            return keys.withColumn("salt", F.lit(0))
        return keys.join(few(full), ["segment", "value"], "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("salt", salt).drop("n")

    keyed = dealt(keyed, F.pmod(F.xxhash64("code"), F.col("n")).cast("int"))
    # queries of one code are one search
    entry = "array<struct<distance:int,first:long,ids:array<long>>>"
    state = asked.select(F.col("code").alias("query")).distinct().select("query", F.array().cast(entry).alias("best"), F.lit(BITS).alias("within"))
    ended = []
    for radius in range(widest + 1):
        probes = dealt(_probes(state, parts, radius), F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        differ = F.col("query").bitwiseXOR(F.col("code"))
        met = probes.join(keyed, ["segment", "value", "salt"]).filter(_first_met(parts, F.col("segment"), differ, radius))
        near = met.withColumn("distance", F.bit_count(differ)).filter("distance <= within").select("query", "distance", F.get("ids", F.lit(0)).alias("first"), "ids")
        # a code among those of the first rows is among the first codes by distance and smallest id
        place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "first"))
        new = near.withColumn("place", place).filter(F.col("place") <= need).groupBy("query").agg(F.collect_list(F.struct("distance", "first", "ids")).alias("new"))
        both = F.slice(F.array_sort(F.concat("best", F.coalesce("new", F.array().cast(entry)))), 1, need)
        # the least distance within which there are enough rows
        sums = F.aggregate("best", F.struct(F.lit(0).alias("rows"), F.lit(BITS).alias("reach")), lambda a, x: F.struct((a["rows"] + F.size(x["ids"])).alias("rows"), F.when(a["rows"] >= need, a["reach"]).otherwise(x["distance"]).alias("reach")))
        within = F.when(sums["rows"] >= need, sums["reach"]).otherwise(BITS)
        state = save(state.join(new, "query", "left").select("query", both.alias("best")).withColumn("within", within), "nearest")
        covered = m * (radius + 1) - 1
        over = F.col("within") <= covered if radius < widest else F.lit(True)
        ended.append(state.filter(over))
        state = state.filter(~over)
        if state.isEmpty():
            break
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    entries = asked.join(out, asked["code"] == out["query"]).select(F.col("id").alias("query_id"), F.explode("best").alias("x"))
    out = entries.select("query_id", F.col("x.distance").cast("long").alias("distance"), F.explode("x.ids").alias("id")).filter("id <> query_id")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
