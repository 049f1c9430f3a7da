"""Nearest neighbours by inner product, through randomly rotated one-bit codes.

A vector less the centre is rotated at random and each component's sign kept, a bit each. An
inner product with a query is estimated from the bits and two scalars of the row: its length
beyond the centre, and how well the bits stand for its direction. The estimate's error has a
known spread, and a row is scored in full where its estimate and so many spreads (``SPREADS``)
could put it among the k best found so far. Rows and queries meet in blocks of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import broadcast, matrix, save, scratch

K = 20
#: Spreads of the error that an estimate may be off, and bits a component. A recall test holds for these.
SPREADS, BITS = 3.0, 4
#: Rows that the centre is taken of, rows and queries of a block, the fewest rows worth a block of their own.
SAMPLE, ROWS, QUERIES, LEAST = 8192, 32768, 4096, 2048
#: Rows and queries estimated at once within a block (float32 each pair).
_STEP, _ASKED = 4096, 512
_SEED = 20
_LAST = 9223372036854775807


@lru_cache(maxsize=4)
def rotation(size: int, bits: int) -> np.ndarray:
    """``bits`` x ``size``, with orthonormal columns: the same for all tasks."""
    return np.linalg.qr(np.random.default_rng(_SEED + size).standard_normal((bits, size)))[0]


def code_bits(size: int) -> int:
    return max(64, -(-BITS * size // 64) * 64)


def encode(v: np.ndarray, centre: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, the factor from a code's product with a rotated query to the estimate, and the spread for a query of length 1."""
    rest = v - centre
    length = np.sqrt((rest**2).sum(1))
    turned = rest @ rotation(v.shape[1], bits).T
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = np.abs(turned).sum(1) / (length * bits**0.5)  # the code's inner product with the direction that it stands for
        factor = length / (fit * bits**0.5)
        spread = length * np.sqrt(np.maximum(0.0, 1.0 - fit**2)) / (fit * (bits - 1) ** 0.5)
    still = length == 0
    return np.packbits(turned > 0, axis=1), np.where(still, 0.0, factor), np.where(still, 0.0, spread)


def inner(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``i`` of ``a`` with ``j`` of ``b``, summed in the order of the components."""
    out = np.zeros(len(i))
    for x, y in zip(a.T, b.T, strict=True):
        out += x[i] * y[j]
    return out


def _best(query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k best, by score and then id."""
    order = np.lexsort((ids[row], -score, query))
    starts = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - starts < k]


def search_block(asked: np.ndarray, asked_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, codes: tuple, centre: np.ndarray, k: int, spreads: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, row, score)``: each query's k best of the rows, but for rows of its own id."""
    packed, factor, spread = codes
    bits = packed.shape[1] * 8
    turned = (asked @ rotation(v.shape[1], bits).T).astype(np.float32)
    signs = np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1
    lengths, middle = np.sqrt((asked**2).sum(1)), asked @ centre
    # the margin is for single precision; where lengths overflow, the bound is none and all is scored
    off = spreads * spread + 1e-5 * np.abs(factor) * bits**0.5
    query, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.full(len(asked), -np.inf)
    for start in range(0, len(v), _STEP):
        part = slice(start, start + _STEP)
        near = signs[part] @ turned.T * factor[part, None] + middle[None, :]
        if start == 0 and len(near) > k:  # what the estimates put first is scored first, for a bound to begin with
            top = np.argpartition(-np.nan_to_num(near, nan=np.inf), k, axis=0)[: k + 1].T
            at = np.repeat(np.arange(len(asked)), top.shape[1])
            sure = np.where(ids[top.ravel()] == asked_ids[at], -np.inf, inner(asked, v, at, top.ravel())).reshape(top.shape)
            least = np.sort(sure, axis=1)[:, 1]
        j, i = np.nonzero(~(near + off[part, None] * lengths[None, :] < least[None, :]))
        j += start
        other = ids[j] != asked_ids[i]
        i, j = i[other], j[other]
        query, row, score = np.concatenate([query, i]), np.concatenate([row, j]), np.concatenate([score, inner(asked, v, i, j)])
        keep = _best(query, row, score, ids, k)
        query, row, score = query[keep], row[keep], score[keep]
        full = np.bincount(query, minlength=len(asked)) == k
        worst = np.full(len(asked), np.inf)
        np.minimum.at(worst, query, score)
        least = np.where(full, np.maximum(least, worst), least)
    return query, row, score


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def index(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``(id, size, v, code, factor, spread)`` of every usable row, and the centres by length; rows repeated whole count once.

    Only the centres, at most one for each length, come from a sample of SAMPLE rows; a
    length that is not in it has its centre at 0.
    """
    ship(rows.sparkSession)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["v"] = [np.asarray(x, np.float64).tobytes() for x in batch["v"]]
            yield batch

    own = rows.select(F.coalesce(F.col(row_id).cast("long"), F.lit(_LAST)).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    own = own.filter(usable(F.col("v"))).select("id", F.size("v").alias("size"), "v")
    plain = save(own.mapInPandas(packed, "id long, size int, v binary").distinct(), "vectors")
    sample = plain.select("size", "v").orderBy(F.xxhash64("v", "id")).limit(SAMPLE).toPandas()
    centres = {int(size): matrix(some["v"], np.float64, size).mean(0) for size, some in sample.groupby("size")}
    held = broadcast(rows, centres)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, some in batch.groupby("size"):
                v = matrix(some["v"], np.float64, size)
                codes, factor, spread = encode(v, held.value.get(size, np.zeros(size)), code_bits(size))
                yield some.assign(code=[x.tobytes() for x in codes], factor=factor, spread=spread)

    return save(plain.mapInPandas(coded, "id long, size int, v binary, code binary, factor double, spread double"), "codes"), centres


def nearest(rows: DataFrame, asked: Column, k: int = K, spreads: float = SPREADS, row_id: str = "vec_id", vector: str = "embedding", block: int = ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of the largest inner product for each row that ``asked``, a condition on ``id``, holds for.

    Every row is indexed. Scores are exact in double precision, summed in the order of the
    components; ties go to the smaller id. Vectors that are null or zero, or hold null or
    non-finite components, take no part; rows repeated whole count once, rows of the query's
    id are its own, a null id comes last among ties, and only vectors of one length meet. Fewer
    than k other rows give fewer ranks. An empty table gives no rows; other columns are not read.
    """
    with scratch() as keep:
        coded, centres = index(rows, row_id, vector)
        queries = coded.filter((F.col("id") != _LAST) & asked)
        n, n_asked = coded.count(), queries.count()
        cores = rows.sparkSession.sparkContext.defaultParallelism
        blocks = max(1, -(-n // block), min(2 * cores, -(-n // LEAST)))
        chunks = max(1, -(-n_asked // QUERIES))
        held = broadcast(rows, centres)

        def search(asking: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
            out = []
            for size, some in asking.groupby("size") if len(mine) else ():
                own = mine[mine["size"] == size]
                v, ids = matrix(own["v"], np.float64, size), own["id"].to_numpy(np.int64)
                codes = (matrix(own["code"], np.uint8, code_bits(size) // 8), own["factor"].to_numpy(), own["spread"].to_numpy())
                for start in range(0, len(some), _ASKED):
                    now = some.iloc[start : start + _ASKED]
                    i, j, score = search_block(matrix(now["v"], np.float64, size), now["id"].to_numpy(np.int64), v, ids, codes, held.value.get(size, np.zeros(size)), k, spreads)
                    out.append(pd.DataFrame({"ask": now["ask"].to_numpy()[i], "query_id": now["id"].to_numpy()[i], "vec_id": ids[j], "score": score}))
            return pd.concat(out) if out else pd.DataFrame({"ask": [], "query_id": [], "vec_id": [], "score": []}).astype({"ask": "int64", "query_id": "int64", "vec_id": "int64"})

        # blocks of rows meet blocks of queries: each side is sent as often as the other has blocks
        every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
        asking = queries.select(F.xxhash64("id", "v").alias("ask"), "id", "size", "v").withColumn("chunk", F.pmod("ask", F.lit(chunks))).withColumn("block", every(blocks))
        mine = coded.withColumn("block", F.pmod(F.xxhash64("v", "id"), F.lit(blocks))).withColumn("chunk", every(chunks))
        key = ("block", "chunk")
        found = asking.groupBy(*key).cogroup(mine.groupBy(*key)).applyInPandas(search, "ask long, query_id long, vec_id long, score double")
        best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
        known = F.when(F.col("vec_id") != _LAST, F.col("vec_id")).alias("vec_id")
        return keep(save(ranked.select("query_id", "rank", known, "score"), "neighbours"))
