"""Hard negatives by vantage-point trees over norm-augmented vectors.

A component more gives all rows one norm, so that an inner product is a distance: the larger
the score, the nearer, and a window of scores is an annulus around the anchor. A tree fitted
on a sample deals all rows to parts; of each part the distances to the vantage points above
it are known, and so whether an annulus meets it. An anchor first asks the nearest part, and
then, with the k-th distance found there, those that may hold something nearer. Within a part
a tree of its own is searched nearest first, and ends once k rows are found.

Distances only decide what is looked at, with a margin; scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import broadcast, matrix, save, scratch

#: Rows that the upper tree is fitted on, at most so many parts, rows of a part's block, anchors a block is asked by at once.
SAMPLE, PARTS, BLOCK, ASKED = 8192, 1024, 16384, 4096
LEAF = 512
_LAST = 9223372036854775807
#: Squared norms from here on have scores that a long cannot hold.
_LARGEST = 2.0**62
_ANY = 2**62


class Tree:
    """Points halved by their distance to a vantage point, again and again; ``order`` puts each leaf's rows side by side."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.vantage: list[int] = []  # a node's row
        self.nodes: list[list] = []  # radius, and of the near and the far side: child, least and largest distance; a leaf's child is ~leaf
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(points, leaf)
        self.order = np.concatenate(self.leaves) if self.leaves else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in self.leaves])]).astype(np.int64)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        root: list[int] = [0]
        todo = [(np.arange(len(points)), root, 0)]
        while todo:
            rows, owner, slot = todo.pop()
            sides = self._halves(points, rows) if len(rows) > leaf else None
            if sides is None:
                owner[slot] = ~len(self.leaves)
                self.leaves.append(rows)
                continue
            at, d, near, radius = sides
            node = [radius, 0, d[near].min(), d[near].max(), 0, d[~near].min(), d[~near].max()]
            owner[slot] = len(self.nodes)
            self.nodes.append(node)
            self.vantage.append(at)
            todo += [(rows[near], node, 1), (rows[~near], node, 4)]
        return root[0]

    @staticmethod
    def _halves(points: np.ndarray, rows: np.ndarray):
        for at in (rows[0], rows[-1]):  # copies of one point can't be told apart by it, so another is tried
            d = np.sqrt(((points[rows] - points[at]) ** 2).sum(1))
            middle = np.median(d)
            for near in (d <= middle, d < middle):
                if 0.05 * len(rows) <= near.sum() <= 0.95 * len(rows):
                    return int(at), d, near, float(d[near].max())
        return None


def augmented(v: np.ndarray, norms: np.ndarray, largest: int) -> np.ndarray:
    """The vectors with a component more, so that all have the squared norm ``largest``."""
    return np.column_stack([v.astype(np.float64), np.sqrt(np.maximum(0.0, float(largest) - norms.astype(np.float64)))])


def _distance(norm: float, largest: float, score) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, norm + largest - 2.0 * np.asarray(score, np.float64)))


def _numbers(v: np.ndarray, bound: int) -> np.ndarray:
    """Doubles where all sums are whole numbers below 2**53, and so exact; else longs."""
    return v.astype(np.float64) if bound < 2**53 else v


def _search(tree: Tree, rows: dict, ask: dict, to_vantage: np.ndarray, largest: float, k: int, same: bool) -> list[tuple[int, int, int]]:
    """``(window, id, score)``: of each window the first k rows by score, ties by id."""
    margin = 1e-6 * (largest**0.5 + 1.0)
    windows = [{"id": w["id"], "hi": w["hi"], "reach": max(w["lo"], w["reach"]), "s": np.zeros(0, np.int64), "i": np.zeros(0, np.int64)} for w in ask["windows"]]
    for w in windows:
        w["inner"], w["outer"] = (float(_distance(ask["norm"], largest, w[x])) for x in ("hi", "reach"))
    heap: list[tuple[float, float, int]] = [(0.0, np.inf, tree.root)]
    while heap:
        least, most, node = heappop(heap)
        if all(least > w["outer"] + margin for w in windows):
            break
        live = [w for w in windows if least <= w["outer"] + margin and most >= w["inner"] - margin]
        if not live:
            continue
        if node >= 0:
            d, (_, near, a, b, far, c, e) = to_vantage[node], tree.nodes[node]
            for child, low, high in ((near, a, b), (far, c, e)):
                heappush(heap, (max(least, d - high, low - d), min(most, d + high), child))
            continue
        part = slice(tree.starts[~node], tree.starts[~node + 1])
        scores = rows["v"][part] @ ask["v"]
        fit = ((rows["label"][part] == ask["label"]) == same) & (rows["id"][part] != ask["id"])
        for w in live:
            got = np.flatnonzero(fit & (scores <= w["hi"]) & (scores >= w["reach"]))
            if not len(got):
                continue
            s = np.concatenate([w["s"], scores[got].astype(np.int64)])
            i = np.concatenate([w["i"], rows["id"][part][got]])
            best = np.lexsort((i, -s))[:k]
            w["s"], w["i"] = s[best], i[best]
            if len(best) == k:
                w["reach"] = int(w["s"][-1])
                w["outer"] = float(_distance(ask["norm"], largest, w["reach"]))
    return [(w["id"], i, s) for w in windows for i, s in zip(w["i"].tolist(), w["s"].tolist(), strict=True)]


class Parts:
    """The upper tree: what part a row belongs to, and what parts an anchor's windows meet."""

    def __init__(self, sample: np.ndarray, norms: np.ndarray, largest: int, parts: int):
        self.size, self.largest = sample.shape[1], largest
        points = augmented(sample, norms, largest)
        tree = Tree(points, max(1, len(points) // max(1, parts)))
        self.root, self.nodes = tree.root, [(x[0], x[1], x[4]) for x in tree.nodes]
        self.points = points[tree.vantage] if tree.vantage else np.zeros((0, self.size + 1))
        self.above: dict[int, list[int]] = {}  # a part's nodes
        todo = [(self.root, [])]
        while todo:
            node, path = todo.pop()
            if node < 0:
                self.above[~node] = path
            else:
                todo += [(child, [*path, node]) for child in self.nodes[node][1:]]
        self.ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.blocks: dict[int, int] = {}

    def distances(self, v: np.ndarray, norms: np.ndarray, aug: bool) -> np.ndarray:
        """To each vantage point: rows have the added component, anchors have 0 in its place."""
        points = augmented(v, norms, self.largest) if aug else np.column_stack([v.astype(np.float64), np.zeros(len(v))])
        own = np.full(len(v), float(self.largest)) if aug else norms.astype(np.float64)
        return np.sqrt(np.maximum(0.0, own[:, None] + float(self.largest) - 2.0 * (points @ self.points.T)))

    def part(self, d: np.ndarray) -> np.ndarray:
        out = np.zeros(len(d), np.int64)
        todo = [(self.root, np.arange(len(d)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            else:
                near = d[rows, node] <= self.nodes[node][0]
                todo += [(self.nodes[node][1], rows[near]), (self.nodes[node][2], rows[~near])]
        return out

    def meets(self, d: np.ndarray, norm: float, windows: list[dict], key: str) -> list[tuple[float, int]]:
        """``(least distance, part)`` of the parts that some window meets, as far as its score ``key``."""
        margin, found = 1e-6 * (self.largest**0.5 + 1.0), []
        ends = [(float(_distance(norm, self.largest, w["hi"])), float(_distance(norm, self.largest, max(w["lo"], w[key])))) for w in windows]
        for part, (low, high) in self.ranges.items():
            own = d[self.above[part]]
            least = max(0.0, float((own - high).max(initial=0.0)), float((low - own).max(initial=0.0)))
            most = float((own + high).min(initial=np.inf))
            if any(least <= outer + margin and most >= inner - margin for inner, outer in ends):
                found.append((least, part))
        return sorted(found)


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["v"] = [np.asarray(x, np.int64).tobytes() for x in batch["v"]]
        yield batch


def whole_vectors(rows: DataFrame, row_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """``(id, label, v, norm, size)`` of the rows that take part; ``v`` holds longs, and repeated rows count once."""
    kept = rows.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    kept = kept.filter(F.col("label").isNotNull() & _usable(F.col("x"))).withColumn("v", F.transform("x", lambda x: F.floor(x * scale)))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    kept = kept.withColumn("_norm", norm).filter(F.col("_norm") < _LARGEST).withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))
    found = kept.select(F.coalesce("id", F.lit(_LAST)).alias("id"), "label", "norm", F.size("v").alias("size"), "v")
    return found.mapInPandas(_vectors, "id long, label long, norm long, size int, v binary").distinct()


def _parts(rows: DataFrame, least: int) -> tuple[Parts, DataFrame]:
    """The upper tree, and the rows with their part and block, written.

    Driver's share: the sample (SAMPLE rows), and the ranges of at most some 2 * PARTS parts.
    """
    spark = rows.sparkSession
    total = rows.agg(F.count("*"), F.max("norm")).first()
    n, largest = total[0], total[1] or 0
    per = max(1, min(BLOCK, max(least, -(-n // (2 * spark.sparkContext.defaultParallelism)))))
    sample = rows.select("v", "norm", "size").orderBy(F.xxhash64("v", "id")).limit(SAMPLE).toPandas()
    size = int(sample["size"].mode().iat[0]) if len(sample) else 0
    sample = sample[sample["size"] == size]
    tree = Parts(matrix(sample["v"], np.int64, size), sample["norm"].to_numpy(np.int64), largest, min(PARTS, -(-n // per)))
    held = broadcast(rows, tree)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = held.value
        for batch in batches:
            part = np.full(len(batch), -1, np.int64)  # rows of another length, which no anchor of this length meets
            own = np.flatnonzero(batch["size"].to_numpy() == tree.size)
            if len(own):
                some = batch.iloc[own]
                part[own] = tree.part(tree.distances(matrix(some["v"], np.int64, tree.size), some["norm"].to_numpy(np.int64), True))
            yield batch.assign(part=part)

    dealt = save(rows.mapInPandas(deal, "id long, label long, norm long, size int, v binary, part long"), "dealt_rows")

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = held.value
        for batch in batches:
            for part, some in batch.groupby("part"):
                above = tree.above.get(part, [])
                d = tree.distances(matrix(some["v"], np.int64, tree.size), some["norm"].to_numpy(np.int64), True)[:, above] if above else np.zeros((len(some), 0))
                yield pd.DataFrame({"part": part, "level": [-1, *range(len(above))], "low": [0.0, *d.min(0)], "high": [0.0, *d.max(0)], "n": [len(some)] + [0] * len(above)})

    spans = dealt.select("part", "v", "norm").mapInPandas(ranges, "part long, level int, low double, high double, n long")
    found = spans.groupBy("part", "level").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toPandas()
    for part, some in found.sort_values("level").groupby("part"):
        tree.blocks[int(part)] = max(1, -(-int(some["n"].iat[0]) // per))
        if part >= 0:
            tree.ranges[int(part)] = (some["low"].to_numpy()[1:], some["high"].to_numpy()[1:])
    blocks = spark.createDataFrame(sorted(tree.blocks.items()) or [(-1, 1)], "part long, blocks int")
    block = F.pmod(F.xxhash64("id", "label", "v"), F.col("blocks")).cast("int")
    return tree, dealt.join(F.broadcast(blocks), "part").withColumn("block", block).drop("blocks")


_WINDOWS = "array<struct<id:long,hi:long,lo:long,reach:long>>"


def _ask(rows: DataFrame, asks: DataFrame, tree: Parts, k: int, same: bool, first: bool) -> DataFrame:
    """``(ask, window, id, score)``: what the asks find in the part nearest to each (``first``), or in the others that may hold more."""
    held = broadcast(rows, tree)
    chunks = max(1, -(-asks.count() // ASKED))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = held.value
        for batch in batches:
            where = []
            for row in batch.itertuples():
                if row.size == tree.size:
                    v, windows = np.frombuffer(row.v, np.int64)[None, :], row.windows
                    d = tree.distances(v, np.array([row.norm]), False)[0]
                    home = tree.meets(d, row.norm, windows, "lo")[:1]
                    parts = [p for _, p in home] if first else [p for _, p in tree.meets(d, row.norm, windows, "reach") if p != home[0][1]]
                else:
                    parts = [-1] if first else []
                where.append([(p, b) for p in parts for b in range(tree.blocks.get(p, 0))])
            out = batch.assign(at=where).explode("at").dropna(subset=["at"])
            out["part"], out["block"] = [x[0] for x in out["at"]], [x[1] for x in out["at"]]
            yield out.drop(columns="at")

    def search(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, some in asked.groupby("size") if len(rows) else ():
            mine = rows[rows["size"] == size]
            v, norms = matrix(mine["v"], np.int64, size), mine["norm"].to_numpy(np.int64)
            largest = max(norms.max(initial=0), some["norm"].max())
            points = augmented(v, norms, largest)
            own = Tree(points, LEAF)
            exact = _numbers(v, int(largest))
            held = {"v": exact[own.order], "label": mine["label"].to_numpy()[own.order], "id": mine["id"].to_numpy()[own.order]}
            vantage = points[own.vantage][:, :size] if own.vantage else np.zeros((0, size))
            asking = matrix(some["v"], np.int64, size)
            near = np.sqrt(np.maximum(0.0, some["norm"].to_numpy(np.float64)[:, None] + float(largest) - 2.0 * (asking.astype(np.float64) @ vantage.T)))
            for i, row in enumerate(some.itertuples()):
                ask = {"id": row.id, "label": row.label, "norm": float(row.norm), "windows": row.windows, "v": asking[i].astype(exact.dtype)}
                out += [(row.ask, *x) for x in _search(own, held, ask, near[i], float(largest), k, same)]
        return pd.DataFrame(out, columns=["ask", "window", "id", "score"])

    columns = "ask long, id long, label long, norm long, size int, v binary"
    visits = asks.select("ask", "id", "label", "norm", "size", "v", "windows").mapInPandas(visit, f"{columns}, windows {_WINDOWS}, part long, block int")
    visits = visits.withColumn("chunk", F.pmod(F.xxhash64("ask"), F.lit(chunks)))
    copies = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    key = ("part", "block", "chunk")
    return visits.groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(search, "ask long, window long, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _nearest(rows: DataFrame, asks: DataFrame, tree: Parts, k: int, same: bool) -> DataFrame:
    """``(ask, window, rank, id, score)``: of each ask's windows the first k rows, of its label or of other labels."""
    home = save(_first(_ask(rows, asks, tree, k, same, True), k), "home")
    reach = home.filter(F.col("rank") == k).select("ask", F.col("window").alias("id"), F.col("score").alias("reach"))
    each = asks.select("ask", F.explode("windows").alias("w")).select("ask", "w.id", "w.hi", "w.lo")
    each = each.join(reach, ["ask", "id"], "left").select("ask", F.struct("id", "hi", "lo", F.coalesce("reach", "lo").alias("reach")).alias("w"))
    again = asks.drop("windows").join(each.groupBy("ask").agg(F.collect_list("w").alias("windows")), "ask")
    others = _ask(rows, again, tree, k, same, False)
    return save(_first(home.drop("rank").unionByName(others), k), "nearest")


def mine(
    rows: DataFrame, asked: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    row_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: int = 1024,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become floor(``scale`` * x), and a score is the inner product of such vectors.
    Anchors are the rows that ``asked``, a condition on ``id``, holds for. An anchor's
    positives are the first ``positives`` other rows of its label, and of each the first
    ``negatives`` rows of other labels whose score is from ``low`` to ``high`` hundredths of
    the positive's; ranks go by score downwards, ties by id. Fewer rows give fewer ranks, and a
    positive of negative score has no window.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor
    do those whose squared norm reaches 2**62, as their scores fit no long. Rows repeated whole
    count once; a row of an anchor's id is that anchor's own. A null id comes last among ties.
    Only rows of one length meet. An empty table gives no rows; other columns are not read.
    ``least`` is the smallest number of rows that is worth a part of its own.
    """
    ship(rows.sparkSession)
    with scratch() as keep:
        whole = save(whole_vectors(rows, row_id, vector, label, scale), "whole_vectors")
        tree, dealt = _parts(whole, least)
        dealt = save(dealt, "parts")
        ask = F.xxhash64("id", "label", "v").alias("ask")
        window = F.struct(*[F.lit(x).cast("long").alias(n) for n, x in (("id", 0), ("hi", _ANY), ("lo", -_ANY), ("reach", -_ANY))])
        anchors = save(whole.filter((F.col("id") != _LAST) & asked).select(ask, "*").withColumn("windows", F.array(window)), "anchors")
        found = _nearest(dealt, anchors, tree, positives, True)
        hi, lo = F.expr(f"floor({high} * CAST(score AS DECIMAL(38, 0)) / 100)").cast("long"), F.expr(f"ceil({low} * CAST(score AS DECIMAL(38, 0)) / 100)").cast("long")
        windows = found.filter("score >= 0").select("ask", "score").distinct().select("ask", F.struct(F.col("score").alias("id"), hi.alias("hi"), lo.alias("lo"), lo.alias("reach")).alias("w"))
        again = save(anchors.drop("windows").join(windows.groupBy("ask").agg(F.collect_list("w").alias("windows")), "ask"), "windows")
        hard = _nearest(dealt, again, tree, negatives, False)
        of = found.select("ask", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        hard = hard.select("ask", F.col("window").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = of.join(hard, ["ask", "positive_score"]).join(anchors.select("ask", F.col("id").alias("anchor_id")), "ask")
        known = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c)
        return keep(save(out.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score"), "hard_negatives"))
