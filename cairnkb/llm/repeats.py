"""Which windows of a fixed length occur more than once in a corpus, exactly and without a row for each position.

Both repeat removers share this recursion. At a level, each window of W symbols is known by
the gram of L < W symbols in it whose hash is smallest (the leftmost on a tie). The choice
depends on the window alone, so equal windows have equal grams at equal places. Neighbouring
windows with one gram form a span; a window can only be repeated if its gram is. Hence:

- spans whose gram occurs once are done: nothing in them repeats;
- spans whose whole content occurs again are done: everything in them repeats;
- of the rest, one copy of each distinct content goes to the next level with a longer gram,
  along with what it may match, if need be narrowed first to the windows that can recur (see
  ``suffixes``). At the last level L = W, a span is one window.

Grams thin the positions by about 2 / (W - L + 2), and only what neither rule settles is cut
finer. Spans of one content that overlap in a part, as in periodic text, are one row. The
levels end where no candidate is left. All counts are partial sums before their shuffle; no
group is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import drop, save

#: Windows handled at once, so that long texts take bounded memory.
SEGMENT = 1 << 19
#: Bytes of short parts that are handled together, and of results put together.
TOGETHER = 1 << 20
_INDEX = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)

#: A part's span: starts lo to hi - 1, the gram's hash and place ``at``, the content's hashes; ``n`` such spans overlap, up to ``end``.
SPANS = "p1 long, p2 long, lo int, hi int, end int, n long, at int, gram long, c1 long, c2 long"


class Sequence:
    """Some parts' symbols, one part after another."""

    buffer: bytes
    #: How many symbols each part has.
    counts: np.ndarray

    def codes(self, start: int, stop: int) -> np.ndarray:
        """A 64-bit hash of each symbol of a range."""
        raise NotImplementedError

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbols lo to hi - 1 begin and end in ``buffer``."""
        raise NotImplementedError


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


_powers_kept = [np.zeros(0, np.uint64)] * 2


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers_kept[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        _powers_kept[:] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _powers_kept[0][:n], _powers_kept[1][:n]


def gram_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` symbols: rolling sums modulo 2**64, mixed."""
    n = len(symbols)
    up, down = _tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up, out=sums[1:])
    h = (sums[length:] - sums[: n - length + 1]) * down[: n - length + 1]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours: prefix and suffix minima of blocks."""
    if width == 1:
        return x
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:n] = x
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def spans(sequence: Sequence, window: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the windows within parts: each span's part, first and past-last start, gram's place and hash, by segments."""
    owner = np.repeat(np.arange(len(sequence.counts), dtype=np.int32), sequence.counts)
    total, width = len(owner) - window + 1, window - length + 1
    for at in range(0, max(total, 0), SEGMENT):
        stop = min(at + SEGMENT, total)
        h = gram_hashes(sequence.codes(at, stop + window - 1), length)
        if width == 1:
            place = np.arange(len(h))
        else:
            place = (_sliding_min((h & ~_INDEX) | np.arange(len(h), dtype=np.uint64), width) & _INDEX).astype(np.int64)
        place[owner[at:stop] != owner[at + window - 1 : stop + window - 1]] = -1  # across two parts
        edge = np.flatnonzero(np.diff(place)) + 1
        lo = np.concatenate([[0], edge])
        hi = np.concatenate([edge, [len(place)]])
        inside = place[lo] >= 0
        lo, hi = lo[inside], hi[inside]
        yield owner[at + lo], lo + at, hi + at, place[lo] + at, h[place[lo]]


def _groups(sizes: np.ndarray, most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of about ``most`` in all; a larger one is alone or last."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def _merged(part: np.ndarray, lo: np.ndarray, hi: np.ndarray, keys: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of one part and content whose windows overlap, as one: the first of each, where the last ends, how many there are."""
    order = np.lexsort((lo, keys[:, 1], keys[:, 0], part))
    p, k, a, b = part[order], keys[order], lo[order], hi[order]
    on = (p[1:] == p[:-1]) & (k[1:] == k[:-1]).all(1) & (a[1:] < b[:-1] + window)
    first = np.flatnonzero(np.concatenate([[True], ~on]))
    last = np.concatenate([first[1:], [len(order)]]) - 1
    return order[first], b[last], last - first + 1


def _cut(parts: DataFrame, symbols: Callable[[list[bytes]], Sequence], window: int, length: int) -> DataFrame:
    """The spans (SPANS) of ``parts(p1, p2, data)``; a span's content is hashed with its gram's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, names = xxhash.xxh3_128_digest, [x.split()[0] for x in SPANS.split(", ")]
        for batch in batches:
            p1, p2 = batch["p1"].to_numpy(), batch["p2"].to_numpy()
            for i, j in _groups(pc.binary_length(batch["data"]).to_numpy()):
                sequence = symbols(batch["data"].slice(i, j - i).to_pylist())
                before = np.cumsum(sequence.counts) - sequence.counts
                buffer = sequence.buffer
                for of, lo, hi, place, gram in spans(sequence, window, length):
                    if not len(of):
                        continue
                    first, last = sequence.bounds(lo, hi + (window - 1))
                    each = zip(first.tolist(), last.tolist(), (place - lo).tolist(), strict=True)
                    keys = np.frombuffer(b"".join([digest(buffer[a:b], s) for a, b, s in each]), "<i8").reshape(-1, 2)
                    at, end, n = _merged(of, lo, hi, keys, window)
                    shift = before[of[at]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ascontiguousarray(x)) for x in (
                            p1[i:j][of[at]], p2[i:j][of[at]], (lo[at] - shift).astype(np.int32), (hi[at] - shift).astype(np.int32),
                            (end - shift).astype(np.int32), n.astype(np.int64), (place - lo)[at].astype(np.int32),
                            gram[at].view(np.int64), keys[at, 0], keys[at, 1],
                        )],
                        names=names,
                    )

    return parts.mapInArrow(run, SPANS)


def _contents(parts: DataFrame, wanted: DataFrame, symbols: Callable[[list[bytes]], Sequence], window: int) -> DataFrame:
    """``(p1, p2, gram, at, data)`` for the next level: the contents of the ``wanted`` spans, known by their hashes.

    Copies of a part follow each other after the join, and only the first is cut. Where a
    split of a skewed key lets another copy through, its windows are counted twice, rightly:
    they do occur twice.
    """
    by_part = save(wanted.groupBy("p1", "p2").agg(F.collect_list(F.struct("lo", "hi", "c1", "c2", "gram", "at")).alias("cuts")), "cuts")
    joined = parts.join(by_part, ["p1", "p2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, size, keys, held = None, 0, [], []

        def put_together() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([x[i] for x in keys])) for i in range(4)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(held, pa.binary())], names=["p1", "p2", "gram", "at", "data"])

        for batch in batches:
            p1, p2, offsets = batch["p1"].to_numpy(), batch["p2"].to_numpy(), batch["cuts"].offsets.to_numpy()
            lo, hi, *tags = (batch["cuts"].values.field(k).to_numpy() for k in ("lo", "hi", "c1", "c2", "gram", "at"))
            for row in range(batch.num_rows):
                if before == (p1[row], p2[row]):
                    continue
                before = (p1[row], p2[row])
                sequence = symbols([batch["data"][row].as_py()])
                buffer = sequence.buffer
                for at in range(offsets[row], offsets[row + 1], 1000):
                    mine = slice(at, min(at + 1000, offsets[row + 1]))
                    first, last = sequence.bounds(lo[mine], hi[mine] + (window - 1))
                    held += [buffer[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    keys.append([x[mine] for x in tags])
                    size += int((last - first).sum())
                    if size >= 4 * TOGETHER:
                        yield put_together()
                        size, keys, held = 0, [], []
        if held:
            yield put_together()

    return joined.mapInArrow(run, "p1 long, p2 long, gram long, at int, data binary")


#: Of ``(p1, p2, gram, at, data)`` contents the windows that can recur: ``(p1, p2, gram, from, to, d1, d2, data)``, data cut to them and known by d1, d2.
Narrow = Callable[[DataFrame, int, int], DataFrame]


def repeated_windows(parts: DataFrame, symbols: Callable[[list[bytes]], Sequence], window: int, lengths: tuple[int, ...], narrow: Narrow | None = None) -> DataFrame:
    """``(p1, p2, lo, hi)``: ranges of starts of the windows in ``parts(p1, p2, data)`` that occur again.

    Parts of one key hold the same data. ``lengths`` are the gram lengths of the levels, the
    last one ``window``. Ranges of one part may repeat if several rows share its key; starts
    between overlapping repeats of one content are in the range too, so that a range covers
    repeated windows' symbols and no others. What is counted by a key is written before it is
    joined by it: both sides of the join are then plain exchanges, and Spark can split a key
    that holds a large part of the rows.
    """
    ship(parts.sparkSession)
    length, later = lengths[0], lengths[1:]
    cut = save(_cut(parts, symbols, window, length), f"spans{length}")
    twice = save(cut.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram"), f"twice{length}")
    alive = save(cut.join(twice, "gram", "left_semi"), f"alive{length}")
    drop(cut)
    distinct = save(alive.groupBy("c1", "c2").agg(F.sum("n").alias("n"), F.min("gram").alias("gram"), F.min("at").alias("at")), f"distinct{length}")
    if not later:
        whole = distinct.filter("n > 1").select("c1", "c2")
        return alive.join(whole, ["c1", "c2"], "left_semi").select("p1", "p2", "lo", F.col("end").alias("hi")).distinct()
    rivals = save(distinct.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1"), f"rivals{length}")
    status = distinct.join(rivals, "gram", "left").filter("n > 1 or m > 1").select("c1", "c2", "n", F.coalesce("m", F.lit(1)).alias("m"), "gram", "at")
    # made distinct before the join: after it Spark would do so by c1, c2 alone and could not split a content found everywhere
    apart = alive.select("p1", "p2", "lo", "hi", "end", "c1", "c2").distinct()
    spread = save(apart.join(save(status, f"status{length}"), ["c1", "c2"]), f"spread{length}")
    drop(alive)
    settled = spread.filter("n > 1").select("p1", "p2", "lo", F.col("end").alias("hi"))
    if spread.filter("m > 1").isEmpty():
        return settled.distinct()
    one = F.min(F.struct("p1", "p2", "lo", "hi", "gram", "at")).alias("one")
    wanted = spread.filter("m > 1").groupBy("c1", "c2").agg(one).select("one.*", "c1", "c2")
    inner = save(_contents(parts, wanted, symbols, window), f"contents{length}")
    if narrow:
        found = _in_narrowed(narrow(inner, window, length), symbols, window, later, narrow)
    else:
        found = repeated_windows(inner.select("p1", "p2", "data"), symbols, window, later)
    found = save(found.withColumnsRenamed({"p1": "c1", "p2": "c2", "lo": "from", "hi": "to"}), f"found{length}")
    drop(inner)
    partly = spread.filter("n = 1").join(found, ["c1", "c2"]).select("p1", "p2", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi"))
    return settled.unionByName(partly).distinct()


def _in_narrowed(narrowed: DataFrame, symbols: Callable[[list[bytes]], Sequence], window: int, later: tuple[int, ...], narrow: Narrow) -> DataFrame:
    """``(p1, p2, lo, hi)`` of narrowed contents: whole where another content narrows to the same, else by the next level.

    A gram's contents go on only while one of them is unsettled and has another to meet.
    """
    length = later[0]
    narrowed = save(narrowed, f"narrowed{length}")
    same = save(narrowed.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("gram").alias("gram")), f"same{length}")
    unsettled = save(same.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("gram"), f"unsettled{length}")
    of = narrowed.select("p1", "p2", "from", "to", "d1", "d2").join(save(same.filter("n > 1").select("d1", "d2"), f"met{length}"), ["d1", "d2"], "left_semi")
    settled = of.select("p1", "p2", F.col("from").alias("lo"), F.col("to").alias("hi"))
    if unsettled.isEmpty():
        return settled
    going = narrowed.join(unsettled, "gram", "left_semi").dropDuplicates(["d1", "d2"])
    parts = save(going.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), "data"), f"going{length}")
    found = save(repeated_windows(parts, symbols, window, later, narrow).withColumnsRenamed({"p1": "d1", "p2": "d2"}), f"narrow{length}")
    drop(parts)
    partly = narrowed.select("p1", "p2", "from", "d1", "d2").join(found, ["d1", "d2"])
    partly = partly.select("p1", "p2", (F.col("from") + F.col("lo")).alias("lo"), (F.col("from") + F.col("hi")).alias("hi"))
    return settled.unionByName(partly).distinct()


def covered(lo: list[int], hi: list[int], window: int, n: int) -> np.ndarray:
    """Of n symbols, which any of the repeated windows covers."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, np.asarray(lo, np.int64), 1)
    np.add.at(edges, np.asarray(hi, np.int64) + window - 1, -1)
    return np.cumsum(edges[:n]) > 0


def with_ranges(docs: DataFrame, keys: list, ranges: DataFrame) -> DataFrame:
    """``docs`` with ``_ranges``, the repeated ranges of each text (null: none)."""
    by = save(ranges.groupBy("p1", "p2").agg(F.collect_list(F.struct("lo", "hi")).alias("_ranges")), "ranges")
    first, second = keys
    left = docs.withColumns({"_k1": first, "_k2": second})
    return left.join(by, (left["_k1"] == by["p1"]) & (left["_k2"] == by["p2"]), "left").drop("_k1", "_k2", "p1", "p2")
