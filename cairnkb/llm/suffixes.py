"""Removal of byte strings that occur more than once, by recursive induction over sorted sampled suffixes.

A suffix for each byte would take many times the corpus on disk. Induced sorting sorts few
suffixes and derives the others from them; here, too:

1. Each window of W bytes holds a sampled suffix, that at its minimal gram (``repeats``). A
   suffix whose gram occurs once is alone, and so are the windows around it.
2. The others are sorted by what follows their gram, up to W bytes: Spark's range exchange and
   its spilled sorted runs, merged by a heap, are the disk-backed queues. Each tuple takes
   along its common prefix with its neighbours, the longest that it has with any other suffix.
   The same is done with what precedes the gram, read backwards.
3. The windows that start before a sample are induced: one that starts g bytes before can only
   recur if g bytes before the sample and W - g from it on are common. What is left of a
   sample's windows is narrowed to these. Where another narrows to the same bytes they
   are repeated; the rest recurses with a longer gram, and the last level has one window a row.

Strings of PASSAGE bytes (some forty words) are looked for first. A repeated window of 400
bytes consists of these, so the 400-byte windows are judged within runs of them alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import drop, save, text_key
from .repeats import Sequence, covered, repeated_windows

WINDOW = 400
#: Shorter repeats that are counted in ``n_shared`` and not removed.
PASSAGE = 240

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long"

#: A fixed pseudo-random number for each byte.
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(47))


class Bytes(Sequence):
    def __init__(self, parts: list[bytes]):
        self.buffer = parts[0] if len(parts) == 1 else b"".join(parts)
        self.counts = np.fromiter(map(len, parts), np.int64, len(parts))

    def codes(self, start: int, stop: int) -> np.ndarray:
        return _BYTE[np.frombuffer(self.buffer, np.uint8)[start:stop]]

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return lo, hi


def levels(window: int) -> tuple[int, ...]:
    """Gram lengths: a fifth of the window, then all but a fortieth, which leaves few windows to a gram, and the window."""
    return tuple(sorted({max(1, window // 5), window - max(1, window // 40) * 3, window}))


def neighbours(keys: pa.Array, grams: np.ndarray) -> np.ndarray:
    """The common prefix of each key with the next one, 0 if their grams differ."""
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    sizes = np.diff(offsets)
    rows = np.zeros((len(sizes), max(1, int(sizes.max()))), np.uint8)
    data = keys.buffers()[2]
    if data is not None:
        rows[np.arange(rows.shape[1]) < sizes[:, None]] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    same = rows[1:] == rows[:-1]
    common = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return np.where(grams[1:] == grams[:-1], np.minimum(common, np.minimum(sizes[1:], sizes[:-1])), 0).astype(np.int32)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows each one's longer common prefix with its neighbours; the first and the last row come with gram and key."""
    names = ["p1", "p2", "common", "gram", "key"]
    held, above, first = None, 0, True

    def out(p1, p2, common, gram, key, edge: bool) -> pa.RecordBatch:
        rest = [None] * (len(p1) - 1)
        edges = [gram[0].as_py() if edge else None, *rest], [key[0].as_py() if edge else None, *rest]
        return pa.RecordBatch.from_arrays([p1, p2, pa.array(common, pa.int32()), pa.array(edges[0], pa.int64()), pa.array(edges[1], pa.binary())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[x] for x in ("p1", "p2", "gram", "key")]
        if held is not None:
            columns = [pa.concat_arrays(x) for x in zip(held, columns, strict=True)]
        p1, p2, gram, key = columns
        below = neighbours(key, gram.to_numpy())
        up = np.concatenate([[above], below])
        n = len(p1) - 1
        if n:
            yield out(p1[:n], p2[:n], np.maximum(up[:-1], below), gram[:n], key[:n], first)
            first = False
        held, above = [x[n:] for x in columns], int(up[-1])
    if held is not None:
        p1, p2, gram, key = held
        yield out(p1, p2, [above], gram, key, True)


def common_prefixes(suffixes: DataFrame) -> DataFrame:
    """``(p1, p2, common)``: how much of its key each of ``suffixes(p1, p2, gram, key)`` has in common with another of its gram.

    Rows are dealt by all that they are sorted by, so equal keys spread over tasks. Each
    partition's first and last rows, two a partition, are then sorted and compared once more.
    """
    order, schema = ["gram", "key", "p1", "p2"], "p1 long, p2 long, common int, gram long, key binary"
    dealt = suffixes.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    found = save(dealt.mapInArrow(_prefixes, schema), "prefixes")
    edges = found.filter("key is not null").select(*order).repartition(1).sortWithinPartitions(*order).mapInArrow(_prefixes, schema)
    return found.select("p1", "p2", "common").unionByName(edges.select("p1", "p2", "common"))


def induced(contents: DataFrame, window: int, length: int) -> DataFrame:
    """Contents narrowed to the windows that the common prefixes on both sides of their sample allow (``repeats.Narrow``)."""
    ship(contents.sparkSession)
    ahead = F.substring("data", F.col("at") + 1 + length, F.octet_length("data"))
    back = F.encode(F.reverse(F.decode(F.substring("data", F.lit(1), F.col("at")), "ISO-8859-1")), "ISO-8859-1")  # byte by byte
    right = common_prefixes(contents.select("p1", "p2", "gram", ahead.alias("key")))
    left = common_prefixes(contents.select("p1", "p2", "gram", back.alias("key")))
    sides = [x.select("p1", "p2", F.lit(side).alias("side"), "common") for side, x in (("right", right), ("left", left))]
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("common")))
    both = sides[0].unionByName(sides[1]).groupBy("p1", "p2").agg(of("right").alias("right"), of("left").alias("left"))
    known = contents.join(save(both, "both_sides"), ["p1", "p2"])
    start = F.greatest(F.lit(0), F.col("at") - F.col("left"))
    stop = F.least(F.octet_length("data") - window, F.col("at") - window + length + F.col("right")) + 1
    cut = known.select("p1", "p2", "gram", start.alias("from"), stop.alias("to"), (F.col("at") - start).alias("place"), "data").filter("from < to")
    cut = cut.withColumn("data", F.substring("data", F.col("from") + 1, F.col("to") - F.col("from") + (window - 1)))
    keys = [F.xxhash64("data", "place").alias("d1"), F.xxhash64(F.lit("d2"), "data", "place").alias("d2")]
    return cut.select("p1", "p2", "gram", "from", "to", *keys, "data")


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges as disjoint ones, those that touch put together."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[first], hi[np.concatenate([first[1:], [len(lo)]]) - 1]


def _longer(parts: DataFrame, ranges: DataFrame, passage: int, window: int) -> DataFrame:
    """``(p1, p2, lo, hi)``: the repeated windows of ``window`` bytes, all of which lie in runs of repeated shorter ones.

    A run whose bytes are those of another run is repeated whole; else its windows are looked
    for in all the runs, one copy of each.
    """
    by_part = save(ranges.groupBy("p1", "p2").agg(F.collect_list(F.struct("lo", "hi")).alias("found")), "passages")
    long = window - passage + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1, p2, offsets = batch["p1"].to_numpy(), batch["p2"].to_numpy(), batch["found"].offsets.to_numpy()
            lo, hi = (batch["found"].values.field(x).to_numpy() for x in ("lo", "hi"))
            out = []
            for row in range(batch.num_rows):
                mine = slice(offsets[row], offsets[row + 1])
                starts, stops = _runs(lo[mine], hi[mine])
                keep = stops - starts >= long
                if keep.any():
                    raw = batch["data"][row].as_py()
                    out += [(p1[row], p2[row], a, b - long + 1, raw[a : b - 1 + passage]) for a, b in zip(starts[keep].tolist(), stops[keep].tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["p1", "p2", "lo", "hi", "data"])

    found = parts.join(by_part, ["p1", "p2"]).mapInArrow(cut, "p1 long, p2 long, lo int, hi int, data binary")
    runs = save(found.select("p1", "p2", "lo", "hi", F.xxhash64("data").alias("r1"), F.xxhash64(F.lit("r2"), "data").alias("r2"), "data"), "runs")
    once = save(runs.groupBy("r1", "r2").agg(F.count("*").alias("n"), F.min(F.struct("p1", "p2", "lo")).alias("one")), "run_counts")
    again = save(once.filter("n > 1").select("r1", "r2"), "whole_runs")
    settled = runs.select("p1", "p2", "lo", "hi", "r1", "r2").join(again, ["r1", "r2"], "left_semi").select("p1", "p2", "lo", "hi")
    if once.filter("n = 1").isEmpty():
        return settled
    one = save(once.select("one.*"), "run_places")
    distinct = runs.select("p1", "p2", "lo", "data", "r1", "r2").join(one, ["p1", "p2", "lo"], "left_semi").dropDuplicates(["r1", "r2"])
    distinct = save(distinct.select(F.col("r1").alias("p1"), F.col("r2").alias("p2"), "data"), "run_contents")
    inner = repeated_windows(distinct, Bytes, window, levels(window), induced)
    inner = save(inner.select(F.col("p1").alias("r1"), F.col("p2").alias("r2"), F.col("lo").alias("a"), F.col("hi").alias("b")), "in_runs")
    drop(distinct)
    partly = runs.select("p1", "p2", "lo", "r1", "r2").join(inner, ["r1", "r2"]).select("p1", "p2", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"))
    return settled.unionByName(partly)


def dedup_bytes(docs: DataFrame, window: int = WINDOW, passage: int = PASSAGE, with_text: bool = False) -> DataFrame:
    """Per row of ``docs(doc_id, text)`` what is left without repeated strings of ``window`` bytes (RESULT).

    Every byte goes that is covered by a string of ``window`` UTF-8 bytes which starts
    anywhere else too, in the same document or another; strings are judged on the input.
    A null text is empty; texts shorter than the window never lose anything; a repeated row
    is a repeat of the whole text. ``n_shared`` counts the bytes covered by strings of
    ``passage`` bytes, at most ``window``, that start anywhere else too, removed or not.
    ``with_text`` adds ``kept``, the remaining bytes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = text_key()
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    parts = docs.filter(F.octet_length("text") >= passage).select(keys[0].alias("p1"), keys[1].alias("p2"), data.alias("data"))
    shared = save(repeated_windows(parts, Bytes, passage, levels(passage), induced).select("p1", "p2", "lo", "hi"), "shared")
    removed = _longer(parts, shared, passage, window) if passage < window else shared
    every = [x.select("p1", "p2", F.struct("lo", "hi", F.lit(kind).alias("gone")).alias("range")) for kind, x in ((False, shared), (True, removed))]
    by = save(every[0].unionByName(every[1]).distinct().groupBy("p1", "p2").agg(F.collect_list("range").alias("_ranges")), "ranges")
    schema = RESULT + (", kept binary" if with_text else "")

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, raw, found in zip(batch["doc_id"], batch["data"], batch["_ranges"], strict=True):
                raw, removed, runs, also = bytes(raw), 0, 0, 0
                kept = raw
                if found is not None and len(found):
                    gone, common = (covered([r["lo"] for r in found if r["gone"] == k], [r["hi"] for r in found if r["gone"] == k], w, len(raw)) for k, w in ((True, window), (False, passage)))
                    removed, also = int(gone.sum()), int(common.sum())
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                row = (None if pd.isna(doc) else int(doc), len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), also)
                out.append(row + (kept,) if with_text else row)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})

    first, second = keys
    keyed = docs.select("doc_id", data.alias("data"), first.alias("_k1"), second.alias("_k2"))
    joined = keyed.join(by, (keyed["_k1"] == by["p1"]) & (keyed["_k2"] == by["p2"]), "left").select("doc_id", "data", "_ranges")
    return joined.mapInPandas(left, schema)
