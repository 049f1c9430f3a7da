"""Packing into fixed windows by minimum bin slack.

Whole windows are cut off each document; what remains, under one window, is packed. All that
matters of the remainders is how many there are of each length, at most ``capacity`` counts.
A bitset dynamic program over the lengths finds the multiset that fills a window closest to
capacity, backtracking gives its counts, and the same filling is used as often as the lengths
left allow. Remainders then take their places by their number among those of their length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import broadcast, save

CAPACITY = 4096
END = 2
#: Parts whose ids a worker remembers; beyond, it starts anew and looks back to those for a while.
REMEMBER = 500_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# How the vocabulary file splits lower-case text, for characters up to U+024F; what those are.
_LETTER, _NUMBER = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
_PLAIN = re.compile(r"[\t\n\v\f\r -~¡-įı-ɏ]*")


class Encoder(dict):
    """Token ids by part of a text, as the tokenizer splits it.

    Texts of plain characters are split here, and only parts not seen lately are encoded,
    those of a text together. Other texts, and such as hold a special token, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)

    def _learn(self, parts: list[str]) -> None:
        """Remember the parts' ids; the part of an id is the encoding's word."""
        if len(self) + len(parts) > REMEMBER:
            self.old = dict(self)
            self.clear()
        new = []
        for part in parts:
            known = self.old.get(part)
            if known is None:
                new.append(part)
            else:
                self[part] = known
        if new:
            encoding = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
            ids = np.array(encoding.ids, "<u2")
            ends = np.searchsorted(encoding.word_ids, np.arange(len(new)), "right").tolist()
            start = 0
            for part, end in zip(new, ends, strict=True):
                self[part] = ids[start:end].tobytes()
                start = end

    def ids(self, text: str | None) -> np.ndarray:
        """The text's ids, then the end id."""
        text = text or ""
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], "<u2")
        parts = _PARTS.findall(text.lower())
        found = list(map(self.get, parts))
        if None in found:
            self._learn(list(dict.fromkeys([p for p, x in zip(parts, found, strict=True) if x is None])))
            found = [x or self[p] for p, x in zip(parts, found, strict=True)]
        found.append(END.to_bytes(2, "little"))
        return np.frombuffer(b"".join(found), "<u2")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def fill(capacity: int, lengths: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """Which of the lengths (descending), and how often, add up closest to capacity from below; large ones first.

    ``reached[i]`` has bit s set if the first i lengths, within their counts, can add up to s.
    """
    full, mask = 1 << capacity, (1 << (capacity + 1)) - 1
    reached = [1]
    for size, count in zip(lengths, counts, strict=True):
        now, left, step = reached[-1], min(count, capacity // size), 1
        while left > 0:  # counts as sums of powers of two
            take = min(step, left)
            now |= (now << (size * take)) & mask
            left -= take
            step *= 2
        reached.append(now)
        if now & full:
            break
    total, chosen = reached[-1].bit_length() - 1, []
    for i in range(len(reached) - 1, 0, -1):
        size, used = lengths[i - 1], 0
        while not reached[i - 1] >> total & 1:
            total -= size
            used += 1
        if used:
            chosen.append((size, used))
    return chosen[::-1]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[list[tuple[int, int]], int]], list[tuple[int, int]]]:
    """Windows for ``counts[length]`` remainders: fillings with how often each is used, and the lengths left with their counts.

    Each filling has the largest length left. Those left at the end fill no window together.
    """
    left = {int(i): int(counts[i]) for i in np.flatnonzero(counts) if i}
    total = sum(k * v for k, v in left.items())
    fillings = []
    while total >= capacity:
        order = sorted(left, reverse=True)
        first = order[0]
        rest = [(x, left[x] - (x == first)) for x in order if x <= capacity - first]
        rest = [(x, n) for x, n in rest if n]
        chosen = dict(fill(capacity - first, [x for x, _ in rest], [n for _, n in rest])) if rest else {}
        chosen[first] = chosen.get(first, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        fillings.append((sorted(chosen.items(), reverse=True), times))
        for x, n in chosen.items():
            left[x] -= n * times
            total -= x * n * times
            if not left[x]:
                del left[x]
    return fillings, sorted(left.items(), reverse=True)


def powers(length: int) -> list[int]:
    """The powers of two that add up to length, largest first."""
    return [1 << i for i in range(length.bit_length() - 1, -1, -1) if length >> i & 1]


def places(counts: np.ndarray, capacity: int = CAPACITY) -> dict:
    """Where the k-th remainder of each length goes; its size is bounded by the capacity, not the data.

    ``by`` has, for each length, its windows as (first number, first sequence, offset, how
    many a window); ``cut`` the first number left over and the first of the sequences of
    those, each of which is cut into powers of two.
    """
    fillings, rest = plan(counts, capacity)
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for chosen, times in fillings:
        at = 0
        for length, n in chosen:
            by.setdefault(length, []).append((used.get(length, 0), base, at, n))
            used[length] = used.get(length, 0) + n * times
            at += n * length
        base += times
    cut = {}
    for length, n in rest:
        cut[length] = (used.get(length, 0), base)
        base += n * len(powers(length))
    return {"by": by, "cut": cut, "sequences": base}


def place(where: dict, length: int, number: int) -> list[tuple[int, int, int, int]]:
    """The pieces of a remainder: start within it, length, sequence, offset."""
    if length in where["cut"] and number >= where["cut"][length][0]:
        first, base = where["cut"][length]
        sizes = powers(length)
        base += (number - first) * len(sizes)
        return [(sum(sizes[:i]), size, base + i, 0) for i, size in enumerate(sizes)]
    windows = where["by"][length]
    first, base, at, n = windows[bisect_right(windows, number, key=lambda x: x[0]) - 1]
    turn, nth = divmod(number - first, n)
    return [(0, length, base + turn, at + nth * length)]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (PIECES) of all documents in sequences of at most ``capacity`` tokens.

    Every token of each row's text, and the end id after it, is in exactly one piece. A null
    text is empty: its end id alone. Repeated rows are packed each; a null doc_id stays null.
    Only the lengths of remainders, at most ``capacity`` counts, come to the driver. A
    window's filling may miss the capacity by a few tokens of padding; the remainders that
    are too few for one more window are cut into powers of two, each its own sequence
    without padding. ``capacity`` must be a power of two, so that whole windows have none.
    Further columns of ``docs`` are ignored.
    """

    ship(docs.sparkSession)

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen, whole = np.zeros(capacity, np.int64), 0
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = of.ids(text)
                n, rest = len(ids), len(ids) % capacity
                full = [_crc(ids[i : i + capacity]) for i in range(0, n - rest, capacity)]
                tail, crcs = ids[n - rest :], []
                if rest:
                    at = 0
                    crcs.append(_crc(tail))
                    for size in powers(rest):
                        crcs.append(_crc(tail[at : at + size]))
                        at += size
                out.append((None if pd.isna(doc) else int(doc), n, part, rest, int(seen[rest]), whole, full, crcs))
                seen[rest] += 1
                whole += len(full)
            yield pd.DataFrame(out, columns=["doc_id", "n", "part", "rest", "number", "before", "full", "tail"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n long, part int, rest int, number long, before long, full array<long>, tail array<long>"
    rows = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tokens, schema), "tokens")

    # rows are numbered within their task; what earlier tasks hold is added by a running sum over tasks
    each = rows.groupBy("rest", "part").agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = each.select("rest", "part", F.coalesce(F.sum("rows").over(earlier.partitionBy("rest")), F.lit(0)).alias("shift"))
    whole = rows.groupBy("part").agg(F.sum(F.size("full")).alias("whole")).select("part", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("wholes"))
    counts = np.zeros(capacity, np.int64)
    for r in each.groupBy("rest").agg(F.sum("rows").alias("rows")).collect():  # at most ``capacity`` rows
        counts[r["rest"]] = r["rows"]
    placed = broadcast(docs, places(counts, capacity))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = placed.value
        for batch in batches:
            out = []
            for doc, n, rest, number, first, full, tail in zip(*[batch[c] for c in ("doc_id", "n", "rest", "number", "first", "full", "tail")], strict=True):
                doc = None if pd.isna(doc) else int(doc)
                for i, crc in enumerate(full):
                    out.append((doc, i * capacity, capacity, int(crc), n, where["sequences"] + first + i, 0))
                if rest:
                    found = place(where, rest, number)
                    crcs = tail[:1] if len(found) == 1 else tail[1:]
                    for (at, length, sequence, offset), crc in zip(found, crcs, strict=True):
                        out.append((doc, n - rest + at, length, int(crc), n, sequence, offset))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    numbered = (
        rows.join(shift, ["rest", "part"])
        .join(whole, "part")
        .select("doc_id", "n", "rest", (F.col("number") + F.col("shift")).alias("number"), (F.col("before") + F.col("wholes")).alias("first"), "full", "tail")
    )
    return numbered.mapInPandas(pieces, PIECES)
