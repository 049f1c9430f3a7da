"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window can only occur where all its words do, so it is indexed under one necessary word:
its rarest by document frequency over the whole corpus. Where that word stands in a document,
the window's place is known; it must fit (length and position bounds), its second-rarest word
must stand where it should, and then the words are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import broadcast, fresh, save, text_key

WINDOW = 13
#: Windows that are broadcast at once; a larger benchmark is taken in several blocks. Their words are kept once
#: each, so a window takes about 0.5 kB as Python objects and a block at most 100 MB in the driver and in each worker.
BLOCK = 200_000

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

_KEEP = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case; a null text has none."""
    return (text or "").encode("utf-8", "replace").translate(_KEEP).split()


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(window, item)``: each distinct run of ``size`` words (a shorter item: all its words) and an item it is of."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                found = words(text)
                if found:
                    out += [(b" ".join(found[i : i + size]), item) for i in range(max(1, len(found) - size + 1))]
            yield pd.DataFrame(out, columns=["window", "item"])

    return (
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
        .mapInPandas(cut, "window binary, item string")
        .distinct()
    )


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many of all documents each word of a bounded vocabulary occurs."""
    known = broadcast(docs, vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(known.value.intersection(words(text)))
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    totals = docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in totals.collect()}  # a row for each word of the vocabulary at most


def index(rows: list[tuple[bytes, list[str]]], rarity: dict[bytes, int]) -> dict[bytes, list[tuple]]:
    """By prefix word: its offset, the second-rarest word's offset, that word, the window's words, its items."""
    by: dict[bytes, list[tuple]] = {}
    same: dict[bytes, bytes] = {}
    for window, items in rows:
        parts = tuple(same.setdefault(w, w) for w in window.split(b" "))
        order = sorted(range(len(parts)), key=lambda i: (rarity.get(parts[i], 0), parts[i], i))
        first, second = order[0], order[min(1, len(order) - 1)]
        by.setdefault(parts[first], []).append((first, second, parts[second], parts, tuple(items)))
    return by


def matches(found: list[bytes], by: dict[bytes, list[tuple]]) -> tuple[bytearray, set[str]]:
    """Which words of a document any window covers, and the items of the windows that occur."""
    hit, items, n = bytearray(len(found)), set(), len(found)
    for at, word in enumerate(found):
        for offset, second, other, parts, of in by.get(word, ()):
            start = at - offset
            end = start + len(parts)
            if start >= 0 and end <= n and found[start + second] == other and tuple(found[start:end]) == parts:
                hit[start:end] = b"\x01" * len(parts)
                items.update(of)
    return hit, items


def _row(n: int, hits: int, items: set[str]) -> tuple:
    return n, hits, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hits > 0 and 20 * hits >= n


def _block(docs: DataFrame, cut: DataFrame, part: int, parts: int) -> dict[bytes, list[tuple]]:
    """The index of one of ``parts`` blocks of the windows."""
    mine = cut.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part) if parts > 1 else cut
    rows: dict[bytes, list[str]] = {}
    for r in mine.toLocalIterator():  # about a block of rows
        rows.setdefault(bytes(r.window), []).append(r.item)
    rarity = frequencies(docs, {w for x in rows for w in x.split(b" ")})
    return index(list(rows.items()), rarity)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``docs`` with a struct column ``contamination`` (RESULT) from ``text`` against ``benchmark(item_id, text)``.

    A word is hit if any occurrence of a window covers it; a document is contaminated if
    hits make up a twentieth of its words or more. A null text has no words, an item without
    words no window; items with one id count once and a null id as ''. An empty benchmark
    hits nothing. Other columns stay, whatever their names (``contamination`` is replaced).
    Documents are not shuffled for a benchmark of up to ``block`` windows. A larger one takes
    a pass over the documents for each block, whose hits are joined by the text's hashes.
    """
    ship(docs.sparkSession)
    cut = save(windows(benchmark, size), "windows")
    parts = -(-cut.count() // block)
    if parts <= 1:
        by = broadcast(docs, _block(docs, cut, 0, 1) if parts else {})

        @F.pandas_udf(RESULT)
        def judge(text: pd.Series) -> pd.DataFrame:
            out = []
            for x in text:
                found = words(x)
                hit, items = matches(found, by.value)
                out.append(_row(len(found), sum(hit), items))
            return pd.DataFrame(out, columns=[f.split()[0] for f in RESULT.split(", ")])

        return docs.withColumn("contamination", judge("text"))
    return _in_blocks(docs, cut, parts)


def _in_blocks(docs: DataFrame, cut: DataFrame, parts: int) -> DataFrame:
    found_in = "k1 long, k2 long, hits binary, items array<string>"
    keyed = docs.select("text", *text_key())
    all_hits = None
    for part in range(parts):
        by = broadcast(docs, _block(docs, cut, part, parts))

        def find(batches: Iterator[pd.DataFrame], by=by) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                    hit, items = matches(words(text), by.value)
                    if items:
                        out.append((k1, k2, np.packbits(np.frombuffer(hit, np.uint8)).tobytes(), sorted(items)))
                yield pd.DataFrame(out, columns=["k1", "k2", "hits", "items"])

        hits = save(keyed.mapInPandas(find, found_in).distinct(), "hits")
        all_hits = hits if all_hits is None else all_hits.unionByName(hits)
    merged = all_hits.groupBy("k1", "k2").agg(F.collect_list("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    @F.pandas_udf(RESULT)
    def judge(text: pd.Series, hits: pd.Series, items: pd.Series) -> pd.DataFrame:
        out = []
        for x, h, i in zip(text, hits, items, strict=True):
            n = len(words(x))
            bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in h]) if h is not None else np.zeros(0, np.uint8)
            out.append(_row(n, int(np.unpackbits(bits).sum()), set(i) if i is not None else set()))
        return pd.DataFrame(out, columns=[f.split()[0] for f in RESULT.split(", ")])

    first, second = text_key()
    k1, k2, j1, j2, hits, items = fresh(docs, "_k1", "_k2", "_j1", "_j2", "_hits", "_items")
    right = merged.select(F.col("k1").alias(j1), F.col("k2").alias(j2), F.col("hits").alias(hits), F.col("items").alias(items))
    joined = docs.withColumns({k1: first, k2: second}).join(right, (F.col(k1) == F.col(j1)) & (F.col(k2) == F.col(j2)), "left")
    return joined.withColumn("contamination", judge("text", hits, items)).drop(k1, k2, j1, j2, hits, items)


def verdict(field: str) -> Column:
    return F.col("contamination").getField(field)
