"""Removal of repeated word sequences by level-wise doubling.

Windows of 8 words that are repeated, and no others, are extended to 16, those to 32, and
those to the full 35 words. A level looks at one 8-, 16- or 32-word window in each 35-word
window, the one of the smallest hash (see ``repeats``), until no candidate is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key
from .repeats import Sequence, covered, repeated_windows, with_ranges

WINDOW = 35
FIRST = 8

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def doubling(window: int, first: int = FIRST) -> tuple[int, ...]:
    """first, its doubles below the window, and the window."""
    lengths = [min(first, window)]
    while lengths[-1] * 2 < window:
        lengths.append(lengths[-1] * 2)
    return (*lengths, window) if lengths[-1] < window else tuple(lengths)


class Words(Sequence):
    """Words split at ASCII space, joined by one blank each."""

    def __init__(self, parts: list[bytes]):
        split = [x.split() for x in parts]
        self.words = list(chain.from_iterable(split))
        self.buffer = b" ".join(self.words)
        self.counts = np.fromiter(map(len, split), np.int64, len(parts))
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def codes(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, self.words[start:stop])), "<u8")

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[lo], self.ends[hi - 1]


def dedup_words(docs: DataFrame, window: int = WINDOW, first: int = FIRST, with_text: bool = False) -> DataFrame:
    """Per row of ``docs(doc_id, text)`` what is left without repeated runs of ``window`` words (RESULT).

    Words are runs of characters other than ASCII space, unchanged. Every word goes that is
    covered by a window whose words also start anywhere else, in the same document or
    another; windows are judged on the input. A null text has no words; fewer words than the
    window lose nothing; a repeated row repeats its whole text. The hash is over the kept
    words joined by one space; ``with_text`` adds them as ``kept``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = text_key()
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    parts = docs.filter(F.octet_length("text") >= 2 * window - 1).select(keys[0].alias("p1"), keys[1].alias("p2"), data.alias("data"))
    ranges = repeated_windows(parts, Words, window, doubling(window, first))
    schema = RESULT + (", kept string" if with_text else "")

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, raw, found in zip(batch["doc_id"], batch["data"], batch["_ranges"], strict=True):
                words = bytes(raw).split()
                n, removed = len(words), 0
                if found is not None and len(found):
                    gone = covered([r["lo"] for r in found], [r["hi"] for r in found], window, n)
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                row = (None if pd.isna(doc) else int(doc), n, removed, hashlib.sha256(kept).hexdigest())
                out.append(row + (kept.decode("utf-8"),) if with_text else row)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})

    joined = with_ranges(docs, keys, ranges).select("doc_id", data.alias("data"), "_ranges")
    return joined.mapInPandas(left, schema)
