"""Multilingual mixture inference: expectation-maximisation over n-gram likelihoods.

A text is taken as a mixture of the learned languages. EM estimates the mixture's proportions
from the likelihoods of the text's byte trigrams; languages enter by descending proportion
while twice the gain in log-likelihood exceeds the penalty of one more parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import broadcast

BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 25
#: A byte takes part in three trigrams, so log-likelihoods count a third.
OVERLAP = 3
#: The model takes BUCKETS floats a language on each executor; more languages are refused, not dropped.
MAX_LANGUAGES = 200
UNKNOWN = "und"

RESULT = "lang_pred string, score double, languages string, rejected boolean"

_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_CHUNK = 1 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def prepared(text: str | None) -> bytes:
    """Lower-case UTF-8 with everything ASCII that is no letter as a blank."""
    return b" " + (text or "").lower().encode("utf-8", "replace").translate(_LETTERS) + b" "


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(x.isalpha() for x in text[:64]) or any(x.isalpha() for x in text))


def trigrams(data: bytes) -> np.ndarray:
    """Bucket counts of the byte trigrams with at most one blank."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), _CHUNK):
        b = np.frombuffer(data[at : at + _CHUNK + 2], np.uint8).astype(np.uint32)
        if len(b) > 2:
            blank = (b == 32).astype(np.uint8)
            code = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)
            total += np.bincount(code[blank[:-2] + blank[1:-1] + blank[2:] < 2], minlength=BUCKETS)
    return total


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of the training rows, sorted, and log-probabilities ``[language, bucket]``.

    All rows of ``docs(doc_id, text, lang)`` train that have text and a language and are not
    held out. Each task sums its own counts, so at most BUCKETS rows a language leave it.
    """
    ship(docs.sparkSession)
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held, size = [], 0
                for text in texts:
                    held.append(prepared(text))
                    size += len(held[-1])
                    if size >= _CHUNK:
                        total += trigrams(b" ".join(held))
                        held, size = [], 0
                total += trigrams(b" ".join(held))
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            if not len(at):
                at = np.array([0])  # a language without letters is still a language
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    counts = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names: dict[str, int] = {}
    found: list[np.ndarray] = []
    for r in counts.toLocalIterator():  # bounded by MAX_LANGUAGES x BUCKETS
        if r.lang not in names:
            if len(names) == MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages in the training rows")
            names[r.lang] = len(found)
            found.append(np.zeros(BUCKETS))
        found[names[r.lang]][r.bucket] = r.n
    order = sorted(names)
    if not order:
        return [], np.zeros((0, BUCKETS), np.float32)
    table = np.array([found[names[x]] for x in order]) + SMOOTHING
    return order, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def mixture(likelihood: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by EM, and the mixture's log-likelihood; ``likelihood[n-gram, language]``."""
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    total = counts.sum()
    for _ in range(ROUNDS):
        joint = likelihood * share
        new = (counts / joint.sum(1)) @ joint / total
        if np.abs(new - share).max() < 1e-3:
            share = new
            break
        share = new
    return share, float(counts @ np.log(likelihood @ share))


def infer(counts: np.ndarray, logs: np.ndarray) -> list[tuple[int, float]]:
    """The selected languages and their proportions, largest first; empty without n-grams."""
    at = np.flatnonzero(counts)
    if not len(at):
        return []
    c = counts[at].astype(float)
    log = logs[:, at].T.astype(float)
    top = log.max(1, keepdims=True)
    likelihood = np.exp(log - top)
    single = c @ (log - top)
    best = int(single.argmax())
    chosen, value = [(best, 1.0)], float(single[best])
    if logs.shape[0] == 1:
        return chosen
    penalty = np.log(max(2.0, c.sum() / OVERLAP))
    share, full = mixture(likelihood, c)
    order = np.argsort(-share, kind="stable")
    if 2 * (full - value) / OVERLAP <= penalty:
        return [(best, float(share[best]))] if share.argmax() == best else chosen
    for k in range(2, len(order) + 1):
        part, ll = (share[order], full) if k == len(order) else mixture(likelihood[:, order[:k]], c)
        if 2 * (ll - value) / OVERLAP <= penalty:
            break
        chosen, value = sorted(zip(order[:k].tolist(), part.tolist(), strict=True), key=lambda x: (-x[1], x[0])), ll
    return chosen


def trained(logs: np.ndarray) -> np.ndarray:
    """Whether a language has learned more n-grams than smoothing adds to it."""
    return BUCKETS * np.exp(logs.min(1)) < 0.5


def explained(counts: np.ndarray, logs: np.ndarray, found: list[tuple[int, float]]) -> bool:
    """Whether the mixture ``found`` explains the n-grams better, by the penalty, than equal chances for all buckets."""
    at = np.flatnonzero(counts)
    if not len(at):
        return False
    c = counts[at].astype(float)
    which, share = [i for i, _ in found], np.array([p for _, p in found])
    log = logs[which][:, at].T.astype(float)
    top = log.max(1, keepdims=True)
    value = c @ (np.log(np.exp(log - top) @ (share / share.sum())) + top[:, 0])
    return 2 * (value + c.sum() * np.log(BUCKETS)) / OVERLAP > np.log(max(2.0, c.sum() / OVERLAP))


def with_language(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with a struct column ``language`` (RESULT), predicted from the text alone.

    lang_pred is the language of the largest proportion in the selected set, score that
    proportion, languages the whole set. A null text, or one without a letter, is ``und``
    with score 0; so is every text if nothing could be learned. Letters outside all learned
    n-grams fall back on smoothing. rejected says that a text has no letter, or that the
    selected set explains it no better than chance; a language that has learned fewer n-grams
    than smoothing adds rejects nothing, nor does an empty model. ``labelled`` (default: ``docs``) has the training rows.
    """
    names, logs = train(docs if labelled is None else labelled)
    model = broadcast(docs, (names, logs))

    @F.pandas_udf(RESULT)
    def predict(text: pd.Series) -> pd.DataFrame:
        names, logs = model.value
        able = trained(logs) if names else []
        out = []
        for x in text:
            lettered = x is not None and has_letter(x)
            if not names or not lettered:
                out.append((UNKNOWN, 0.0, "", not lettered))
                continue
            counts = trigrams(prepared(x))
            found = infer(counts, logs) or [(0, 1 / len(names))]
            rejected = bool(able[found[0][0]]) and not explained(counts, logs, found)
            out.append((names[found[0][0]], min(1.0, max(0.0, found[0][1])), ",".join(f"{names[i]}:{p:.3f}" for i, p in found), rejected))
        return pd.DataFrame(out, columns=["lang_pred", "score", "languages", "rejected"])

    return docs.withColumn("language", predict("text"))
