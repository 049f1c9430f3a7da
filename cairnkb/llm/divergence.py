"""How far each source's wording lies from its language's and from the other sources', in exact integers.

Terms are counted by language and source. Two sources are compared over all kept terms, of
which most occur in neither: such a term gives what two counts of zero give, the baseline. So
the sum is the baseline for every term, and corrections where one or both have the term. They
are made cell by cell, a cell being some terms of a language and two blocks of its sources,
and only sums leave a cell.

The largest terms of each group are found by radix select: histograms over the bits of the
values, from the top, narrow each group's k-th value down; ties at it are narrowed by
histograms over the bytes of the terms. What is at last ranked is a bounded number of rows a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import save, scratch

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Bits and bytes that a histogram of the selection goes by (65,536 bins a group at most).
BITS, BYTES = 16, 2
#: Rows of a bin that are ranked as they are.
FEW_ROWS = 2048
#: Terms of a cell, and sources of a block of them: 8 MB a matrix.
CELL_TERMS, CELL_SOURCES = 4096, 256
#: Groups that are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 1_000_000
#: Terms that a task counts before it sends them on.
TASK_TERMS = 400_000
_SPACED = bytes(ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)) + bytes(range(128, 256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8: runs of A-Z, a-z and what is beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_SPACED).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, n_docs)``: occurrences and documents of each term, nulls read as ''.

    Each text is taken apart once, and a task sends on the counts of many texts at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def out() -> pa.RecordBatch:
            sizes = [len(every) for every, _ in held.values()]
            found = pa.array(chain.from_iterable(every for every, _ in held.values()), pa.binary()).cast(pa.string())
            n = pa.array(chain.from_iterable(every.values() for every, _ in held.values()), pa.int64())
            n_docs = pa.array(chain.from_iterable(map(in_docs.__getitem__, every) for every, in_docs in held.values()), pa.int64())
            lang, source = (pa.array(chain.from_iterable([key[i]] * size for key, size in zip(held, sizes, strict=True)), pa.string()) for i in (0, 1))
            held.clear()
            return pa.RecordBatch.from_arrays([lang, source, found, n, n_docs], ["lang", "source", "term", "n", "n_docs"])

        size = 0
        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                every, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(every)
                found = terms(text)
                every.update(found)
                in_docs.update(set(found))
                size += len(every)
                if size >= TASK_TERMS:
                    yield out()
                    size = 0
        if held:
            yield out()

    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    each = own.mapInArrow(count, "lang string, source string, term string, n long, n_docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _rate(n: str, total: str, size: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * size)) in exact decimals; null without kept terms."""
    return F.expr(f"CASE WHEN {size} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(20, 0))) div CAST({total} + 2 * {size} AS DECIMAL(20, 0)) END")


def _gap(p: str, q: str) -> Column:
    """The divergence of one term: the squared difference by the sum, rounded down."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over a cell's terms for all pairs of its two blocks of sources.

    A row without a term is a source's baseline, which every cell has for all its sources.
    """
    lang, left, right = rows["lang"].iat[0], rows["left"].iat[0], rows["right"].iat[0]
    first = rows["block"].iat[0] == 0
    heads, own = rows[rows["term"].isna()], rows[rows["term"].notna()]
    size = int(heads["size"].iat[0])
    sources = heads["source"].to_numpy(object)
    base = np.where(size > 0, heads["p"].fillna(1).to_numpy(np.int64), 1)
    at = {s: i for i, s in enumerate(sources)}
    codes, found = pd.factorize(own["term"])
    p = np.zeros((len(sources), len(found)), np.int64)
    p[own["source"].map(at).to_numpy(np.int64), codes] = own["p"].to_numpy(np.int64)
    side = heads["side"].to_numpy()
    i_of, j_of = np.flatnonzero(side == left), np.flatnonzero(side == right)
    sums = np.zeros((len(sources), len(sources)), np.int64)  # what a source's own terms add, by the other's baseline
    for g in range(len(sources)):
        mine, n = np.unique(p[g][p[g] > 0], return_counts=True)
        if len(mine):
            sums[g] = (n[:, None] * _gaps(mine[:, None], base[None, :])).sum(0) - n.sum() * _gaps(base[g], base)
    out = []
    for g in i_of:
        others = j_of[j_of > g] if left == right else j_of
        if not len(others):
            continue
        value = sums[g, others] + sums[others, g] + (size * _gaps(base[g], base[others]) if first and size else 0)
        has = np.flatnonzero(p[g] > 0)
        if len(has):
            q, b = p[np.ix_(others, has)], base[others][:, None]
            mine = p[g, has][None, :]
            both = _gaps(mine, np.maximum(q, 1)) - _gaps(mine, b) - _gaps(base[g], np.maximum(q, 1)) + _gaps(base[g], b)
            value = value + np.where(q > 0, both, 0).sum(1)
        out.append((np.full(len(others), g), others, value))
    g, h, value = (np.concatenate(x) for x in zip(*out, strict=True)) if out else np.zeros((3, 0), np.int64)
    both_ways = np.concatenate([g, h]), np.concatenate([h, g])
    return pd.DataFrame({"lang": lang, "source": sources[both_ways[0]], "item": sources[both_ways[1]], "value": np.concatenate([value, value])})


def _pairs(groups: DataFrame, kept: DataFrame, few, cell_terms: int, cell_sources: int) -> DataFrame:
    """``(lang, source, item, value)`` of all ordered pairs of sources of a language."""
    langs = groups.groupBy("lang").agg(F.max("size").alias("lang_size"), F.count("*").alias("n_sources"))
    of = groups.join(few(langs), "lang")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("lang_size") / cell_terms)).cast("int")
    sides = F.ceil(F.col("n_sources") / cell_sources).cast("int")
    side = F.when(sides == 1, 0).otherwise(F.pmod(F.xxhash64("source"), sides)).cast("int")
    of = of.select("lang", "source", "total", "size", blocks.alias("blocks"), sides.alias("sides"), side.alias("side"))
    heads = of.select("lang", "source", "size", "sides", "side", F.lit(None).cast("string").alias("term"), _rate("0", "total", "size").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    own = kept.select("lang", "source", "term", "p").join(few(of), ["lang", "source"])
    own = own.select("lang", "source", "size", "sides", "side", "term", "p", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    rows = heads.unionByName(own).withColumn("other", other)
    rows = rows.select("lang", "source", "size", "side", "term", "p", "block", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"))
    cells = rows.groupBy("lang", "block", "left", "right").applyInPandas(_cell, "lang string, source string, item string, value long")
    return cells.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def radix_top(rows: DataFrame, keys: list[str], value: str, item: str, k: int, n_groups: int | None = None, few_rows: int = FEW_ROWS) -> DataFrame:
    """The k rows of each group of the largest value, ties by the item's UTF-8 bytes, with their ``rank`` from 1.

    ``value`` is a long, 0 or more; a group's items are distinct strings. Histograms narrow a
    group until the bin of its k-th row has ``few_rows`` at most; what is then left, a bounded
    number of rows a group, is ranked. Fewer than k rows stay all. ``rows`` is read several
    times, so it should be a written table. ``n_groups`` is the number of groups, if known;
    state of more than BROADCAST_GROUPS groups is not broadcast.
    """
    held = Window.partitionBy(*keys)
    ranked = F.row_number().over(held.orderBy(F.desc(value), item)).cast("int")
    top = rows.agg(F.max(value)).first()[0]
    if top is None:
        return rows.withColumn("rank", ranked)
    groups = rows.select(*keys).distinct().count() if n_groups is None else n_groups
    few = F.broadcast if groups <= BROADCAST_GROUPS else lambda x: x

    def narrow(bins: DataFrame, order: Column, name: str) -> DataFrame:
        """``(keys, prefix, need, closed)``: each group's bin that holds its need-th row, how many are needed of it, and whether it is small."""
        above = F.coalesce(F.sum("n").over(held.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = bins.withColumn("above", above).filter("above < need and above + n >= need")
        return save(found.select(*keys, "prefix", (F.col("need") - F.col("above")).alias("need"), (F.col("n") <= few_rows).alias("closed")), name)

    shift = max(0, -(-max(1, int(top).bit_length()) // BITS) * BITS - BITS)
    bins = rows.groupBy(*keys, F.shiftright(F.col(value), shift).alias("prefix")).agg(F.count("*").alias("n")).withColumn("need", F.lit(k).cast("long"))
    state = narrow(bins, F.desc("prefix"), "bins")
    least = lambda: state.select(*keys, F.shiftleft("prefix", shift).alias("least"))
    floors, still = least(), not state.filter("not closed").isEmpty()
    done = state.filter("closed").select(*keys, F.shiftleft("prefix", shift).alias("least"))
    while still and shift > 0:
        within = rows.join(few(state.filter("not closed")), keys).filter(F.shiftright(F.col(value), shift) == F.col("prefix"))
        shift -= BITS
        bins = within.groupBy(*keys, "need", F.shiftright(F.col(value), shift).alias("prefix")).agg(F.count("*").alias("n"))
        state = narrow(bins, F.desc("prefix"), "bins")
        floors, still = done.unionByName(least()), not state.filter("not closed").isEmpty()
        done = done.unionByName(state.filter("closed").select(*keys, F.shiftleft("prefix", shift).alias("least")))
    if not still:
        found = rows.join(few(floors), keys, "left").filter(F.col("least").isNull() | (F.col(value) >= F.col("least"))).select(*rows.columns)
        return found.withColumn("rank", ranked).filter(F.col("rank") <= k)

    # more rows of one value than are ranked at once: by the bytes of the item, from where a group's open ones first differ
    tied = state.filter("not closed").select(*keys, F.col("prefix").alias("kth"), F.col("need").alias("left"))
    met = rows.join(few(floors), keys, "left").join(few(tied), keys, "left")
    clear = F.col("least").isNull() | (F.col(value) > F.col("least")) | (F.col("kth").isNull() & (F.col(value) == F.col("least")))
    found = met.filter(clear).select(*rows.columns)
    ties = save(met.filter(F.col("kth").isNotNull() & (F.col(value) == F.col("kth"))).select(*rows.columns, F.col(item).cast("binary").alias("_bytes"), F.col("left").alias("need")), "ties")
    while not ties.isEmpty():
        ends = ties.groupBy(*keys).agg(F.min("_bytes").alias("least"), F.max("_bytes").alias("most"))
        agree = lambda m, i: (m == i - 1) & (F.substring("least", i, F.lit(1)) == F.substring("most", i, F.lit(1)))
        same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("least"))), F.lit(0), lambda m, i: F.when(agree(m, i), i).otherwise(m))
        skip = ends.select(*keys, F.least(same, F.length("least")).alias("skip"))
        # an item that ends here comes before those that go on: its key is a prefix of theirs
        keyed = save(ties.join(few(skip), keys).withColumn("prefix", F.substring("_bytes", F.col("skip") + 1, F.lit(BYTES))).drop("skip"), "tied")
        bins = keyed.groupBy(*keys, "need", "prefix").agg(F.count("*").alias("n"))
        state = narrow(bins, F.asc("prefix"), "bins").withColumnsRenamed({"prefix": "last", "need": "left"})
        both = keyed.join(few(state), keys)
        found = found.unionByName(both.filter((F.col("prefix") < F.col("last")) | (F.col("closed") & (F.col("prefix") == F.col("last")))).select(*rows.columns))
        ties = save(both.filter(~F.col("closed") & (F.col("prefix") == F.col("last"))).select(*rows.columns, "_bytes", F.col("left").alias("need")), "ties")
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k)


def divergence(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS, cell_terms: int = CELL_TERMS, cell_sources: int = CELL_SOURCES) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source against the others of its language, and its marked terms.

    A language keeps the terms in ``least_docs`` of its documents at least. In part ``pair``
    an item is another source of the language and the value the divergence over all kept
    terms, every rank; in ``term`` it is a term more frequent in the group than in the
    language, the ``top`` ranks. Ranks go by value downwards, then by the item's bytes. Null
    text, lang and source are read as ''; a group without terms (an empty or null text, or
    none kept) has pairs and no marked terms; a language of one source has no pairs; repeated
    rows count each; other columns are not read, and an empty table gives no rows.
    """
    ship(docs.sparkSession)
    with scratch() as keep:
        counts = save(term_counts(docs), "term_counts")
        in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("docs")).filter(F.col("docs") >= least_docs)
        in_lang = save(in_lang, "terms_of_languages")
        shared = save(counts.join(in_lang.select("lang", "term", "n_lang"), ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "kept_terms")
        sizes = in_lang.groupBy("lang").agg(F.count("*").alias("size"), F.sum("n_lang").alias("lang_total"))
        totals = shared.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "size", "lang_total"])
        groups = save(groups, "groups")
        n_groups = groups.count()
        few = F.broadcast if n_groups <= BROADCAST_GROUPS else lambda x: x
        rated = shared.join(few(groups), ["lang", "source"])
        kept = save(rated.select("lang", "source", "term", _rate("n", "total", "size").alias("p"), _rate("n_lang", "lang_total", "size").alias("q")), "rates")
        pairs = _pairs(groups, kept, few, cell_terms, cell_sources)
        marked = save(kept.filter("p > q").select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value")), "marked_terms")
        best = radix_top(marked, ["lang", "source"], "value", "item", top, n_groups)
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank"))
        return keep(save(pairs.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")), "divergence"))
