"""op8: every id in one piece, sequences full; the bitset program against trying everything."""

import itertools
import random
import zlib

import numpy as np
import pytest
from cairnkb.llm import packing, queries
from tokenizers import Tokenizer


def check(pieces, docs, capacity):
    """Rows of ``pieces`` against the tokenizer; returns the padding."""
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((str(d), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t in docs)
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for doc, ids in want:
        rows = by_doc[doc, len(ids)]
        covered = 0
        for r in rows:
            raw = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            covered += r.length
            if len(rows) == len({x.start for x in rows}):
                assert zlib.crc32(raw) == r.ids_crc32
        total += len(ids)
        assert covered % len(ids) == 0
    assert sum(r.length for r in pieces) == total
    padding = 0
    for rows in by_sequence.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / total


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in queries.documents(spark, sf_dir, "doc_id", "text").collect()]
    assert check(queries.op8_packing(spark, sf_dir).collect(), docs, packing.CAPACITY) < 0.001


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "<|endoftext|> a"), (None, "no id"), (4, "word " * 30_000), (5, "Ünïcödé İstanbul 日本 ½ it's"), (5, "Ünïcödé İstanbul 日本 ½ it's"), (6, "a b\x1c\x85c")]
    table = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, part int")
    check(packing.pack(table, queries.tokenizer_path(), 64).collect(), docs, 64)
    assert packing.pack(table.limit(0), queries.tokenizer_path()).count() == 0


def test_encoder_is_the_tokenizer():
    encoder, tokenizer = packing.Encoder(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(1)
    marks = list("abzAZ09 .,!?'\"-_\n\téßµİı½²ɏɐ ’") + ["'s", "'RE", "<|", "it's", "ab", "DJ"]
    for _ in range(3000):
        text = "".join(rng.choices(marks, k=rng.randint(0, 12)))
        assert encoder.ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text


@pytest.mark.parametrize("seed", range(5))
def test_fill_is_closest(seed):
    rng = random.Random(seed)
    sizes = sorted(rng.sample(range(1, 30), 4), reverse=True)
    counts = [rng.randint(1, 3) for _ in sizes]
    best = max(s for c in itertools.product(*[range(n + 1) for n in counts]) if (s := sum(a * b for a, b in zip(c, sizes, strict=True))) <= 40)
    chosen = dict(packing.fill(40, sizes, counts))
    assert sum(k * n for k, n in chosen.items()) == best
    assert all(n <= counts[sizes.index(k)] for k, n in chosen.items())
