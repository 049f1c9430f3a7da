"""op4 against Python's re, and its index."""

import random
import re
import time

from cairnkb.llm import secrets
from pyspark.sql import functions as F

PATTERNS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def want(text):
    spans = [(m.start(), rank, kind, m.end()) for rank, (kind, p, g, least) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def test_spans(spark):
    rng = random.Random(4)
    bits = ["password=", "ToKeN : ", "api_key='", "APIKEY\"=", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", " ", "\n", "é😀", "x", "secretsecret=", "=", "passwd"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(300)] + [None, "", "x" * 200_000 + "password=abcdefghijkl", "token=short"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x"), (None, "secret=abcdefghijklm", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    got = [(r.doc_id, r.spans) for r in secrets.report(docs).collect()]
    assert sorted(got, key=str) == sorted([(d, want(t)) for d, t, _ in rows], key=str)
    assert secrets.scan(docs).columns == [*docs.columns, "secrets"]
    assert secrets.report(docs.limit(0)).count() == 0


def test_index(spark):
    assert secrets.trigram_query(secrets.RULES[2]) is None
    assert secrets.trigram_query(secrets.RULES[1]) == [["aki", "kia"]]
    docs = spark.createDataFrame([("TOKEN",), ("to ken",), ("AkIa",), (None,)], "text string")
    assert secrets.mandatory(secrets.RULES[0].pattern) == ("api_key", "apikey", "passwd", "password", "secret", "token")
    assert secrets.mandatory("(?:ab|cd)+x{3}y?[a-z]*needle-[0-9]+") == ("needle-",)
    assert secrets.mandatory("ab?c|[a-z]+") == ()
    found = secrets.candidates(secrets.postings(docs)).select(F.array_join("kinds", ",").alias("k")).collect()
    assert sorted(r.k for r in found) == ["access", "assign"]


def test_rules_of_ones_own(spark):
    rules = (secrets.Rule("key", "(?i)(?:live|test)_key_([0-9]+)", 1, 3), secrets.Rule("pin", "#[0-9]{4}", 0, 5))
    docs = spark.createDataFrame([("a LIVE_key_123 #1234 test_key_12",), ("#99",), (None,)], "text string")
    got = [[(x.kind, x.start, x.stop) for x in r.secrets] for r in secrets.scan(docs, rules).collect()]
    assert sorted(got) == [[], [], [("key", 2, 14), ("pin", 15, 20)]]


def test_many_spans_in_one_text(spark):
    text = "0123456789abcdef é " * 100_000
    began = time.perf_counter()
    r = secrets.scan(spark.createDataFrame([(text,)], "text string")).first()
    assert len(r.secrets) == 100_000 and (r.secrets[-1].start, r.secrets[-1].stop) == (len(text) - 19, len(text) - 3)
    assert time.perf_counter() - began < 60
