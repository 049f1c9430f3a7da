"""op10 against all pairs."""

import random
import time

from cairnkb.llm import lines, queries


def near(a, b):
    """Within one edit."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows, least=10):
    """``[(doc_id, kept text, n_lines, n_removed)]``; each doc_id once."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    seen, out = set(), []
    for doc, text in order:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        kept = []
        every = text.split("\n")
        for line in every:
            met = line in seen or len(line) >= least and any(near(line, x) for x in seen if len(x) >= least and abs(len(x) - len(line)) < 2)
            if not line.strip(" \t\n\v\f\r") or not met:
                kept.append(line)
            seen.add(line)
        out.append((doc, "\n".join(kept), len(every), len(every) - len(kept)))
    return sorted(out, key=str)


def test_all_pairs(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choices("abé ", k=n)) for n in (10, 11, 12, 63, 64, 65, 128, 129, 200) for _ in range(3)]

    def edited(line):
        i, c = rng.randrange(len(line)), rng.choice("abé ")
        return rng.choice([line, line[:i] + line[i + 1 :], line[:i] + c + line[i:], line[:i] + c + line[i + 1 :], line[:i] + c + c + line[i:]])

    rows = [(i, "\n".join(edited(rng.choice(pool)) for _ in range(rng.randint(1, 6))) + rng.choice(["", "\n", "\nshort"])) for i in range(60)]
    rows += [(100, None), (101, ""), (None, pool[0] + "\nunlike all other lines"), (102, "\n".join(pool * 20))]
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, line string, n_removed int")
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(docs).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a line of text\nb"), (1, "a line of text\nb"), (2, "a line of texts\nb")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(docs).collect())
    assert got == [(1, "a line of text\nb", 0), (1, "a line of text\nb", 0), (2, "", 2)]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_lose_only_their_own_lines(spark, duck):
    same = "the same long line"
    rows = [(1, same), (None, same + "\nx"), (None, "unique text of its own\ny"), (2, "another text by itself\nz"), (2, same + "\nand what no other has"), (2, same + "\nand what no other has")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(docs).collect()], key=str)
    rest = (2, "and what no other has", 2, 1)
    want = [(1, same, 1, 0), (None, "x", 2, 1), (None, "unique text of its own\ny", 2, 0), (2, "another text by itself\nz", 2, 0), rest, rest]
    assert got == sorted(want, key=str)
    cur = duck.cursor()
    cur.execute("CREATE TEMP TABLE documents (doc_id BIGINT, text VARCHAR)")
    cur.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    by_sql = cur.execute(queries.ORACLE["op10_lines"]).fetchall()
    assert sorted(((d, n, gone) for d, n, gone, _ in by_sql), key=str) == sorted(((d, n, gone) for d, _, n, gone in want), key=str)


def test_short_and_blank_lines(spark):
    docs = spark.createDataFrame([(1, "a\n\nShare\n \t"), (2, "b\n\nShare\nSharE\n \t\na")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()} == {1: "a\n\nShare\n \t", 2: "b\n\nSharE\n \t"}


def test_long_lines_cost_what_they_are_long(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh é", k=1_000_000))
    rows = [(1, long), (2, long[:500_000] + long[500_001:]), (3, long[:70] + "?" + long[71:]), (4, long[:70] + "??" + long[72:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lines.dedup_lines(docs.limit(0)).count()
    began = time.perf_counter()
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1}
    assert time.perf_counter() - began < 60


def test_the_same_line_in_rows_that_share_an_id_or_have_none(spark, duck):
    same = "the same long line here"
    rows = [(None, same + "\nalpha of its own"), (None, same + "\nbeta of its own"), (5, same + "\ngamma and more"), (5, same + "\ndelta and more"), (5, same + "\ndelta and more")]
    for data in (rows, rows[:2], rows[2:], rows[:1] * 2):
        docs = spark.createDataFrame(data, "doc_id long, text string")
        got = [(r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(docs).collect()]
        holders = {(d, t) for d, t, _ in got if same in t}
        assert len(holders) == 1 and sum(x == next(iter(holders)) for x in [(d, t) for d, t, _ in got]) <= 2
        assert not (data == rows and None in {d for d, _ in holders})
        cur = duck.cursor()
        cur.execute("CREATE OR REPLACE TEMP TABLE documents (doc_id BIGINT, text VARCHAR)")
        cur.executemany("INSERT INTO documents VALUES (?, ?)", data)
        by_sql = cur.execute(queries.ORACLE["op10_lines"]).fetchall()
        assert sorted(((d, gone) for d, _, gone, _ in by_sql), key=str) == sorted(((d, gone) for d, _, gone in got), key=str)
