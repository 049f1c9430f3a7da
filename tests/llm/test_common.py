"""What save() writes within scratch() is deleted at its end, unless kept."""

import os

import pytest
from cairnkb.llm import decontaminate, lines, near, secrets, simhash
from cairnkb.llm.common import save, scratch


def where(saved):
    return saved._cairnkb_path.removeprefix("file://")


def test_scratch_keeps_only_what_it_is_told_to(spark):
    with scratch() as keep:
        gone = save(spark.range(3), "gone")
        with scratch() as keep_inner:
            inner = keep_inner(save(gone.filter("id > 0"), "inner"))
        assert os.path.exists(where(inner))
        kept = keep(save(inner.filter("id > 1"), "kept"))
    assert not os.path.exists(where(gone)) and not os.path.exists(where(inner))
    assert [r.id for r in kept.collect()] == [2]


def test_an_error_leaves_the_outer_scope_as_it_was(spark):
    with scratch() as keep:
        with pytest.raises(ValueError):
            with scratch():
                raise ValueError
        table = keep(save(spark.range(2), "table"))
    assert table.count() == 2


@pytest.mark.parametrize("column", ["_k1", "_K2", "_row", "_spans", "_lines", "_doc", "_removed", "_hits", "_j1", "k1", "doc", "first", "label", "sketch", "fp", "removed"])
def test_columns_of_any_name_stay(column, spark):
    """A caller's column comes back with its values, whatever the operators call theirs."""
    texts = ["one long line of some text here", "one long line of some text here", None, "", "password = abcdefghijklmnop\nand what else there is to say in a text of its own"]
    docs = spark.createDataFrame([(i, t, f"v{i}") for i, t in enumerate(texts)], f"doc_id long, text string, `{column}` string")
    bench = spark.createDataFrame([(1, "some words of an item " * 4), (2, "one long line of some text here")], "item_id int, text string")
    made = {
        "lines": lines.dedup_lines(docs), "secrets": secrets.scan(docs), "blocks": decontaminate.contamination(docs, bench, block=1),
        "simhash": simhash.keep_one(docs), "near": near.keep_one(docs),
    }
    for name, out in made.items():
        assert set(docs.columns) <= set(out.columns), name
        rows = [(r["doc_id"], r[column]) for r in out.collect()]
        assert rows and all(v == f"v{i}" for i, v in rows), name
