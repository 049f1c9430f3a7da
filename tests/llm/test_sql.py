"""The operators that SQL can express, against their SQL; and that native ones run no Python."""

import pytest
from cairnkb.llm import common, lines, queries, secrets


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query(name, matches_sql):
    matches_sql(queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", ["op4_secrets", "op10_lines"])
def test_native(name, spark, sf_dir, monkeypatch):
    """Also what is written on the way."""
    plans, save = [], common.save

    def kept(df, title):
        plans.append(df._jdf.queryExecution().toString())
        return save(df, title)

    monkeypatch.setattr(lines, "save", kept)
    monkeypatch.setattr(secrets, "save", kept)
    plans.append(queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString())
    assert len(plans) > 1
    assert not any(x in plan for plan in plans for x in ("Python", "Pandas", "Arrow"))
