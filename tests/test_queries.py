"""Every registered query of the library against its SQL."""

import pytest
from cairnkb.plans import registry


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(name, matches_sql):
    matches_sql(registry.QUERIES[name], registry.ORACLE[name])


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("name", registry.QUERIES)
def test_no_unchecked_cartesian(name, spark, sf_dir):
    """Cross joins only with a broadcast side."""
    if name.startswith("stream_"):
        pytest.skip("a stream's plan is not kept")
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
