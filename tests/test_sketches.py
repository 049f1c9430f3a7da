"""Sketches are kept by group, not by each member of a group."""

import re

from cairnkb.plans import accounts


def test_no_sketch_for_each_user(spark, sf_dir):
    plan = accounts.approximate_users(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString() + accounts.approximate_users(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    sketched = re.findall(r"HashAggregate\(keys=\[([^\]]*)\][^\n]*approx_count_distinct", plan)
    assert sketched and all("user_id" not in keys for keys in sketched)
