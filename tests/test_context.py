"""Scores in context blocks: halves go by the number's exact value, as in C and Python."""

from cairnkb.operators import context
from pyspark.sql import functions as F


def test_scores_of_half_a_thousandth(spark):
    scores = [n / 10000 for n in range(5, 200_000, 10)] + [0.0625, 0.1875, 123456.7895, 1e-9, 0.0, 2.0]
    rows = spark.createDataFrame([(x,) for x in scores], "score double")
    made = rows.select("score", context.block(F.lit(1), F.lit("t"), F.lit(""), F.lit("x"), F.col("score")).alias("b")).collect()
    assert [r.b for r in made] == [f"[1] t ({r.score:.3f})\nx" for r in made]
    assert any(f"{x:.3f}" != f"{x + 1e-9:.3f}" for x in scores)
