"""Queries over what the library keeps: a vector store, a lexical index, cells of vectors; each is written and then read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, lexical
from ..session import shared
from ..sources.tables import KeyedTable
from . import search


def vector_store(spark, sf_dir):
    """All vectors put in; every tenth replaced by its opposite, every eleventh deleted; every seventh asked for by id."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").filter("vec_id is not null")
    store = KeyedTable(spark, shared(spark, "vectors"), ["vec_id"], 16)
    store.upsert(rows)
    store.upsert(rows.filter("vec_id % 10 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    store.delete(rows.filter("vec_id % 11 = 0"))
    n = store.read().agg(F.count("*").alias("n_stored"))
    found = store.get(rows.filter("vec_id % 7 = 0"))
    return found.crossJoin(F.broadcast(n)).select("vec_id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_component"), "n_stored")


def indexed_bm25(spark, sf_dir):
    """``bm25_topk`` through a persisted index."""
    path = shared(spark, "lexical")
    lexical.build(search.documents(spark, sf_dir), path)
    return lexical.search(spark, path, search.questions(spark, sf_dir))[0]


def indexed_dense(spark, sf_dir):
    """``dense_topk`` through persisted cells."""
    path = shared(spark, "cells")
    cells.build(search.vectors(spark, sf_dir), path)
    return cells.search(spark, path, search._asked_vectors(spark, sf_dir))[0]


ORACLE = {
    "vector_store": """WITH s AS (SELECT vec_id, label, CASE WHEN vec_id % 10 = 0 THEN -embedding[1] ELSE embedding[1] END AS x FROM embeddings WHERE vec_id IS NOT NULL AND vec_id % 11 <> 0)
SELECT vec_id, label, round(CAST(x AS DOUBLE), 6) AS first_component, (SELECT count(*) FROM s) AS n_stored FROM s WHERE vec_id % 7 = 0""",
    "indexed_bm25": search.ORACLE["bm25_topk"],
    "indexed_dense": search.ORACLE["dense_topk"],
}
QUERIES = {name: globals()[name] for name in ORACLE}
