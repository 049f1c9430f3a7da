"""A Spark session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _cell(v) -> str:
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, (bool, int, float)):
        return str(v) if isinstance(v, int) and abs(v) >= 2**31 else f"{float(v):.9g}"
    return str(v)


def plain(df: pd.DataFrame) -> list[tuple[str, ...]]:
    """Sorted rows as text, columns by name."""
    return sorted(zip(*[[_cell(v) for v in df[c]] for c in sorted(df.columns)], strict=True))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def matches_sql(spark, duck):
    def check(query, sql: str) -> None:
        got, want = query(spark, DATA).toPandas(), duck.execute(sql).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)

    return check
