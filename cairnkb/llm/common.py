"""Helpers the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_scratch: list[tuple[SparkSession, str]] = []
_within: ContextVar[list[DataFrame] | None] = ContextVar("within", default=None)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A temporary one only where Spark is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairnkb-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a reread and not a recomputation, and
    fixes rows whose order or partition later steps rely on.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _scratch.append((spark, path))
    saved = spark.read.schema(df.schema).parquet(path)
    saved._cairnkb_path = path
    if _within.get() is not None:
        _within.get().append(saved)
    return saved


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what ``save`` wrote within it, but for the tables given to the function it yields.

    What is left must not read the deleted ones: keep each table that a later step still reads.
    """
    outer, kept = _within.get(), []
    token = _within.set([])

    def keep(saved: DataFrame) -> DataFrame:
        kept.append(saved._cairnkb_path)
        return saved

    try:
        yield keep
    finally:
        mine = _within.get()
        _within.reset(token)
    for saved in mine:
        if saved._cairnkb_path not in kept:
            drop(saved)
        elif outer is not None:
            outer.append(saved)


def drop(saved: DataFrame) -> None:
    """Delete a table that ``save`` returned and that nothing will read again."""
    _delete(saved.sparkSession, saved._cairnkb_path)
    _scratch[:] = [x for x in _scratch if x[1] != saved._cairnkb_path]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean() -> None:
    """Delete what ``save`` has written; call it once results that read it are written."""
    while _scratch:
        try:
            _delete(*_scratch.pop())
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


atexit.register(clean)


def broadcast(df: DataFrame, value):
    """A broadcast of plain Python data (its size bounded by the caller), with this package on the executors."""
    ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(value)


def matrix(vectors: pd.Series, kind: type, size: int) -> np.ndarray:
    """A row for each of the vectors, which are bytes of ``size`` numbers of a kind."""
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), size)


def text_key() -> list:
    """Two independent 64-bit hashes: rows of one key hold the same text (a null text is keyed as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("k2"), text, F.length(text)).alias("k2")]


def fresh(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each behind as many underscores as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return tuple(found)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df
