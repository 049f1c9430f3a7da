"""Tables kept by key: in buckets by a hash of the key, changed by rewriting the buckets that a change touches.

A version is a list of the folder that holds each bucket. A change writes new folders and then
a new list; readers take the last list that is whole, and so see a change entire or not at
all. A batch that a version already has is not applied again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET = "_bucket"
_LIST = "version LONG, batches MAP<STRING, LONG>, schema STRING, entries ARRAY<STRUCT<bucket: INT, folder: STRING>>"


class KeyedTable:
    """Rows below ``root``, one for each value of the columns ``key``.

    ``buckets`` is fixed when the table is first written: some 100 MB a bucket is a good size.
    The driver holds the list of buckets and nothing else. One writer at a time: of two that
    write the same version, the later fails.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    # what is there

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions whose lists are whole, in order."""
        where, files = self._folder(f"{self.root}/versions")
        if not files.exists(where):
            return []
        names = [x.getPath() for x in files.listStatus(where)]
        success = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(x.getName()[1:]) for x in names if files.exists(success(x, "_SUCCESS")))

    def _listed(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"version": 0, "batches": {}, "schema": None, "folders": {}}
        at = found[-1] if version is None else version
        row = self.spark.read.schema(_LIST).json(f"{self.root}/versions/v{at:09d}").first()
        return {"version": at, "batches": dict(row.batches or {}), "schema": row.schema, "folders": {x.bucket: x.folder for x in row.entries}}

    def _rows(self, listed: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in sorted(listed["folders"].items()) if buckets is None or b in buckets]
        if listed["schema"] is None:
            raise ValueError(f"nothing has been written to {self.root}")
        rows = self.spark.read.schema(listed["schema"])
        return rows.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], listed["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of the last version or of one still kept."""
        return self._rows(self._listed(version))

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys; only their buckets are read. Keys that are not there have no row."""
        asked = keys.select(*self.key)
        return self._rows(self._listed(), self._touched(asked)).join(asked.distinct(), self.key, "left_semi")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.key]), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    # changes

    def upsert(self, rows: DataFrame, latest: str | None = None, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, writer: str = "", batch: int | None = None) -> bool:
        """Put ``rows`` in; False if this writer's ``batch``, or a later one, was put in before.

        A row replaces that of its key, or with ``latest`` only one whose value in that column
        is not greater. Of several rows of a key the one of the greatest ``latest`` stays, else
        one of them by a hash of the whole row. ``merge(old, new)`` makes the rows of the
        touched buckets otherwise, such as by adding them up; it must keep keys apart.
        """

        def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
            columns = new.columns
            at = F.col(latest) if latest else F.lit(0)
            both = old.select(*columns, F.lit(0).alias("_new")).unionByName(new.select("*", F.lit(1).alias("_new")))
            order = F.struct(at.alias("at"), "_new", F.xxhash64(*[F.col(c) for c in columns]).alias("tie"))
            best = both.groupBy(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(self.key)]).agg(F.max_by(F.struct(*columns), order).alias("row"))
            return best.select("row.*")

        return self._change(rows, merge or replaced, writer, batch)

    def delete(self, keys: DataFrame, writer: str = "", batch: int | None = None) -> bool:
        return self._change(keys.select(*self.key), lambda old, gone: old.join(gone, self.key, "left_anti"), writer, batch)

    def _change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], writer: str, batch: int | None) -> bool:
        listed = self._listed()
        if batch is not None and listed["batches"].get(writer, -1) >= batch:
            return False
        if listed["schema"] is None:
            listed["schema"] = _ddl(rows)
        rows = rows.persist()
        try:
            touched = self._touched(rows)
            version = listed["version"] + 1
            out = merge(self._rows(listed, touched), rows)
            folder = f"data/v{version:09d}"
            names = [x.name for x in self.spark.createDataFrame([], listed["schema"]).schema]
            out.select(*names, self.bucket().alias(_BUCKET)).repartition(max(1, len(touched)), _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.root}/{folder}")
        finally:
            rows.unpersist()
        where, files = self._folder(f"{self.root}/{folder}")
        made = {int(x.getPath().getName().split("=")[1]) for x in files.listStatus(where) if "=" in x.getPath().getName()}
        folders = {b: f for b, f in listed["folders"].items() if b not in touched} | {b: f"{folder}/{_BUCKET}={b}" for b in made}
        batches = listed["batches"] | ({writer: batch} if batch is not None else {})
        row = [(version, batches, listed["schema"], sorted(folders.items()))]
        self.spark.createDataFrame(row, _LIST).coalesce(1).write.mode("errorifexists").json(f"{self.root}/versions/v{version:09d}")
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions, and the folders that only those held; how many folders went."""
        found = self.versions()
        old, kept = found[: -keep], found[-keep:]
        held = {f for v in kept for f in self._listed(v)["folders"].values()}
        gone = {f for v in old for f in self._listed(v)["folders"].values()} - held
        for path in [*(f"versions/v{v:09d}" for v in old), *gone]:
            where, files = self._folder(f"{self.root}/{path}")
            files.delete(where, True)
        return len(gone)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)
