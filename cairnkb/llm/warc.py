"""WARC records and the fixity audit of their replicas by Merkle trees.

A replica is a table of records ``(archive, seq, sha256, start, stop)``, the bytes from start
to stop of its archive. Leaves are the records' hashes in order of offset; a node hashes the
``FANOUT`` nodes below it and covers their range of offsets, so no group is larger than that.
Beside the hash of its contents a node has one of its ordered offset ranges: a record that has
lost bytes moves all after it, whose contents are sound. Two replicas are compared at their
roots, by either hash, then only below nodes that differ, level by level, down to the records
at fault or moved, and their ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import save

FANOUT = 16
ARCHIVE = 1000


def record(url: Column, body: Column) -> Column:
    """A WARC/1.0 resource record, as bytes; nulls are empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def parse_warc(data: bytes) -> Iterator[tuple[int, int, str | None, bytes | None, str | None]]:
    """``(offset, length, url, body, problem)`` of each record, and of each stretch that is none.

    After a damaged record reading goes on at the next line that begins with ``WARC/``.
    """
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        fields = dict(x.split(b":", 1) for x in data[at : max(end, at)].split(b"\r\n")[1:] if b":" in x)
        fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
        size = fields.get(b"content-length", b"")
        stop = end + 4 + int(size) if size.isdigit() else -1
        if not data.startswith(b"WARC/", at):
            problem = "no record begins here"
        elif end < 0:
            problem = "the header does not end"
        elif stop < 0:
            problem = "no length"
        elif stop > len(data):
            problem = "cut short"
        elif data[stop : stop + 4] != b"\r\n\r\n":
            problem = "no end where the length says"
        else:
            yield at, stop + 4 - at, fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), data[end + 4 : stop], None
            at = stop + 4
            continue
        after = data.find(b"\nWARC/", at)
        after = len(data) if after < 0 else after + 1
        yield at, after - at, None, None, problem
        at = after


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(path, offset, length, url, body, problem)`` of the records of uncompressed WARC files, by any path Spark reads.

    A damaged stretch is a row with its ``problem`` and without url and body. A file is held
    in memory by one task, 2 GB at most.
    """
    ship(spark)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                out = []
                for offset, length, url, body, problem in parse_warc(bytes(data)):
                    out.append((name, offset, length, url, None if body is None else body.decode("utf-8", "replace"), problem))
                    if len(out) >= 1000:
                        yield pd.DataFrame(out, columns=["path", "offset", "length", "url", "body", "problem"])
                        out = []
                yield pd.DataFrame(out, columns=["path", "offset", "length", "url", "body", "problem"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, offset long, length long, url string, body string, problem string")


def numbered(records: DataFrame, order: list[str], archive: int = ARCHIVE) -> DataFrame:
    """``records`` with ``archive`` and ``seq``, the place in it: ``archive`` records each, in the given order.

    Rows are range-partitioned by ``order`` and a number of their own, so ties are spread
    too, and counted within their partitions; the counts before a partition are added. Rows
    tied in all of ``order`` must be alike, or may swap places.
    """
    tie = "_tie"
    rows = records.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie)
    rows = save(rows.sortWithinPartitions(*order, tie).withColumn("_part", F.spark_partition_id()), "ordered")
    within = Window.partitionBy("_part").orderBy(*order, tie)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(within) - 1 + F.col("_before")
    rows = rows.join(counts, "_part").withColumn("_rank", rank)
    return rows.withColumns({"archive": F.floor(F.col("_rank") / archive).cast("long"), "seq": (F.col("_rank") % archive).cast("long")}).drop(tie, "_part", "_before", "_rank")


def levels(size: int = ARCHIVE, fanout: int = FANOUT) -> int:
    """Levels above the leaves until one node holds ``size`` leaves."""
    n = 0
    while size > fanout**n:
        n += 1
    return max(1, n)


def tree(leaves: DataFrame, height: int, fanout: int = FANOUT) -> DataFrame:
    """``(archive, level, node, hash, ranges, start, stop)`` of all nodes over ``leaves(archive, seq, sha256, start, stop)``; level 0 are the leaves.

    ``hash`` goes by the contents and ``ranges`` by the offsets of what is below, in order.
    """
    own = F.sha2(F.concat_ws("-", F.col("start").cast("string"), F.col("stop").cast("string")), 256)
    below = leaves.select("archive", F.col("seq").alias("node"), F.col("sha256").alias("hash"), own.alias("ranges"), "start", "stop")
    out = below.withColumn("level", F.lit(0))
    for level in range(1, height + 1):
        grouped = below.groupBy("archive", F.floor(F.col("node") / fanout).cast("long").alias("node"))
        children = F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), "hash", "ranges")))
        of = lambda name: F.sha2(F.array_join(F.transform(F.col("children"), lambda x: x[name]), ""), 256).alias(name)  # noqa: B023, E731
        below = grouped.agg(children.alias("children"), F.min("start").alias("start"), F.max("stop").alias("stop")).select("archive", "node", of("hash"), of("ranges"), "start", "stop")
        out = out.unionByName(below.withColumn("level", F.lit(level)))
    return out


def audit(one: DataFrame, other: DataFrame, height: int, fanout: int = FANOUT, by: str = "hash") -> DataFrame:
    """``(archive, seq, sha256, other_sha256, start, stop)``: the records of two replicas that differ, or that one of them lacks.

    ``one`` and ``other`` are trees, written. Starts with the roots that differ ``by`` their
    ``hash``, or by ``ranges`` for records whose offsets do; each level joins the children of
    differing nodes only. Offsets are the first replica's, where it has the record.
    """

    def differing(level: int, within: DataFrame | None) -> DataFrame:
        left, right = (x.filter(F.col("level") == level).select("archive", "node", "hash", F.col(by).alias("by"), "start", "stop") for x in (one, other))
        if within is not None:
            left, right = (
                x.withColumn("parent", F.floor(F.col("node") / fanout).cast("long")).join(within, ["archive", "parent"], "left_semi").drop("parent")
                for x in (left, right)
            )
        right = right.withColumnsRenamed({"hash": "other", "by": "other_by", "start": "other_start", "stop": "other_stop"})
        joined = left.join(right, ["archive", "node"], "full")
        return joined.filter(~F.col("by").eqNullSafe(F.col("other_by")))

    bad = differing(height, None)
    for level in range(height - 1, -1, -1):
        bad = differing(level, bad.select("archive", F.col("node").alias("parent")))
    return bad.select(
        "archive", F.col("node").alias("seq"), F.col("hash").alias("sha256"), F.col("other").alias("other_sha256"),
        F.coalesce("start", "other_start").alias("start"), F.coalesce("stop", "other_stop").alias("stop"),
    )


def fixity_report(replica: DataFrame) -> DataFrame:
    """A row for each archive: records, bytes, both roots, in order of place the page ids at fault
    and the byte ranges where the first replica has them; both roots of the offset ranges, and
    how many records the second replica has elsewhere.

    ``replica`` has ``(page_id, url, html, rotten)``; ``rotten`` is the page as the second
    replica has it. Records are ordered by page_id (nulls first), url and
    hash and put into archives of 1000 in that order. Nulls in url or html are empty; repeated
    rows are records each; no rows give no archives.
    """
    raw = record(F.col("url"), F.col("html"))
    leaves = replica.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("length"),
        F.sha2(record(F.col("url"), F.col("rotten")), 256).alias("other"), F.octet_length(record(F.col("url"), F.col("rotten"))).cast("long").alias("other_length"),
    )
    placed = numbered(leaves, ["page_id", "url", "sha256"])
    so_far = Window.partitionBy("archive").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = {"stop": F.sum("length").over(so_far), "other_stop": F.sum("other_length").over(so_far)}
    placed = placed.withColumns(ends).withColumns({"start": F.col("stop") - F.col("length"), "other_start": F.col("other_stop") - F.col("other_length")})
    placed = save(placed, "records")
    height = levels()
    sides = (("sha256", "start", "stop"), ("other", "other_start", "other_stop"))
    one, other = (save(tree(placed.select("archive", "seq", F.col(c).alias("sha256"), F.col(a).alias("start"), F.col(z).alias("stop")), height), "tree") for c, a, z in sides)
    bad = audit(one, other, height).select("archive", "seq", F.lit(True).alias("bad"))
    moved = audit(one, other, height, by="ranges").groupBy("archive").agg(F.count("*").alias("n_moved"))
    names = (("root", "index_root"), ("replica_root", "replica_index_root"))
    roots, roots_b = (x.filter(F.col("level") == height).select("archive", F.col("hash").alias(a), F.col("ranges").alias(b)) for x, (a, b) in zip((one, other), names, strict=True))
    at_fault = F.filter(F.array_sort(F.collect_list(F.when(F.col("bad"), F.struct("seq", "page_id", "start", "stop")))), lambda x: x.isNotNull())
    per = placed.join(bad, ["archive", "seq"], "left").groupBy("archive").agg(
        F.count("*").alias("n_records"), F.sum("length").alias("n_bytes"), F.count("bad").alias("n_bad"),
        F.array_join(F.transform(at_fault, lambda x: F.coalesce(x["page_id"].cast("string"), F.lit(""))), ",").alias("bad_ids"),
        F.array_join(F.transform(at_fault, lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), ",").alias("bad_ranges"),
    )
    out = per.join(roots, "archive").join(roots_b, "archive").join(moved, "archive", "left").na.fill(0, ["n_moved"])
    return out.select("archive", "n_records", "n_bytes", "root", "replica_root", "n_bad", "bad_ids", "bad_ranges", "index_root", "replica_index_root", "n_moved")
