"""Sources: Markdown trees, JSON corpora, latest result files, file listings, tables, inline lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = """chunk_id STRING, source_file STRING, section STRING, ordinal BIGINT, text STRING, bm25_text STRING, function_name STRING,
signature STRING, return_type STRING, has_examples BOOLEAN, has_signature BOOLEAN, category STRING, table_abbrev ARRAY<STRING>,
priority STRING, context ARRAY<STRING>, tags ARRAY<STRING>, keywords ARRAY<STRING>, doc_type STRING, content_hash STRING"""

SESSION_LOG = """timestamp STRING, model STRING, access_mode STRING, active_skills ARRAY<STRING>, question STRING,
rag_sources ARRAY<STRUCT<source STRING, section STRING, function_name STRING, score DOUBLE, exact_match BOOLEAN>>,
lint STRUCT<clean BOOLEAN, errors INT, warnings INT, issues ARRAY<STRING>>, response STRING"""


def spread(rows: DataFrame, most: int = 1 << 30) -> DataFrame:
    """A table of at most ``most`` bytes by Spark's estimate dealt to all cores; a larger one as it is.

    A Parquet row group is one task's work, and a small table may be a single one. Beyond the
    bound there are row groups enough, and a shuffle of the table would cost more than it gives.
    """
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= most else rows


def markdown(spark: SparkSession, root: str, skip: tuple[str, ...] = ("README.md", "SOURCES.md")) -> DataFrame:
    """``(path, text)`` of all Markdown files below a folder but for those named."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("_name"), F.col("value").alias("text")).filter(~F.col("_name").isin(*skip)).drop("_name")


def json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a JSON document ``{"chunks": [...]}``."""
    return spark.read.schema(f"chunks ARRAY<STRUCT<{CHUNKS.replace(chr(10), ' ')}>>").option("multiLine", True).json(path).select(F.explode("chunks").alias("c")).select("c.*")


def session_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSION_LOG).option("multiLine", True).json(path)


def latest_json(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Of the JSON files that match, the one of the last name; the others are listed and not read.

    No file gives no rows, as does a last file without any.
    """
    folder, _, names = pattern.rpartition("/")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder or ".")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    last = listing(spark, folder or ".", names).agg(F.max("path")).first()[0]
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).option("multiLine", True).json(last)


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(path, modified)`` of files, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("modificationTime").alias("modified"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest's row, or no row where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A relational table by JDBC; pass partitionColumn, lowerBound, upperBound and numPartitions for large ones."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def skills(spark: SparkSession, root: str) -> DataFrame:
    """``(name, text)`` of the Markdown files whose names are plain."""
    files = spark.read.option("pathGlobFilter", "*.md").text(root, wholetext=True)
    named = files.select(F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("name"), F.col("value").alias("text"))
    return named.filter(F.col("name").rlike("^[a-z0-9_-]+$"))


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A lookup table from literals."""
    return spark.createDataFrame(rows, schema)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """``(code, entry)`` of a JSON object of ``{code: {title, functions}}``."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "MAP<STRING, STRUCT<title: STRING, functions: ARRAY<STRING>>>")
    return text.select(F.explode(parsed).alias("code", "entry"))
