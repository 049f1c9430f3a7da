"""Sources, sinks and streams round trip."""

import datetime as dt
import json

from cairnkb.operators import usage
from cairnkb.sources import readers, writers
from cairnkb.streaming import usage as streams
from pyspark.sql import functions as F


def test_markdown_and_json(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.md").write_text("# one")
    (tmp_path / "README.md").write_text("no")
    assert [r.text for r in readers.markdown(spark, str(tmp_path)).collect()] == ["# one"]
    assert [r.name for r in readers.skills(spark, str(tmp_path / "a")).collect()] == ["one"]
    (tmp_path / "c.json").write_text(json.dumps({"chunks": [{"chunk_id": "x", "text": "t", "tags": ["a"]}]}))
    assert [(r.chunk_id, r.tags) for r in readers.json_corpus(spark, str(tmp_path / "c.json")).collect()] == [("x", ["a"])]
    for n in (1, 2):
        (tmp_path / f"run{n}.json").write_text(json.dumps({"n": n}))
    assert [r.n for r in readers.latest_json(spark, str(tmp_path / "run*.json"), "n int").collect()] == [2]
    (tmp_path / "run3.json").write_text("[]")
    assert readers.latest_json(spark, str(tmp_path / "run*.json"), "n int").count() == 0
    assert readers.latest_json(spark, str(tmp_path / "no*.json"), "n int").count() == readers.latest_json(spark, str(tmp_path / "none/x*.json"), "n int").count() == 0
    assert readers.manifest(spark, str(tmp_path / "none.json"), "n int").count() == 0
    assert readers.listing(spark, str(tmp_path), "*.json").count() == 4
    (tmp_path / "i.json").write_text(json.dumps({"ORD": {"title": "Orders", "functions": ["Total", "Count"]}}))
    assert sorted(readers.inventory(spark, str(tmp_path / "i.json")).select("code", F.explode("entry.functions").alias("f")).collect()) == [("ORD", "Count"), ("ORD", "Total")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10), (2, 20)], "id int, at int")
    assert spark.read.parquet(writers.version(rows, str(tmp_path / "t"), 1)).count() == 2
    assert writers.purge(rows, "at", F.lit(20), str(tmp_path / "kept")) == 1
    parents, children = writers.cascade(rows, rows.select("id"), "id", rows.filter("id = 1").select("id"))
    assert (parents.count(), children.count()) == (1, 1)
    said = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "user", None)], "conv_id int, turn int, role string, text string")
    assert writers.transcript(said).first().transcript == "USER: \n\nUSER: b"
    assert "&lt;" in writers.html_report(spark.createDataFrame([("<",)], "a string")).first().html


def test_relational_table(spark, tmp_path):
    """Read in parts by key, with filters and columns left to the database."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, i % 3, f"q{i}") for i in range(30)], "id int, user_id int, question string")
    rows.write.format("jdbc").options(url=url, dbtable="messages").save()
    read = readers.table(spark, url, "messages", partitionColumn="id", lowerBound="0", upperBound="30", numPartitions="3")
    assert read.rdd.getNumPartitions() == 3
    mine = read.filter("user_id = 1").select("id")
    assert sorted(r.id for r in mine.collect()) == list(range(1, 30, 3))
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,1)" in plan.replace("USER_ID", "user_id").replace("\"", "") and "question" not in plan.lower()


def test_logs_and_appends(spark, tmp_path):
    """A log's nested fields come back, a day's folder each; an append adds to what is there."""
    said = spark.createDataFrame(
        [("2024-01-01T10:00:00", "small", [("a.md", "One", "f", 1.5, True)], (False, 1, 0, ["x"]), "r"), ("2024-01-02T10:00:00", None, [], None, "")],
        "timestamp string, model string, rag_sources array<struct<source string, section string, function_name string, score double, exact_match boolean>>, lint struct<clean boolean, errors int, warnings int, issues array<string>>, response string",
    )
    for _ in range(2):
        writers.session_log(said, str(tmp_path / "log"))
    back = readers.session_logs(spark, str(tmp_path / "log"))
    assert back.count() == 4 and back.filter("model is null").count() == 2
    first = back.filter("model = 'small'").first()
    assert (first.rag_sources[0].score, first.lint.issues, first.question) == (1.5, ["x"], None)
    assert len(list((tmp_path / "log").glob("day=*"))) == 2
    for _ in range(2):
        writers.append(said.select("timestamp", "model"), str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 4


def test_streamed_limits_and_upserts(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i), 1, "error", 2.0, '{"k": 1}') for i in range(12)]
    events = spark.createDataFrame(rows, streams.EVENTS.replace("TIMESTAMP_NTZ", "TIMESTAMP")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.rate_limited(streams.events(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("limited").filter("accepted").count() == 10
    daily = usage.daily(events.select("user_id", F.to_date("ts").alias("day"), F.col("value").cast("long").alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.lit(1).alias("request_count")))
    write = streams.upsert_into(str(tmp_path / "daily"))
    write(daily, 0)
    write(daily, 1)
    assert spark.read.parquet(str(tmp_path / "daily/v000001")).first().request_count == 24
