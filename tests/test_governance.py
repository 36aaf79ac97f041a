"""Changes to what is known, staging, and the gate of a feed with a time limit."""

import time

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import governance
from loomgraph.streaming import feed


def test_sources_are_checked(spark):
    rows = [("a", "git", 3, None), ("b", "delta", 3, None), ("c", "delta", 3, "p"), ("", "git", 3, None), ("d", "git", 9, None), ("e", "git", None, None)]
    frame = spark.createDataFrame(rows, "source_id string, flavor string, ceiling int, projection string")
    assert {r.source_id: r.problem for r in governance.registered(frame).collect()} == {"a": None, "b": "projection required", "c": None, "": "no id", "d": "bad ceiling", "e": "bad ceiling"}


def test_visibility_is_only_widened(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "memory_id string, visibility int").withColumn("recorded_at", F.lit(None).cast("timestamp"))
    wanted = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "memory_id string, visibility int")
    assert [(r.memory_id, r.visibility) for r in governance.promoted(rows, wanted, F.current_timestamp()).collect()] == [("a", 2)]


def test_discoveries_are_accepted_once(spark):
    rows = spark.createDataFrame([("x", "a", "b", 0.6, "open"), ("y", "a", "c", 0.6, "accepted")], "discovery_id string, from_id string, to_id string, quality double, state string")
    edges, marked = governance.accepted(rows, rows.select("discovery_id"))
    assert [(r.from_id, r.to_id) for r in edges.collect()] == [("a", "b")]
    assert {r.state for r in marked.collect()} == {"accepted"}


def test_cursor_stops_before_the_first_open_batch(spark):
    rows = spark.createDataFrame([("s", 1, True), ("s", 2, True), ("s", 3, False), ("s", 4, True), ("t", 1, False)], "source string, snapshot long, settled boolean")
    assert [tuple(r) for r in governance.settled_cursor(rows).collect()] == [("s", 2)]
    assert spark.range(1).select(governance.retry_delay(F.lit(3)).alias("d")).first().d == 4.0


def test_vectors_are_stamped(spark):
    frame = spark.createDataFrame([("a", "Title", "text"), ("b", None, "  "), ("c", "title", "TEXT")], "memory_id string, title string, content string")
    got = {r.memory_id: r.embedding for r in governance.stamped(frame).collect()}
    assert got["b"] is None and got["a"].vector == got["c"].vector and sum(v * v for v in got["a"].vector) == pytest.approx(1)
    assert got["a"].model.name == governance.MODEL


def test_every_text_has_a_vector_of_length_one(spark):
    words = [f"word{i}" for i in range(2000)]  # about one of 128 has both buckets in one place, with opposite signs
    texts = [*words, *[f"{w}\t{w.upper()}" for w in words[:500]], "", " \n", None]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(governance.embed("text").alias("v")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert len(r.v) == governance.WIDTH and sum(x * x for x in r.v) == pytest.approx(1)
    assert got[0].v == got[2000].v  # a word said twice has the same direction


def test_gate_reports_a_gap(spark, tmp_path):
    spark.createDataFrame([("o", 0), ("o", 2), ("o", 0)], "org string, lsn long").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("org string, lsn long").parquet(str(tmp_path / "in"))
    query = feed.gate(events, wait_ms=200).writeStream.format("memory").queryName("gated").outputMode("append").start()
    try:
        until = time.time() + 60
        while time.time() < until:
            got = {(r.lsn, r.status) for r in spark.sql("SELECT * FROM gated").collect()}
            if (1, "gap") in got:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert {(0, "released"), (0, "stale"), (1, "gap")} <= got and (2, "released") not in got


def test_publishes_are_bounded_whatever_the_size_of_a_trigger(spark, tmp_path):
    places = [str(tmp_path / name) for name in ("in", "out", "checkpoint")]
    spark.range(70_000).selectExpr("id AS lsn", "CAST(id % 3 AS STRING) AS state").repartitionByRange(2, "lsn").sortWithinPartitions("lsn").write.parquet(places[0])
    sent = feed.published(feed.stream_of(spark, places[0], "lsn long, state string", 1))
    query = sent.writeStream.format("parquet").option("path", places[1]).option("checkpointLocation", places[2]).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["batchId"] < 4  # 274 with a trigger for each publish
    found = spark.read.parquet(places[1])
    sizes = found.groupBy("publish").agg(F.count("*").alias("n"), F.min("lsn").alias("low"), F.max("lsn").alias("high")).collect()
    assert max(r.n for r in sizes) == 256 and sum(r.n < 256 for r in sizes) <= 2
    assert all(r.high - r.low == r.n - 1 for r in sizes)
    assert found.select("lsn").distinct().count() == found.count() == 70_000
