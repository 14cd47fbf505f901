"""Streams that are stopped, restarted and waited for."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from papyra.streaming import upkeep

PARTS = "task string, part int, text string"


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / name))


def reading(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))


@pytest.mark.parametrize("cut", ["between", "commit lost", "file half written"])
def test_parts_are_appended_once_over_restarts(spark, tmp_path, cut):
    """The query is stopped between parts; its last commit is lost, or a batch was cut off after a file: each part stands in the draft once."""
    source, draft, checkpoint = tmp_path / "in", str(tmp_path / "draft"), str(tmp_path / "checkpoint")
    run = lambda: upkeep.append_parts(reading(spark, source, PARTS), draft, checkpoint, once=True).awaitTermination()
    put(spark, source, "1", [("a", 2, "a2"), ("a", 1, "a1"), ("b", 2, "early")], PARTS)
    run()
    if cut == "commit lost":
        for f in Path(checkpoint, "commits").glob("*0*"):
            f.unlink()
    put(spark, source, "2", [("a", 2, "again"), ("a", 3, "a3"), ("a", 5, "gap"), ("b", 1, "b1")], PARTS)
    if cut == "file half written":
        spark.createDataFrame([("a", 3, "torn")], PARTS).coalesce(1).write.mode("append").parquet(draft + "-other")
        torn = next(Path(draft + "-other").glob("part-*.parquet"))
        torn.rename(Path(draft, "part-00000-torn.parquet"))
    run()
    put(spark, source, "3", [("b", 2, "b2")], PARTS)
    run()
    got = sorted((r["task"], r["part"], r["text"]) for r in spark.read.parquet(draft).collect())
    assert got == [("a", 1, "a1"), ("a", 2, "a2"), ("a", 3, "a3"), ("b", 1, "b1"), ("b", 2, "b2")]


def test_progress_follows_the_draft(spark):
    progress = spark.createDataFrame([("a", 5, 2), ("b", 3, 3), ("c", 4, 1), ("d", 2, 2)], "task string, total int, completed int")
    parts = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 3), ("a", 5), ("b", 1), ("b", 2), ("b", 3), ("c", 2)], "task string, part int")
    got = {r["task"]: tuple(r)[1:] for r in upkeep.repair_progress(progress, parts).collect()}
    assert got == {"a": (5, 3, True, True), "b": (3, 3, False, False), "c": (4, 0, True, False), "d": (2, 0, True, False)}


def collected(stream, mode, folder, seconds, during=lambda: None, until=lambda rows: False):
    """What a running stream gives until ``until`` holds, or for so many seconds; ``during`` runs once it has begun."""
    rows = []
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", str(folder)).trigger(processingTime="50 milliseconds").start()
    try:
        during()
        end = time.time() + seconds
        while time.time() < end and query.isActive and not until(rows):
            time.sleep(0.05)
        if query.exception():
            raise query.exception()
        return rows
    finally:
        query.stop()


CHANGES = "library string, at long, body string"


def test_a_burst_is_exported_once(spark, tmp_path):
    """Five changes in quick succession, then quiet, then one more: two exports of the library, each the last state, and one of another library."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    source = tmp_path / "in"
    put(spark, source, "0", [("x", 0, "v0"), ("y", 0, "w0")], CHANGES)

    def burst():
        for k in range(1, 5):
            put(spark, source, str(k), [("x", k, f"v{k}")], CHANGES)
        time.sleep(12)
        put(spark, source, "5", [("x", 9, "v9"), ("x", 7, "late")], CHANGES)

    out = upkeep.debounce(reading(spark, source, CHANGES), "library", "at", 4000)
    rows = collected(out, "append", tmp_path / "cp", 40, burst, lambda rows: len(rows) >= 3)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r["body"] for r in rows if r["library"] == "x"] == ["v4", "v9"] and [r["body"] for r in rows if r["library"] == "y"] == ["w0"]


def test_retry_delays_of_the_three_policies(spark):
    rows = spark.range(1, 5).select([upkeep.retry_delay(F.col("id").cast("int"), p).alias(p) for p in ("linear", "doubling", "fixed")]).collect()
    assert [tuple(r) for r in rows] == [(0.5, 1.0, 2.0), (1.0, 2.0, 5.0), (None, None, 12.0), (None, None, None)]


def test_items_come_back_after_their_wait(spark, tmp_path):
    """Item a fails until it is given up, b fails once and then works, c works at once; a policy's second is cut to 300 ms."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    source, schema = tmp_path / "in", "item string, ok boolean"
    put(spark, source, "0", [("a", False), ("b", False), ("c", True)], schema)
    step = [0]

    def until(rows):
        due = [r for r in rows if not r["given_up"]]
        while step[0] < len(due):
            r = due[step[0]]
            step[0] += 1
            put(spark, source, f"{r['item']}{r['attempt']}", [(r["item"], r["item"] == "b")], schema)
        return any(r["given_up"] for r in rows)

    rows = collected(upkeep.due_retries(reading(spark, source, schema), "linear", 300), "append", tmp_path / "cp", 60, until=until)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(tuple(r) for r in rows) == [("a", 2, False), ("a", 3, False), ("a", 3, True), ("b", 2, False)]
