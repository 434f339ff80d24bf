"""Sources, envelopes, replay and generation."""

import time

import pytest
from pyspark.sql import functions as F

from rillstone.operators import parsing
from rillstone.sources import lines as src


def test_file_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0,30,7,55,0,1,0,42,221760\n1,1,1,1,1,1,1,1,1\n")
    got = src.file_source(spark, str(tmp_path), parsing.parse_positions).collect()
    assert [r["segment"] for r in got] == [42]
    assert src.read_lines(spark, str(tmp_path), streaming=True).isStreaming


def test_source_by_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    assert src.source("", spark, str(tmp_path)).columns == ["ts_ms", "line", "ts_ext_ms"]
    assert src.source("local", spark, str(tmp_path), rate=10).isStreaming
    with pytest.raises(ValueError):
        src.source("other", spark)


def test_kafka_source_needs_the_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        src.source("kafka", spark, host="localhost:1", topic="t")


def test_envelope_round_trip(spark):
    df = spark.createDataFrame([(5, "a,b"), (6, "c|d")], "ts long, line string")
    sent = df.select(src.encode("ts").alias("value"))
    got = [tuple(r) for r in src.decode(sent, now_ms=F.lit(9)).orderBy("ts_ext_ms").collect()]
    assert got == [(9, "a,b", 5), (9, "c", 6)]


def test_replay(spark):
    df = spark.createDataFrame([(10, "a"), (20, "b"), (35, "c")], "seq long, line string")
    got = [tuple(r) for r in src.replay(df, "seq", 2, total=7, start_ms=100).orderBy("emission").collect()]
    assert [(g[1], g[2], g[3]) for g in got] == [(x, i, 100 + i * 500) for i, x in enumerate("abcabca")]
    assert src.replay(df, "seq", 2, cycles=2).count() == 6
    assert src.replay(df.limit(0), "seq", 2).count() == 0


def test_replay_stream(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "line string").coalesce(1)
    query = src.replay_stream(df, 50).writeStream.format("memory").queryName("replayed").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("replayed").count() < 10:
            time.sleep(0.5)
        got = [r["line"] for r in spark.table("replayed").collect()]
    finally:
        query.stop()
    assert len(got) >= 10 and set(got) == {"a", "b", "c"}


def test_constant_rate_schema(spark):
    assert src.constant_rate(spark, 5, ramp_up_seconds=2).columns == ["id", "ts", "stimulus", "f1", "f2", "f3"]


def test_generated_calls(spark):
    df = src.generate_calls(spark, 50, 5000, seed=3)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("caller") == F.col("callee")).cast("int")).alias("own"),
        F.min("duration").alias("low"),
        F.max("duration").alias("high"),
        F.avg(F.col("established").cast("int")).alias("established"),
        F.min(F.length("caller")).alias("a"),
        F.max(F.length("callee")).alias("b"),
        F.countDistinct("caller").alias("numbers"),
    ).first()
    assert (row["n"], row["own"], row["a"], row["b"], row["numbers"]) == (5000, 0, 11, 11, 50)
    assert 0 <= row["low"] and row["high"] < 86_400 and 0.93 < row["established"] < 0.97
    lines = df.select("call_id", src.call_line().alias("line"))
    back = parsing.parse_calls(lines).select(df.columns)
    assert back.exceptAll(df).count() == 0 and back.count() == 5000
    assert df.exceptAll(src.generate_calls(spark, 50, 5000, seed=3)).count() == 0
    with pytest.raises(ValueError):
        src.generate_calls(spark, 1, 5)


def test_kept_and_malformed_calls_are_all_lines(spark):
    good = "1,2,2021-03-01T10:00:00.000+01:00,120,true"
    bad = ["", "1,2", "1,2,yesterday,120,true", "1,2,2021-03-01T10:00:00.000+01:00,long,true", good.rsplit(",", 1)[0]]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate([good, *bad, good])], "id int, line string")
    kept = {r["id"] for r in parsing.parse_calls(lines, mode="permissive").collect()}
    left = {r["id"] for r in parsing.malformed_calls(lines).collect()}
    assert kept == {0, 6} and left == {1, 2, 3, 4, 5}
