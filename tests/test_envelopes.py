"""Topics of envelopes: ranges, restarts from offsets, publishing and reading."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillstone.sources import envelopes, lines


def read_all(path, size, chunk=7):
    envelopes.CHUNK_BYTES, kept = chunk, envelopes.CHUNK_BYTES
    try:
        found = []
        for part in envelopes.ranges(path, {}, envelopes.sizes(path), size):
            for batch in envelopes.batches(path, part):
                found += zip(batch["partition"].to_pylist(), batch["position"].to_pylist(), batch["value"].to_pylist())
        return found
    finally:
        envelopes.CHUNK_BYTES = kept


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab|é", max_size=9), max_size=12), st.booleans(), st.integers(1, 40), st.integers(1, 20))
def test_each_line_is_read_once(tmp_path_factory, messages, ended, size, chunk):
    folder = tmp_path_factory.mktemp("topic")
    text = "\n".join(messages) + ("\n" if ended and messages else "")
    (folder / "part-0").write_bytes(text.encode())
    (folder / "_log").write_bytes(b"x\n")
    want, at = [], 0
    for line in text.encode().split(b"\n")[: -1 if text.endswith("\n") else None] if text else []:
        want.append(("part-0", at, line.decode()))
        at += len(line) + 1
    assert read_all(str(folder), size, chunk) == want


def test_batch_of_a_topic(spark, tmp_path):
    for p in range(3):
        (tmp_path / f"part-{p}").write_text("".join(f"{1000 + i}|{p},{i}|rest\n" for i in range(500)))
    (tmp_path / "part-3").write_text("")
    got = envelopes.read_envelopes(spark, str(tmp_path), now_ms=F.lit(5), rangeBytes=900)
    assert got.columns == ["partition", "position", "ts_ms", "line", "ts_ext_ms"] and got.rdd.getNumPartitions() > 20
    found = sorted((r["partition"], r["ts_ext_ms"], r["line"], r["ts_ms"]) for r in got.collect())
    assert found == sorted((f"part-{p}", 1000 + i, f"{p},{i}", 5) for p in range(3) for i in range(500))
    assert envelopes.read_envelopes(spark, str(tmp_path / "none")).count() == 0


def test_restarts_neither_lose_nor_repeat(spark, tmp_path):
    topic, out = tmp_path / "topic", str(tmp_path / "out")
    topic.mkdir()

    def step():
        stream = envelopes.read_envelopes(spark, str(topic), streaming=True, rangeBytes=64)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        query = query.trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted((r["partition"], r["line"]) for r in spark.read.parquet(out).collect())

    (topic / "a").write_text("1|x\n2|y\n3|cut")
    assert step() == [("a", "x"), ("a", "y")]
    with open(topic / "a", "a") as file:
        file.write(" off\n4|z\n")
    (topic / "b").write_text("5|u\n")
    want = [("a", "cut off"), ("a", "x"), ("a", "y"), ("a", "z"), ("b", "u")]
    assert step() == want
    assert step() == want
    (topic / "a").write_text("9|short\n")
    with pytest.raises(Exception, match="read before"):
        step()


def test_published_lines_come_back(spark, tmp_path):
    sent = spark.range(40).select((F.col("id") + 10**12).alias("ts"), F.concat(F.lit("0,"), F.col("id")).alias("line"))
    sent.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sent.schema).parquet(str(tmp_path / "in"))
    query = envelopes.write_envelopes(stream, str(tmp_path / "topic"), str(tmp_path / "cp"), "ts")
    query.awaitTermination(120)
    assert query.exception() is None
    got = lines.source("envelopes", spark, path=str(tmp_path / "topic"))
    assert got.isStreaming and got.columns == ["ts_ms", "line", "ts_ext_ms"]
    back = envelopes.read_envelopes(spark, str(tmp_path / "topic"))
    assert sorted((r["ts_ext_ms"], r["line"]) for r in back.collect()) == sorted((r["ts"], r["line"]) for r in sent.collect())
