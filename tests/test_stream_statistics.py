"""Per-second statistics of streams without gaps, mergeable summaries, and lines sorted in one pass."""

from pyspark.sql import functions as F

from rillstone.operators import parsing
from rillstone.operators import statistics as st
from rillstone.sources import fixtures as fx
from rillstone.streaming import statistics as sst
from rillstone.streaming.parsing import SortedLines
from test_streaming import in_files, read, rows, run


def test_counts_and_averages_without_gaps(spark, tiny, tmp_path):
    calls = fx.calls(spark, tiny).withColumn("answer_ts", F.col("answer_ts") + F.when(F.col("call_id") > 500, 300).otherwise(0))
    calls = calls.withColumn("half", (F.col("call_id") % 2).cast("int"))
    schema = in_files(calls, "call_id", tmp_path / "in")
    stream = read(spark, schema, tmp_path / "in").withColumn("at", F.timestamp_seconds("answer_ts"))
    end = calls.agg(F.max("answer_ts")).first()[0] - 10
    got = run(sst.counts_without_gaps(stream, "at"), tmp_path / "counts", tmp_path / "cp1")
    want = st.count_per_second(calls, "answer_ts").withColumnRenamed("answer_ts", "second").filter(F.col("second") < end)
    passed = got.agg(F.max("second")).first()[0]
    assert rows(got, "second", "count") == rows(want.filter(F.col("second") <= passed), "second", "count") != []
    assert got.filter("count = 0").count() > 200 and passed > end - 60
    got = run(sst.averages_without_gaps(stream, "at", "duration", ["half"]), tmp_path / "means", tmp_path / "cp2")
    want = st.average_per_second(calls, "answer_ts", "duration", ["half"]).withColumnRenamed("answer_ts", "second")
    last = {r["half"]: r["m"] for r in got.groupBy("half").agg(F.max("second").alias("m")).collect()}
    expected = [r for r in rows(want, "half", "second", "average") if r[1] <= last[r[0]]]
    assert rows(got, "half", "second", "average") == expected and any(r[2] == -1 for r in expected)


def test_merged_summaries(spark, small):
    """Sketches per second, merged by name, against all samples."""
    events = fx.events(spark, small).select("sec", F.col("event_type").alias("name"), F.col("k").alias("value")) if hasattr(fx, "events") else None
    sketches = st.sketched(events, ["name", "sec"], "value")
    merged = {r["name"]: r for r in st.merged_summary(sketches, "name").collect()}
    values = {}
    for r in events.filter("value IS NOT NULL").collect():
        values.setdefault(r["name"], []).append(r["value"])
    assert merged.keys() == values.keys()
    for name, held in values.items():
        held.sort()
        got = merged[name]
        assert (got["samples"], got["p0"], got["p100"]) == (len(held), held[0], held[-1])
        assert abs(got["mean"] - sum(held) / len(held)) < 1e-9
        for column, p in st.SUMMARY.items():
            low, high = (sum(test(v) for v in held) / len(held) for test in (lambda v: v < got[column], lambda v: v <= got[column]))
            assert low - 0.02 <= p <= high + 0.02, (name, column, got[column], low, high)


def test_sorted_lines_of_a_stream(spark, tiny, tmp_path):
    lines = fx.position_lines(spark, tiny).select("seq", "line")
    odd = spark.createDataFrame([(10**9, "0,1,x,,"), (10**9 + 1, "3,1,2"), (10**9 + 2, ""), (10**9 + 3, None)], "seq long, line string")
    lines = lines.unionByName(odd)
    lines.repartition(3, "seq").write.parquet(str(tmp_path / "in"))
    query = read(spark, lines.schema, tmp_path / "in").writeStream.foreachBatch(SortedLines(str(tmp_path / "out")))
    query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == lines.count()
    kept = parsing.parse_positions(lines, mode="permissive")
    names = [c for c in kept.columns if c in out.columns]
    assert rows(out.filter("outcome = 'kept'"), *names) == rows(kept, *names) != []
    bad = out.filter("outcome = 'malformed'")
    assert sorted(r["seq"] for r in bad.collect()) == sorted(r["seq"] for r in parsing.malformed_positions(lines).collect())
    assert bad.count() == 3 and out.filter("outcome = 'other'").count() >= 1
