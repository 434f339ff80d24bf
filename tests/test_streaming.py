"""The same rows through micro-batches and through a batch give the same results."""

import math
import shutil

import pytest
from pyspark.sql import functions as F

from rillstone.operators import linear_road as lr
from rillstone.operators import voip
from rillstone.sources import fixtures as fx
from rillstone.streaming import linear_road as slr
from rillstone.streaming import statistics as sst
from rillstone.streaming import voip as svs

PARTS = 4


def in_files(df, order, path):
    """Write the rows as PARTS files in arrival order, one micro-batch each."""
    last = df.agg(F.max(order)).first()[0] + 1
    part = F.floor(F.col(order) * PARTS / last).cast("int")
    for i in range(PARTS):
        df.filter(part == i).coalesce(1).write.mode("append").parquet(str(path))
    return df.schema


def read(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(stream, path, checkpoint):
    query = stream.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint))
    query = query.trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination(240)
    assert query.exception() is None
    return stream.sparkSession.read.parquet(str(path))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def reports(spark, tiny, tmp_path_factory):
    path = tmp_path_factory.mktemp("reports") / "in"
    positions = fx.positions(spark, tiny)
    return positions, in_files(positions, "seq", path), path


@pytest.fixture(scope="module")
def records(spark, tiny, tmp_path_factory):
    path = tmp_path_factory.mktemp("records") / "in"
    calls = fx.calls(spark, tiny)
    return calls, in_files(calls, "call_id", path), path


def final_minute(positions):
    """Minutes before this one are closed by the watermark at the end of the input."""
    last = positions.agg(F.max("time")).first()[0] - 60
    return last // 60 + 1


def test_stays_and_lav(spark, reports, tmp_path):
    positions, schema, path = reports
    stream = slr.with_event_time(read(spark, schema, path))
    got = run(slr.last_average_speed(slr.average_speed(stream)), tmp_path / "out", tmp_path / "cp")
    want = lr.last_average_speed(lr.average_speed(positions)).filter(F.col("minute") <= final_minute(positions))
    columns = ["minute", *lr.SEGMENT, "lav"]
    assert rows(got, *columns) == rows(want, *columns) != []


def test_counts(spark, reports, tmp_path):
    positions, schema, path = reports
    stream = slr.with_event_time(read(spark, schema, path))
    got = run(slr.count_vehicles(stream, 3), tmp_path / "out", tmp_path / "cp")
    want = lr.count_vehicles(positions, threshold=3).filter(F.col("minute") < final_minute(positions))
    columns = ["minute", *lr.SEGMENT, "count"]
    assert rows(got, *columns) == rows(want, *columns) != []


def test_segment_changes_with_restart(spark, reports, tmp_path):
    positions, schema, path = reports
    part = tmp_path / "part"
    files = sorted(path.glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    part.mkdir()
    for stop in (2, PARTS):
        for f in files[:stop]:
            if not (part / f.name).exists():
                shutil.copy2(f, part / f.name)  # with its time, which is the order of the micro-batches
        stream = slr.with_event_time(read(spark, schema, part), "30 days")
        got = run(slr.segment_changes(stream), tmp_path / "out", tmp_path / "cp")
    columns = ["seq", "vid", "segment"]
    assert rows(got, *columns) == rows(lr.segment_changes(positions), *columns) != []


def test_tolls_against_written_state(spark, reports, tmp_path):
    positions, schema, path = reports
    lav = lr.last_average_speed(lr.average_speed(positions))
    counts = lr.count_vehicles(positions, threshold=3)
    stream = slr.with_event_time(read(spark, schema, path), "30 days")
    got = run(slr.assess_tolls(slr.segment_changes(stream), lav, counts, car_threshold=3), tmp_path / "out", tmp_path / "cp")
    want = lr.toll_notification_pos(positions, lav, counts, car_threshold=3)
    assert rows(got, "seq", "vid", "speed", "toll") == rows(want, "seq", "vid", "speed", "toll") != []


def test_rated_calls(spark, records, tmp_path):
    calls, schema, path = records
    stream = svs.with_event_time(read(spark, schema, path))
    got = run(svs.rated_calls(stream), tmp_path / "out", tmp_path / "cp").fillna(-1.0)
    want = voip.caller_features(calls).join(voip.rcr(calls).select("call_id", "rcr"), "call_id").fillna(-1.0)
    exact = ["call_id", "caller", "new_callee"]
    assert rows(got, *exact) == rows(want, *exact) != []
    rates = ["call_id", "ecr", "ecr24", "encr", "ct24", "rcr"]
    for a, b in zip(rows(got, *rates), rows(want, *rates)):
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(a, b))


def test_global_average_sink(spark, records, tmp_path):
    calls, schema, path = records
    sink = svs.GlobalAverageSink(str(tmp_path / "acd"), block_rows=64)
    query = read(spark, schema, path).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp"))
    query = query.trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    got = rows(spark.read.parquet(str(tmp_path / "acd" / "averages")), "call_id", "global_acd")
    want = rows(voip.global_acd(calls), "call_id", "global_acd")
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(math.isclose(g[1], w[1], rel_tol=1e-9) for g, w in zip(got, want))


def test_counts_per_second(spark, records, tmp_path):
    calls, schema, path = records
    stream = read(spark, schema, path).withColumn("at", F.timestamp_seconds("answer_ts"))
    got = run(sst.count_per_second(stream, "at"), tmp_path / "out", tmp_path / "cp")
    end = calls.agg(F.max("answer_ts")).first()[0] - 10
    want = calls.groupBy(F.col("answer_ts").alias("second")).agg(F.count(F.lit(1)).alias("count")).filter(F.col("second") < end)
    assert rows(got, "second", "count") == rows(want, "second", "count") != []


def test_latency_sink_and_listener(spark, records, tmp_path):
    from rillstone.operators.statistics import observed

    calls, schema, path = records
    listener = sst.ThroughputListener()
    spark.streams.addListener(listener)
    try:
        sent = (F.col("answer_ts") * 1000).alias("ts_ms"), (F.col("answer_ts") * 1000 - 5).alias("ts_ext_ms")
        stream = observed(read(spark, schema, path).select(*sent), "sink", "ts_ms")
        query = stream.writeStream.foreachBatch(sst.LatencySink(str(tmp_path / "lat")))
        query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        got = spark.read.parquet(str(tmp_path / "lat" / "latencies"))
        assert got.count() == calls.count()
        assert got.filter("end_latency - latency <> 5").count() == 0
        means = spark.read.parquet(str(tmp_path / "lat" / "statistics"))
        assert means.agg(F.sum("count")).first()[0] == calls.count()
        assert means.filter("mean_end_latency - mean_latency <> 5").count() == 0
    finally:
        spark.streams.removeListener(listener)


def test_a_late_call_counts_with_its_age(spark, tmp_path):
    """A call that comes a batch late decays until then, and is forgotten like the others afterwards."""
    batches = [[(1, 1000)], [(2, 500)], [(3, 1010)]]
    for i, batch in enumerate(batches):
        data = [(c, "a", f"b{c}", t, 1, True) for c, t in batch]
        frame = spark.createDataFrame(data, "call_id long, caller string, callee string, answer_ts long, duration int, established boolean")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = svs.caller_features(svs.with_event_time(read(spark, frame.schema, tmp_path / "in")))
    got = {r["call_id"]: r["ecr"] for r in run(stream, tmp_path / "out", tmp_path / "cp").collect()}
    fast = math.log(1 / voip.BETA)
    assert math.isclose(got[1], fast)
    assert math.isclose(got[2], fast * (1 + voip.BETA**500))
    assert math.isclose(got[3], fast * (1 + voip.BETA**10 + voip.BETA**510), rel_tol=1e-9)
