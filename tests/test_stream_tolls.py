"""Tolls of a stream, end to end: as the batch operators give them, with accidents and after a restart."""

import shutil

import pytest
from pyspark.sql import functions as F

from rillstone.operators import linear_road as lr
from rillstone.plans import linear_road as plan
from rillstone.sources import fixtures as fx
from rillstone.streaming import linear_road as slr
from test_streaming import in_files, read, rows, run

COLUMNS = ["seq", "vid", "speed", "toll"]


@pytest.fixture(scope="module")
def road(spark, tiny, tmp_path_factory):
    """Reports, accidents in the busiest segments, and both as files in the order of their times."""
    path = tmp_path_factory.mktemp("road")
    positions = fx.positions(spark, tiny)
    owing = plan.tolls(positions, car_threshold=3).filter("toll > 0").select("pos.time", "pos.xway", "pos.direction", "pos.segment")
    accidents = owing.filter("time % 3 = 0").select(F.floor(F.col("time") / 60).cast("int").alias("minute"), "xway", "direction", "segment").distinct()
    accidents = accidents.filter("minute > 0")
    parts = {}
    for name, frame, order in (("reports", positions, "seq"), ("accidents", accidents.withColumn("seq", F.col("minute").cast("long")), "seq")):
        parts[name] = in_files(frame, order, path / name)
    return positions, accidents, parts, path


def stream_of(spark, parts, path, name):
    return read(spark, parts[name], path / name)


def closed(frame, positions, lateness=180):
    """Rows of entries that the watermark has passed at the end of the input."""
    last = positions.agg(F.max("time")).first()[0] - lateness
    times = positions.select("seq", "time")
    return frame.join(times, "seq").filter(F.col("time") < last)


def test_tolls_with_accidents(spark, road, tmp_path):
    positions, accidents, parts, path = road
    reports = slr.with_event_time(stream_of(spark, parts, path, "reports"))
    blocked = slr.with_accident_time(stream_of(spark, parts, path, "accidents"))
    got = run(slr.tolls(reports, blocked, car_threshold=3), tmp_path / "out", tmp_path / "cp")
    want = plan.tolls(positions, accidents, car_threshold=3)
    found, whole = rows(got, *COLUMNS), {r[0]: r for r in rows(want, *COLUMNS)}
    # The slower one of the two streams holds the watermark: what is given out is the batch's, and some tolls are waived.
    assert found and all(whole[r[0]] == r for r in found)
    due = {r[0]: r[3] for r in rows(plan.tolls(positions, car_threshold=3), *COLUMNS)}
    assert any(due[r[0]] > 0 and r[3] == 0 for r in found) and any(r[3] > 0 for r in found)


def test_tolls_after_a_restart(spark, road, tmp_path):
    positions, _, parts, path = road
    files = sorted((path / "reports").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    part = tmp_path / "part"
    part.mkdir()
    for stop in (2, len(files)):
        for f in files[:stop]:
            if not (part / f.name).exists():
                shutil.copy2(f, part / f.name)
        reports = slr.with_event_time(read(spark, parts["reports"], part))
        got = run(slr.tolls(reports, car_threshold=3), tmp_path / "out", tmp_path / "cp")
    want = plan.tolls(positions, car_threshold=3)
    expected = rows(closed(want, positions), *COLUMNS)
    assert rows(closed(got, positions), *COLUMNS) == expected != []
    assert any(r[3] for r in expected) and any(not r[3] for r in expected)


def test_a_late_accident_waives_the_toll(spark, tmp_path):
    """The accident comes a micro-batch after the entries of its minute, within the watermark."""
    fast, slow = 30, 20
    data = [(v, t, slow, 0, 0, 7 if v else 6, t * 100 + v) for t in (0, 30, 61, 90) for v in range(8)]
    data += [(50, 125, slow, 0, 0, 7, 20_000), (51, 126, fast, 0, 0, 40, 20_001)]
    batches = [data, [(98, 127, fast, 1, 0, 1, 20_002)], [(99, 3000, fast, 1, 0, 1, 30_000)]]
    schema = "vid int, time int, speed int, xway int, direction smallint, segment smallint, seq long"
    crashes = [[(1, 5, 0, 9, 1)], [(2, 0, 0, 9, 2)], [(61, 5, 0, 9, 3)]]
    for rows_of, crash in zip(batches, crashes):
        frame = spark.createDataFrame(rows_of, schema)
        frame = frame.withColumns({"lane": F.lit(1).cast("smallint"), "position": F.lit(0), "minute": (F.floor(F.col("time") / 60) + 1).cast("int")})
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "reports"))
        crashed = spark.createDataFrame(crash, "minute int, xway int, direction smallint, segment smallint, seq long")
        crashed.coalesce(1).write.mode("append").parquet(str(tmp_path / "accidents"))
    waived = {}
    for with_accident in (False, True):
        reports = slr.with_event_time(read(spark, frame.schema, tmp_path / "reports"))
        accidents = slr.with_accident_time(read(spark, crashed.schema, tmp_path / "accidents")) if with_accident else None
        got = run(slr.tolls(reports, accidents, car_threshold=3), tmp_path / f"out{with_accident}", tmp_path / f"cp{with_accident}")
        waived[with_accident] = {r["vid"]: r["toll"] for r in got.filter("vid IN (50, 51)").collect()}
    assert waived[False][50] > 0 and waived[False][51] == 0
    assert waived[True] == {50: 0, 51: 0}


def test_last_toll_of_a_stream(spark, road, tmp_path):
    positions, _, _, path = road
    messages = plan.tolls(positions, car_threshold=3).select("vid", "seq", "toll").unionByName(slr.exits(positions))
    schema = in_files(messages, "seq", tmp_path / "in")
    found = {}

    def keep(batch, _):
        found.update({r["vid"]: (r["seq"], r["toll"]) for r in batch.collect()})

    query = slr.last_toll(read(spark, schema, tmp_path / "in")).writeStream.outputMode("update").foreachBatch(keep)
    query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    want = {r["vid"]: (r["seq"], r["toll"]) for r in lr.last_toll(plan.tolls(positions, car_threshold=3), positions).collect()}
    assert {v: x for v, x in found.items() if x[1]} == want != {}


def test_vehicles_are_forgotten(spark, tmp_path):
    """State levels off: a vehicle that stays away is dropped, and enters anew when it comes back."""
    schema = "seq long, vid int, minute int, xway int, direction smallint, segment smallint, lane smallint, time int"
    sizes = []
    for hour in range(5):
        data = [(hour * 100 + v, hour * 50 + v, 60 * hour, 0, 0, 5, 1, 3600 * hour) for v in range(50)] + [(hour * 100 + 60, 9999, 60 * hour, 0, 0, 5, 1, 3600 * hour)]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = slr.segment_changes(slr.with_event_time(read(spark, spark.createDataFrame(data, schema).schema, tmp_path / "in")), idle=1800)
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        sizes.append(query.lastProgress.stateOperators[0].numRowsTotal)
    assert max(sizes[2:]) <= sizes[1] * 1.1, sizes
    assert spark.read.parquet(str(tmp_path / "out")).filter("vid = 9999").count() == 5
