"""Scores of a stream, end to end: as the batch plan gives them, also after a restart, with state that levels off."""

import math
import shutil

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillstone.operators import voip
from rillstone.plans import voip as plan
from rillstone.sources import fixtures as fx
from rillstone.streaming import voip as svs
from test_streaming import in_files, read, rows, run

SCHEMA = "call_id long, caller string, callee string, answer_ts long, duration int, established boolean"


def test_scores_after_a_restart(spark, tiny, tmp_path):
    calls = fx.calls(spark, tiny)
    # Ids in the order of answer times, which is the order of the stream.
    order = Window.orderBy("answer_ts", "call_id")
    calls = calls.withColumn("call_id", F.row_number().over(order).cast("long")).select(*voip.CALL)
    schema = in_files(calls, "call_id", tmp_path / "all")
    files = sorted((tmp_path / "all").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    part = tmp_path / "part"
    part.mkdir()
    for stop in (2, len(files)):
        for f in files[:stop]:
            if not (part / f.name).exists():
                shutil.copy2(f, part / f.name)
        stream = svs.scores(svs.with_event_time(read(spark, schema, part)))
        got = run(stream, tmp_path / "out", tmp_path / "cp")
    passed = calls.filter("established").agg(F.max("answer_ts")).first()[0] - 601
    columns = ["call_id", "fofir", "url", "acd", "score"]
    want = rows(plan.default(calls).filter(F.col("answer_ts") < passed), *columns)
    found = rows(got.filter(F.col("answer_ts") < passed), *columns)
    assert [r[0] for r in found] == [r[0] for r in want] != []
    assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(found, want) for x, y in zip(a, b))
    assert any(r[4] > 0 for r in want)


def test_callees_are_forgotten(spark, tmp_path):
    """A callee is known for as long as ``memory`` says, and the state levels off."""
    day, sizes = 86_400, []
    for d in range(5):
        data = [(1000 * d + i, "a", f"b{d}-{i}", d * day + i, 5, True) for i in range(60)]
        data += [(1000 * d + 100, "a", "friend", d * day + 100, 5, True), (1000 * d + 101, "a", "friend", d * day + 101, 5, True)]
        data += [(1000 * d + 102, "c", "rare", d * day + 102, 5, True)] if d % 3 == 0 else []
        frame = spark.createDataFrame(data, SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = svs.caller_features(svs.with_event_time(read(spark, frame.schema, tmp_path / "in")), memory=int(1.5 * day))
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        sizes.append(query.lastProgress.stateOperators[0].numRowsTotal)
    new = {(r["call_id"]): r["new_callee"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [new[1000 * d + 100] for d in range(5)] == [True, False, False, False, False] and not new[101]
    assert new[102] and new[3102], "not called for three days"
    assert max(sizes) < 4 * 62 and sizes[4] <= max(sizes[:4]) + 5, sizes
