"""Experiment analysis on small runs."""

import math

import pytest
from pyspark.sql import functions as F

from rillstone.functions.skew import Skew
from rillstone.operators import experiments as ex

SCHEMA = "seq long, experiment string, variant string, parameter string, rate int, rep int, node string, t long, value double"


def samples(spark, data):
    """Rows (parameter, variant, rate, rep, node, t, value)."""
    full = [(i, "e", v, p, r, rep, n, t, x) for i, (p, v, r, rep, n, t, x) in enumerate(data)]
    return spark.createDataFrame(full, SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_read_files(spark, tmp_path):
    for rep in (1, 2):
        folder = tmp_path / str(rep)
        folder.mkdir()
        (folder / "latency-raw_node-a.csv").write_text("1,1\n2,20\n3,30\n")
        (folder / "latency-raw_b.csv").write_text("1,5\n")
        (folder / "cpu.csv").write_text("n1,1,0.5\nn2,1,NaN\n")
    got = rows(ex.read_samples(spark, str(tmp_path), "latency-raw"), "rep", "node", "t", "value")
    assert got == [(1, "node-a", 2, 20.0), (1, "node-a", 3, 30.0), (2, "node-a", 2, 20.0), (2, "node-a", 3, 30.0)]
    reports = ex.read_reports(spark, str(tmp_path), "cpu")
    assert rows(reports.filter("node = 'n1'"), "rep", "t", "value") == [(1, 1, 0.5), (2, 1, 0.5)]
    assert reports.count() == 4


def test_graphite(spark):
    json = '[{"target":"a.b","datapoints":[[1.5,10],[null,11]]},{"target":"c","datapoints":[]}]'
    out = ex.graphite_flatten(spark.createDataFrame([(json,)], "json string"))
    assert rows(out, "target", "t", "value") == [("a.b", 10, 1.5), ("a.b", 11, None)]
    assert spark.range(1).select(ex.alias_by_node(F.lit("a.b.c.d"), 1, 3)).first()[0] == "b.d"


def test_rebase_and_trim(spark):
    data = [("latency", "OS", 1, rep, "n", 100 * rep + t, 1.0) for rep in (1, 2) for t in range(11)]
    out = ex.trim(ex.rebase_time(samples(spark, data)))
    kept = rows(out.filter("value is not null"), "rep", "t")
    assert kept == sorted([(rep, t) for rep in (1, 2) for t in range(3, 9)], key=repr)
    assert out.count() == 22


def test_variant_columns(spark):
    out = ex.variant_columns(spark.createDataFrame([("OS.4.0.5",)], "variant string"), "variant.parallelism")
    assert out.columns == ["variant", "parallelism"] and tuple(out.first()) == ("OS", 4.0)


def test_prefer_raw(spark):
    data = [("latency", "OS", 1, 1, "n", 1, 1.0), ("latency-raw", "OS", 1, 1, "n", 1, 2.0), ("throughput", "OS", 1, 1, "n", 1, 3.0)]
    out = ex.prefer_raw(samples(spark, data))
    assert rows(out, "parameter", "value") == [("latency", 2.0), ("latency-ignored", 1.0), ("throughput", 3.0)]


def test_units(spark):
    data = [
        ("throughput", "SLOW", 1, 1, "taskmanager.x", 1, 60.0),
        ("throughput", "OS", 1, 1, "Storm.x", 1, 60.0),
        ("latency", "SLOW", 1, 1, "Storm.x", 1, 500.0),
        ("latency", "OS", 1, 1, "Storm.x", 1, -1.0),
    ]
    out = ex.to_units(ex.per_second(samples(spark, data), ["SLOW"]))
    assert [tuple(r) for r in out.orderBy("seq").select("spe", "value").collect()] == [
        ("Flink", 2.0), ("Storm", 60.0), ("Storm", 0.5), ("Storm", None)
    ]


def test_get(spark):
    data = samples(spark, [("latency", "OS", 1, 1, "n", 1, 1.0), ("latency", "X", 1, 1, "n", 1, 1.0)])
    assert ex.get(data, parameter="latency", variant="X").count() == 1
    with pytest.raises(ValueError):
        ex.get(data)


def test_two_levels(spark):
    data = [("latency", "OS", 1, 1, n, t, v) for n, t, v in [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 10.0), ("c", 1, None)]]
    table = samples(spark, data)
    assert ex.two_level(table, "latency").first()["value"] == 6.0
    assert ex.two_level_sum(table, "latency").first()["value"] == 12.0
    assert ex.max_node(table, "latency", "max-latency").first()["value"] == 10.0
    assert math.isclose(ex.node_spread(table, "latency").first()["value"], 4 / 6)
    assert ex.two_level_sum(table.filter("node = 'c'"), "latency").first()["value"] is None


def test_confidence_and_difference(spark):
    table = samples(spark, [("latency", "OS", 1, 1, "a", t, v) for t, v in enumerate([1.0, 3.0])])
    row = ex.confidence_95(table, ["variant"]).first()
    assert row["mean"] == 2.0 and math.isclose(row["ci95"], 1.96 / math.sqrt(2))
    pairs = spark.createDataFrame([(3.0, 2.0), (1.0, 0.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in pairs.select(ex.percent_difference(F.col("a"), F.col("b"))).collect()]
    assert got == [50.0, None, None]


def test_weighted_latency_and_total_cpu(spark):
    data = [
        ("sink-throughput", "OS", 1, 1, "a", 1, 30.0),
        ("sink-throughput", "OS", 1, 1, "b", 1, 10.0),
        ("latency", "OS", 1, 1, "a", 1, 8.0),
        ("latency", "OS", 1, 1, "b", 1, 4.0),
        ("latency", "OS", 1, 1, "b", 2, 4.0),
        ("cpu", "OS", 1, 1, "a", 1, 50.0),
        ("cpu", "OS", 1, 1, "a", 2, 50.0),
        ("graphite-cpu", "OS", 1, 1, "g", 1, 1.0),
        ("scheduler-cpu", "OS", 1, 1, "s", 1, 2.0),
    ]
    table = samples(spark, data)
    assert rows(ex.weighted_latency(table), "node", "t", "value") == [("a", 1, 6.0), ("b", 1, 1.0), ("b", 2, None)]
    assert rows(ex.total_cpu(table), "t", "value") == [(1, 53.0), (2, None)]


def test_tables(spark):
    data = [("x", v, r, 1, "a", 1, val) for v, r, val in [("OS", 1, 2.0), ("B", 1, 2.1), ("C", 1, 8.0), ("OS", 2, 0.0), ("B", 2, 1.23456)]]
    table = samples(spark, data)
    assert rows(ex.pivot_table(table, "x", [1, 2]), "variant", "1", "2") == [("B", 2.1, 1.235), ("C", 8.0, None), ("OS", 2.0, 0.0)]
    got = {tuple(r) for r in ex.relative_table(table, "x").filter("baseline = 'OS'").select("variant", "rate", "relative").collect()}
    assert got == {("OS", 1, "-"), ("B", 1, "+5%"), ("C", 1, "+4.0x"), ("OS", 2, "-"), ("B", 2, "missing")}


def test_rolling(spark):
    table = samples(spark, [("x", "OS", 1, 1, "a", t, float(t)) for t in range(40)])
    got = dict(rows(ex.rolling_mean(table), "t", "value"))
    assert got[0] == 0.0 and got[29] == 14.5 and got[39] == 24.5


@pytest.mark.parametrize("width", [1, 2, 30, 100])
def test_rolling_in_blocks(spark, width):
    data = [("x", v, 1, rep, "a", t * t % 997, float(t % 13)) for v in ("OS", None) for rep in (1, 2) for t in range(600)]
    table = samples(spark, data + [("x", "few", 1, 1, "a", 5, 2.0)])
    names = ["parameter", "variant", "rate", "t", "value"]
    whole = rows(ex.rolling_mean(table, rows=width), *names)
    per = table.groupBy("variant", "t").agg(F.avg("value").alias("value")).orderBy("t").collect()
    for variant in ("OS", None, "few"):
        held = [r["value"] for r in per if r["variant"] == variant]
        want = [sum(held[max(0, i - width + 1) : i + 1]) / min(i + 1, width) for i in range(len(held))]
        got = [r[4] for r in sorted((r for r in whole if r[1] == variant), key=lambda r: r[3])]
        assert len(got) == len(want) and all(math.isclose(g, w, abs_tol=1e-9) for g, w in zip(got, want))
    assert rows(ex.rolling_mean(table, rows=width, skew=Skew(min_rows=50, block_rows=32)), *names) == whole


def test_order(spark):
    table = samples(spark, [("x", v, r, 1, "a", 1, 1.0) for v, r in [("OS", 1), ("NEW-OS", 2), ("NEW", 3)]])
    assert rows(ex.variant_order(table, ["OS", "NEW"]), "variant", "position") == [("NEW", 1), ("NEW-OS", 0), ("OS", 0)]
    with pytest.raises(Exception, match="unknown variant"):
        ex.variant_order(table, ["OS"]).collect()
    assert ex.rate_range(table, 2).count() == 2


def test_policy(spark):
    table = samples(spark, [("x", v, 1, 1, "a", 1, 1.0) for v in ["OS", "CUSTOM-QS", "CUSTOM-RT-HR", "OTHER-OS"]])
    got = {tuple(r) for r in ex.scheduler_policy(table).select("variant", "scheduler", "policy").collect()}
    assert got == {("OS", "OS", "default"), ("CUSTOM-QS", "CUSTOM", "QS"), ("CUSTOM-RT-HR", "CUSTOM", "HR"), ("OTHER-OS", "OTHER", "default")}


def test_boxes_and_summary(spark):
    data = [("input-queue", "OS", 1, 1, f"n{i}", 60 * i, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 100.0])]
    data += [("input-queue", "OS", 1, 2, "spout1", 1, 7e9)]
    table = samples(spark, data)
    row = ex.queue_boxes(table).first()
    assert [row[c] for c in ("q1", "median", "q3", "low", "high", "outliers")] == [2.0, 3.0, 4.0, 1.0, 4.0, 1]
    assert tuple(ex.run_summary(table).select("reps", "minutes").first()) == (2, 4.0)


def test_runs_of_two_rates_are_told_apart(spark):
    """Runs of the same repetition whose rates begin at different times are rebased and trimmed each on its own."""
    data = [("latency", "OS", rate, 1, "n", start + t, float(t)) for rate, start in ((1000, 0), (2000, 500)) for t in range(11)]
    rebased = ex.rebase_time(samples(spark, data))
    assert {r["t"] for r in rebased.filter("rate = 2000").collect()} == set(range(11))
    kept = {(r["rate"], r["t"]) for r in ex.trim(rebased).filter("value is not null").collect()}
    assert kept == {(rate, t) for rate in (1000, 2000) for t in range(3, 9)}


def test_experiment_folder(spark, tmp_path):
    for folder, start in (("lr_OS.1000", 0), ("lr_OS.2000", 70)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "latency.csv").write_text("".join(f"1,node,{start + t},{t}.5\n" for t in range(11)))
    read = ex.read_experiments(spark, str(tmp_path), "variant.rate")
    assert {tuple(r) for r in read.select("experiment", "variant", "rate", "parameter").distinct().collect()} == {
        ("lr", "OS", 1000.0, "latency"), ("lr", "OS", 2000.0, "latency")
    }
    timed = ex.trim(ex.rebase_time(read, ex.run_keys("variant.rate")), ex.run_keys("variant.rate"))
    assert {(r["rate"], r["t"]) for r in timed.filter("value is not null").collect()} == {(q, t) for q in (1000.0, 2000.0) for t in range(3, 9)}
    summary = {(r["rate"], r["reps"]) for r in ex.run_summary(timed).collect()}
    assert summary == {(1000.0, 1), (2000.0, 1)}


def test_missing_values_count_as_samples(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("a", None)], "k string, value double")
    assert ex.confidence_95(rows, ["k"]).first()["ci95"] == pytest.approx(1.96 * 1 / 2)
