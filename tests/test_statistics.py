"""Statistics, filter chains and observation."""

import json
import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rillstone.operators import statistics as st
from rillstone.operators import synthetic as syn


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def samples(spark):
    data = [(0, 10, 7), (1, 10, 8), (2, 13, -1), (3, 14, 20), (4, 14, 21)]
    return spark.createDataFrame(data, "seq long, second long, v long")


def test_per_second(samples):
    assert rows(st.count_per_second(samples, "second"), "second", "count") == [(10, 2), (11, 0), (12, 0), (13, 1), (14, 2)]
    assert rows(st.count_per_second(samples, "second", amount=F.col("v")), "count") == [(-1,), (0,), (0,), (15,), (41,)]
    averages = rows(st.average_per_second(samples, "second", "v"), "second", "average")
    assert averages == [(10, 7), (11, -1), (12, -1), (13, -1), (14, 20)]


def test_gauge(samples):
    assert rows(st.gauge(samples, "second", "v", 1), "report", "gauge") == [(10, 7.5), (11, -1.0), (12, -1.0), (13, -1.0), (14, 20.5)]


def test_every_nth(spark):
    df = spark.range(250).select(F.col("id").alias("seq"))
    assert rows(st.every_nth(df, [], "seq"), "seq") == [(99,), (199,)]
    with pytest.raises(ValueError):
        st.every_nth(df, [], "seq", 0)


@pytest.mark.parametrize("rate", [0, 1, 3])
def test_rate_limited(spark, rate):
    times = [0.0, 0.0, 0.1, 0.4, 0.4, 0.9, 2.5, 2.5, 2.5, 2.5, 2.6, 2.6, 9.0]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(times)], "seq long, k string, at double")
    counter, want = 0, []
    for i, t in enumerate(times):
        if rate == 0 or counter <= rate * t:
            counter += 1
            want.append((i,))
    assert rows(st.rate_limited(df, ["k"], "seq", "at", rate), "seq") == want


@pytest.mark.parametrize("values, want", [([5.0], [5.0] * 5), ([1.0, 3.0], [1.0, 1.0, 2.0, 3.0, 3.0])])
def test_summary_of_few(spark, values, want):
    df = spark.createDataFrame([("m", v) for v in values], "name string, v double")
    out = st.summary(df, "name", "v")
    row = out.first()
    assert [row[p] for p in st.SUMMARY] == want and row["samples"] == row["total"] == len(values)
    text = json.loads(st.summary_json(out, "name").first()["json"])
    assert list(text) == ["name", "samples", "total", "mean", "0", "5", "25", "50", "75", "95", "100"]
    assert text["50"] == want[2]


def test_throughput(samples):
    assert rows(st.throughput(samples, "second")) == [(1,)]
    assert rows(st.mean_rate(samples, "second")) == [(10, 0), (13, 1), (14, 1)]
    assert rows(st.throughput(samples.filter("second = 10"), "second")) == [(0,)]


def test_observation(samples):
    seen = Observation("flow")
    passed = samples.observe(seen, F.count(F.lit(1)).alias("rows"))
    assert passed.count() == 5 and seen.get["rows"] == 5
    assert st.observed(samples, "named", "second").count() == 5


def test_latency(spark):
    df = spark.createDataFrame([(100, 90)], "ts_ms long, ts_ext_ms long")
    assert rows(st.latency(df, F.lit(130)), "latency", "end_latency") == [(30, 40)]


def test_chains(spark):
    df = spark.range(20_000)
    share = syn.filter_chain(df, "id", [syn.min_selectivity(0.01, 3)] * 3).count() / 20_000
    assert 0.007 < share < 0.013
    drawn = syn.filter_chain(df, "id", [0.5, 0.5], seed=1).count() / 20_000
    assert 0.22 < drawn < 0.28
    assert syn.fan_out(df.limit(10), 4).count() == 40
    table = syn.query_selectivities(4, 3, 0.01, seed=2)
    assert table == syn.query_selectivities(4, 3, 0.01, seed=2)
    low = syn.min_selectivity(0.01, 3)
    assert all(low <= s <= 1 for ops in table for s in ops)
    per_query = {r["query_id"]: r["count"] for r in syn.chains(df, "id", table).groupBy("query_id").count().collect()}
    for q, ops in enumerate(table):
        assert math.isclose(per_query[q] / 20_000, math.prod(ops), abs_tol=0.02)


def test_costs_and_stress(spark):
    assert set(syn.query_costs(50, 100, 2, seed=1)) == {100, 200, 400}
    df = spark.createDataFrame([(1.5, 3)], "f1 double, f2 int")
    assert df.select(syn.stress_value(F.col("f1"), F.col("f2"), 2)).first()[0] == 13.5
    assert df.select(syn.stress_value(F.lit(math.pi), F.lit(999), 400)).first()[0] == math.inf


def test_classes_stay_apart(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 500, "HIGH").otherwise("LOW").alias("class"))
    out = syn.multi_class(df, "id", "class", {"HIGH": [[1.0]], "LOW": [[1.0], [1.0]]})
    got = {(r["class"], r["priority"], r["query_id"]): r["count"] for r in out.groupBy("class", "priority", "query_id").count().collect()}
    assert got == {("HIGH", 3, 0): 500, ("LOW", 1, 0): 500, ("LOW", 1, 1): 500}


def test_a_gap_longer_than_a_stretch(spark):
    ends = spark.createDataFrame([("k", 5), ("k", 5 + 3 * st.GAP_ROWS)], "name string, second long")
    filled = st.count_per_second(ends, "second", ["name"])
    assert filled.count() == 3 * st.GAP_ROWS + 1
    assert filled.agg(F.sum("count"), F.min("second"), F.max("second")).first() == (2, 5, 5 + 3 * st.GAP_ROWS)
