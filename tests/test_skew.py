"""Splitting hot keys does not change results, and one key with half of all rows does not form one task."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillstone.functions import skew as sk
from rillstone.functions.decay import decayed_sums, global_average, keyed_average
from rillstone.functions.quantiles import exact_quantiles
from rillstone.operators import linear_road as lr
from rillstone.operators import statistics as st
from rillstone.operators import voip
from rillstone.plans import linear_road as lr_plan
from rillstone.plans import voip as vs_plan
from rillstone.sources import fixtures as fx

PLAIN = sk.Skew(min_rows=10**9)
SPLIT = sk.Skew(min_rows=15, max_keys=1000, block_rows=97)


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def same(a, b):
    a, b = rows(a), rows(b)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-12))


LR = {
    "average_speed": lambda p, s: lr.average_speed(p, skew=s),
    "as_run": lambda p, s: lr.average_speed(p, "as_run", s),
    "count_as_run": lambda p, s: lr.count_vehicles(p, "as_run", skew=s),
    "changes": lr.segment_changes,
    "running_lav": lr_plan.running_lav,
    "tolls": lambda p, s: lr_plan.tolls(p, car_threshold=3, skew=s),
    "every_nth": lambda p, s: st.every_nth(p, ["vid"], "seq", 7, s),
    "rate_limited": lambda p, s: st.rate_limited(p, ["vid"], "seq", "time", 1, s),
    "per_second": lambda p, s: st.count_per_second(p, "time", ["xway"], skew=s),
    "mean_rate": lambda p, s: st.mean_rate(p, "time", ["xway"], s),
}
VS = {
    "new_callee": voip.new_callee,
    "rcr": lambda c, s: voip.rcr(c, skew=s).select("call_id", F.round("rcr", 9)),
    "score": lambda c, s: vs_plan.default(c, skew=s).select("call_id", F.round("score", 9)),
    "variant": lambda c, s: vs_plan.reordering(c, s).select("call_id", F.round("score", 9)),
    "summary": lambda c, s: st.summary(c, "established", "duration", skew=s),
}


@pytest.mark.parametrize("name", LR)
def test_tolling(spark, tiny, name):
    positions = fx.positions(spark, tiny)
    same(LR[name](positions, PLAIN), LR[name](positions, SPLIT))


@pytest.mark.parametrize("name", VS)
def test_calls(spark, tiny, name):
    calls = fx.calls(spark, tiny)
    same(VS[name](calls, PLAIN), VS[name](calls, SPLIT))


def test_hot_keys_are_bounded(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    hot = sk.find_hot(df, ["k"], sk.Skew(min_rows=100, max_keys=3))
    assert hot.count() == 3 and hot.filter("k = 0").count() == 1
    assert sk.find_hot(df, ["k"], PLAIN) is None


def test_half_of_all_calls_from_one_caller(spark):
    """The hot caller's rows are spread over many window partitions, none larger than a block."""
    n = 20_000
    calls = spark.range(n).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 400)).alias("caller"),
        F.floor(F.col("id") / 4).cast("long").alias("t"),
        F.lit(1).alias("q"),
    )
    split = sk.Skew(min_rows=1000, max_keys=10, block_rows=500)
    same(
        decayed_sums(calls, ["caller"], "t", "seq", {"w": ("q", 0.9672)}, PLAIN),
        decayed_sums(calls, ["caller"], "t", "seq", {"w": ("q", 0.9672)}, split),
    )
    hot = calls.filter("caller = 'hot'")
    cells = hot.groupBy("t", F.floor(F.col("seq") / split.block_rows)).count().agg(F.max("count")).first()[0]
    assert cells <= split.block_rows


def test_all_in_one_second(spark):
    """A hot second is cut by sequence number."""
    one = spark.range(3000).select(F.col("id").alias("seq"), F.lit("k").alias("key"), F.lit(100).cast("long").alias("t"), F.lit(2).alias("q"))
    split = sk.Skew(min_rows=10, max_keys=10, block_rows=128)
    out = decayed_sums(one, ["key"], "t", "seq", {"w": ("q", 0.9672)}, split).orderBy("seq").collect()
    step = 2 * math.log(1 / 0.9672)
    assert all(math.isclose(r["w"], step * (r["seq"] + 1), rel_tol=1e-9) for r in out)


def test_decay_against_brute_force(spark):
    draw = random.Random(3)
    data = [(i, draw.choice("aab"), draw.randrange(0, 40_000), draw.randrange(0, 5)) for i in range(400)]
    df = spark.createDataFrame(data, "seq long, key string, t long, q int")
    for skew in (PLAIN, sk.Skew(min_rows=1, max_keys=10, block_rows=16)):
        got = {r["seq"]: r["w"] for r in decayed_sums(df, ["key"], "t", "seq", {"w": ("q", 0.9917)}, skew).collect()}
        for seq, key, t, _ in data:
            want = sum(q * math.log(1 / 0.9917) * 0.9917 ** (t - u) for s, k, u, q in data if k == key and (u, s) <= (t, seq))
            assert math.isclose(got[seq], want, rel_tol=1e-9, abs_tol=1e-12)


def literal_average(values, decay):
    state, out = 0.0, []
    for x in values:
        if state < 10:
            state += x
        elif state == 10:
            state = 1.0
        else:
            state = x * decay + state * (1 - decay)
        out.append(0.0 if state <= 10 else state)
    return out


@pytest.mark.parametrize("head", [[3, 7, 500], [0, 0, 4, 20], [10, 5, 9, 40], [1] * 30 + [50], [300]])
@pytest.mark.parametrize("blocks", [{"block_rows": 32}, {"block_rows": 8, "span": 3}, {}])
def test_global_average(spark, head, blocks):
    draw = random.Random(5)
    values = head + [draw.randrange(20, 900) for _ in range(300)]
    df = spark.createDataFrame([(2 * i + 5, v) for i, v in enumerate(values)], "seq long, x int")
    got = [r["a"] for r in global_average(df, "seq", "x", "a", **blocks).orderBy("seq").collect()]
    want = literal_average(values, 2 / 86401)
    assert all(math.isclose(g, w, rel_tol=1e-9) for g, w in zip(got, want)) and len(got) == len(want)


def test_global_average_of_nothing(spark):
    assert global_average(spark.createDataFrame([], "seq long, x int"), "seq", "x", "a").count() == 0


@pytest.mark.parametrize("blocks", [{"block_rows": 1000}, {"block_rows": 700, "span": 2}])
def test_global_average_that_cools_down(spark, blocks):
    draw = random.Random(8)
    values = [11] + [0] * 6000 + [draw.randrange(0, 3) for _ in range(9000)] + [400] * 10
    df = spark.createDataFrame(list(enumerate(values)), "seq long, x int")
    got = [r["a"] for r in global_average(df, "seq", "x", "a", **blocks).orderBy("seq").collect()]
    want = literal_average(values, 2 / 86401)
    assert sum(w == 0 for w in want) > 100 and len(got) == len(want)
    assert all(math.isclose(g, w, rel_tol=1e-9) for g, w in zip(got, want))


def test_global_average_before_it_is_warm(spark):
    values = [0] * 500 + [5] + [0] * 500 + [1_000_000, 20, 30]
    df = spark.createDataFrame(list(enumerate(values)), "seq long, x int")
    got = [r["a"] for r in global_average(df, "seq", "x", "a", block_rows=50).orderBy("seq").collect()]
    want = literal_average(values, 2 / 86401)
    assert len(got) == len(want) and all(math.isclose(g, w, rel_tol=1e-9) for g, w in zip(got, want))


def test_keyed_average(spark):
    draw = random.Random(6)
    values = [draw.randrange(1, 1000) for _ in range(1500)]
    df = spark.createDataFrame([(i, "r", v) for i, v in enumerate(values)], "seq long, k string, x int")
    state, want = -1.0, []
    for v in values:
        state = v if state < 0 else 0.5 * v + 0.5 * state
        want.append(state)
    got = [r["average"] for r in keyed_average(df, ["k"], "seq", "x").orderBy("seq").collect()]
    assert all(math.isclose(g, w, rel_tol=1e-12) for g, w in zip(got, want)) and len(got) == len(want)


@pytest.mark.parametrize("method", ["linear", "n_plus_1"])
@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_quantiles(spark, method, n):
    draw = random.Random(n)
    values = sorted(draw.choice([7.0, draw.random() * 100]) for _ in range(n))
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "k string, v double")
    probs = {"p5": 0.05, "p50": 0.5, "p99": 0.99}
    for skew in (PLAIN, sk.Skew(min_rows=100, max_keys=10)):
        got = exact_quantiles(df, ["k"], "v", probs, method, skew).first()
        for name, p in probs.items():
            rank = 1 + p * (n - 1) if method == "linear" else max(1.0, min(float(n), p * (n + 1)))
            low = math.floor(rank)
            want = values[low - 1] + (values[min(low, n - 1)] - values[low - 1]) * (rank - low)
            assert math.isclose(got[name], want, rel_tol=1e-12)


def test_checked_broadcast(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    big = spark.range(1000).select((F.col("id") % 10).alias("k"))
    for limit in (100, 5):
        assert big.join(sk.checked_broadcast(small, limit), "k").count() == 1000
    plan = big.join(sk.checked_broadcast(small, 100), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_slow_and_mixed_decay_against_brute_force(spark):
    """History has its weight for as long as the decay says, whatever the other features of the same call are."""
    draw, betas = random.Random(5), [0.5, 0.9672, 0.9999, 0.99999]
    data = [(i, draw.choice("aab"), draw.randrange(0, 400_000), draw.randrange(0, 5)) for i in range(150)]
    df = spark.createDataFrame(data, "seq long, key string, t long, q int")
    features = {f"w{k}": ("q", beta) for k, beta in enumerate(betas)}
    for skew in (PLAIN, sk.Skew(min_rows=1, max_keys=10, block_rows=16)):
        got = {r["seq"]: r for r in decayed_sums(df, ["key"], "t", "seq", features, skew).collect()}
        for seq, key, t, _ in data:
            before = [(u, q) for s, k, u, q in data if k == key and (u, s) <= (t, seq)]
            for k, beta in enumerate(betas):
                want = sum(q * math.log(1 / beta) * beta ** (t - u) for u, q in before)
                assert math.isclose(got[seq][f"w{k}"], want, rel_tol=1e-9, abs_tol=1e-12)


def test_two_calls_far_apart(spark):
    df = spark.createDataFrame([(0, "k", 0, 1), (1, "k", 16_384, 1)], "seq long, key string, t long, q int")
    last = decayed_sums(df, ["key"], "t", "seq", {"w": ("q", 0.9999)}).filter("seq = 1").first()["w"]
    assert math.isclose(last, math.log(1 / 0.9999) * (1 + 0.9999**16_384), rel_tol=1e-9)
