"""Hand-computed cases for call scoring."""

import math

import pytest
from pyspark.sql import functions as F

from rillstone.functions import skew, sketches
from rillstone.functions.decay import decayed_sums, score
from rillstone.operators import parsing, voip
from rillstone.plans import voip as plan
from rillstone.sources import fixtures as fx

SCHEMA = "call_id long, caller string, callee string, answer_ts long, duration int, established boolean"
FAST, SLOW = math.log(1 / 0.9672), math.log(1 / 0.9917)
T = 1_704_067_200


def calls(spark, rows):
    return spark.createDataFrame([(i, a, b, T + t, d, e) for i, (a, b, t, d, e) in enumerate(rows)], SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("call_id").collect()]


def close(got, want):
    assert len(got) == len(want) and all(math.isclose(g, w, rel_tol=1e-9) for g, w in zip(got, want))


def test_new_callee_counts_failed_calls_too(spark):
    df = calls(spark, [("a", "b", 0, 5, False), ("a", "b", 1, 5, True), ("b", "a", 2, 5, True), ("a", "c", 3, 5, True)])
    assert column(voip.new_callee(df), "new_callee") == [True, False, True, True]


def test_rates(spark):
    df = calls(spark, [("a", "b", 0, 100, True), ("a", "c", 10, 7, False), ("a", "b", 10, 50, True), ("a", "d", 10, 20, True)])
    features = voip.caller_features(df)
    k, k24 = 0.9672**10, 0.9917**10
    close(column(features, "ecr"), [FAST, FAST * (k + 1), FAST * (k + 2)])
    close(column(features, "ecr24"), [SLOW, SLOW * (k24 + 1), SLOW * (k24 + 2)])
    new = features.filter("new_callee")
    close(column(new, "encr"), [FAST, FAST * (k + 1)])
    close(column(new, "ct24"), [SLOW * 100, SLOW * (100 * k24 + 20)])
    assert features.filter("not new_callee and (encr is not null or ct24 is not null)").count() == 0


def test_late_calls_count_by_answer_time(spark):
    df = calls(spark, [("a", "b", 10, 1, True), ("a", "c", 0, 1, True)])
    close(column(voip.ecr(df), "ecr"), [FAST * (1 + 0.9672**10), FAST])


def test_received_rate_is_read_before_the_call_counts(spark):
    df = calls(spark, [("a", "b", 0, 1, True), ("b", "a", 0, 1, True), ("b", "c", 5, 1, False), ("a", "b", 5, 1, True), ("b", "a", 5, 1, True)])
    k = 0.9672**5
    close(column(voip.rcr(df), "rcr"), [0.0, FAST, FAST * k, FAST * (k + 1)])


def test_call_to_oneself(spark):
    df = calls(spark, [("a", "a", 0, 1, True), ("a", "b", 0, 1, True)])
    close(column(voip.rcr(df), "rcr"), [0.0, FAST])
    close(column(voip.rcr(df, "as_run"), "rcr"), [2 * FAST])


def test_first_call_ever_is_suspicious(spark):
    df = calls(spark, [("a", "b", 0, 300, True)])
    row = plan.default(df).first()
    assert (row["fofir"], row["url"]) == (1.0, 1.0)
    assert math.isclose(row["acd"], 0.1) and math.isclose(row["score"], 2 + 3 + 0.3)


def test_failed_calls_move_the_global_average_only(spark):
    df = calls(spark, [("a", "b", 0, 300, True), ("a", "b", 1, 9000, False), ("a", "c", 2, 300, True)])
    averages = column(voip.global_acd(df), "global_acd")
    assert averages[0] == 300 and averages[1] > 300.2
    assert plan.default(df).count() == 2


def test_entry_without_a_number_stays_open(spark):
    """The first call has an acd of 0 / 0, so the second one fills the entry and the messages of the third give its sum."""
    df = calls(spark, [("a", "b", 0, 0, True), ("a", "c", 0, 300, True), ("a", "d", 0, 5, True)])
    spec = {r["call_id"]: r["score"] for r in plan.default(df).collect()}
    ids = sorted(r["call_id"] for r in df.collect())
    assert sorted(spec) == ids[1:]
    shown = [(r["call_id"], r["score"]) for r in plan.default(df, "as_run").orderBy("call_id").collect()]
    assert shown == [(i, 0.0) for i in ids[:2] for _ in range(3)] + [(ids[2], spec[ids[1]])] * 3 and spec[ids[1]] > 0


def test_no_talk_and_no_average_gives_no_score(spark):
    df = calls(spark, [("a", "b", 0, 0, True)])
    assert math.isnan(voip.acd(voip.caller_features(df), voip.global_acd(df)).first()["acd"])
    assert plan.default(df).count() == 0


def test_score_function(spark):
    values = [-1.0, 0.0, 5.0, 10.0, 99.0, float("inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(score(F.col("x"), 10.0)).collect()]
    assert got[:6] == [0.0, 0.0, 0.5, 1.0, 1.0, 1.0] and math.isnan(got[6])


def test_invariants_and_variants(spark, tiny):
    df = fx.calls(spark, tiny)
    features = voip.caller_features(df)
    established, new = features.count(), features.filter("new_callee").count()
    messages = {r["source"]: r["count"] for r in plan.default(df, "as_run").groupBy("source").count().collect()}
    assert messages == {"fofir": established, "url": new, "acd": new}
    scored = plan.default(df)
    assert scored.filter("score < 0 or score > 8 or fofir > 1 or url > 1 or acd > 1").count() == 0
    columns = ["fofir", "url", "acd", "score"]
    want = [tuple(r) for r in scored.orderBy("call_id").select("call_id", *columns).collect()]
    for variant in (plan.reordering, plan.forwarding):
        got = [tuple(r) for r in variant(df).orderBy("call_id").select("call_id", *columns).collect()]
        assert [g[0] for g in got] == [w[0] for w in want]
        for g, w in zip(got, want):
            close(g[1:], w[1:])


def test_carried_rate_is_missing_on_failed_calls(spark):
    df = calls(spark, [("a", "b", 0, 1, True), ("a", "c", 0, 1, False)])
    assert column(plan.carried_ecr(df), "ecr")[1] is None


def test_parse_calls(spark):
    lines = [
        "10000000001,10000000002,2021-03-01T10:00:00.000+01:00,120,true",
        "1,2,2021-03-01T10:00:00.500Z,0,TRUE",
        "1,2,2021-03-01T10:00:00.000+00:00,3,yes",
    ]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "call_id long, line string")
    got = [tuple(r) for r in parsing.parse_calls(df).orderBy("call_id").collect()]
    assert got[0] == (0, "10000000001", "10000000002", 1614589200, 120, True)
    assert [(g[3], g[5]) for g in got[1:]] == [(1614592800, True), (1614592800, False)]
    bad = df.union(spark.createDataFrame([(3, "1,2,yesterday,3,true"), (4, "1")], df.schema))
    assert parsing.parse_calls(bad, mode="permissive").count() == 3
    with pytest.raises(Exception):
        parsing.parse_calls(bad).collect()


def test_a_known_key_is_never_new_again(spark):
    n = 3000
    rows = [(i, i % 1000, "x") for i in range(n)]
    df = spark.createDataFrame(rows, "seq long, a int, b string")
    got = {r["seq"]: r["new"] for r in sketches.probably_new(df, ["a", "b"], "seq").collect()}
    assert len(got) == n and not any(got[i] for i in range(1000, n))
    assert sum(got[i] for i in range(1000)) > 950, "few keys are taken for known"


def test_filter_is_the_bit_table(spark):
    """The relational form answers as a table of bits that is filled row by row."""
    rows = [(i, f"k{(i * i) % 211}") for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, a string").repartition(3)
    width = 2 * len({k for _, k in rows})
    places = {r["a"]: r["s"] for r in df.select("a", sketches.slots(["a"], 3, width).alias("s")).collect()}
    bits, want = [False] * width, {}
    for seq, key in rows:
        want[seq] = not all(bits[s] for s in places[key])
        for s in places[key]:
            bits[s] = True
    got = {r["seq"]: r["new"] for r in sketches.probably_new(df, ["a"], "seq", bits_per_key=2, hashes=3).collect()}
    assert got == want and not all(want[min(s for s, k in rows if k == key)] for key in places), "some answers are wrong by design"


def test_sketched_rate_is_above_and_near_the_exact_one(spark, tiny):
    one = fx.calls(spark, tiny).withColumn("_one", F.lit(1.0))
    got = {r["call_id"]: r["s"] for r in sketches.sketched_sums(one, ["caller"], "answer_ts", "call_id", "s", "_one", voip.BETA).collect()}
    exact = decayed_sums(one, ["caller"], "answer_ts", "call_id", {"s": ("_one", voip.BETA)})
    want = {r["call_id"]: r["s"] for r in exact.collect()}
    assert got.keys() == want.keys() and all(got[k] >= want[k] - 1e-12 for k in want)
    assert sum(got[k] - want[k] < 1e-9 for k in want) > 0.95 * len(want)


def test_tasks_follow_the_rows(spark, tiny, monkeypatch):
    """Rows are dealt by their number, not by their bytes, and the scores stay as they are."""
    records = fx.calls(spark, tiny)
    want = {tuple(r) for r in plan.forwarding(records).select("call_id", F.round("score", 9)).collect()}
    monkeypatch.setattr(skew, "TASK_ROWS", 40)
    n = -(-records.count() // 40)
    assert voip.caller_features(records).rdd.getNumPartitions() == n > 8
    assert voip.global_acd(records).rdd.getNumPartitions() == n
    scored = plan.forwarding(records).select("call_id", F.round("score", 9))
    assert {tuple(r) for r in scored.collect()} == want != set()
