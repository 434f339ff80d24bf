"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions.decay import decayed_sums, score
from rillstone.functions.sketches import probably_new, sketched_sums
from rillstone.operators import experiments as ex
from rillstone.operators import linear_road as lr
from rillstone.operators import parsing, synthetic, voip
from rillstone.operators import statistics as st
from rillstone.plans import experiments as ex_plan
from rillstone.plans import linear_road as lr_plan
from rillstone.plans import voip as vs_plan
from rillstone.sources import fixtures as fx
from rillstone.sources import lines as src

Query = Callable[[SparkSession, str], DataFrame]


def rounded(column: str, digits: int = 6) -> Column:
    """Rounding by plain arithmetic, which is the same in every engine."""
    scale = float(10**digits)
    return (F.floor(F.col(column) * scale + 0.5).cast("double") / scale).alias(column)


def _lr(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(fx.positions(spark, sf_dir))


def _vs(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(fx.calls(spark, sf_dir))


def _lav_as_run(pos: DataFrame) -> DataFrame:
    return lr.last_average_speed(lr.average_speed(pos, "as_run"), "as_run")


# The statements fix tolls as INT: a larger one is an error here as it is there, and a long in the plans.
TOLL = "cast(toll as int) as toll"


def toll_rows(tolls: DataFrame, *more: str) -> DataFrame:
    return tolls.select("seq", "vid", "speed", F.expr(TOLL), *more)


def _toll(pos: DataFrame) -> DataFrame:
    minute = lr.minute_of("pos.time").alias("minute")
    return toll_rows(lr_plan.tolls(pos), minute, "pos.direction", "pos.segment")


LINEAR_ROAD: dict[str, Query] = {
    "lr_parse_positions": lambda s, d: parsing.parse_positions(fx.position_lines(s, d)),
    "lr_minute": _lr(lambda p: p.select("seq", lr.minute_of("time").alias("minute"))),
    "lr_exit_lane": _lr(lambda p: p.filter(lr.on_exit_lane()).select("seq", "vid", "lane")),
    "lr_average_speed": _lr(lr.average_speed),
    "lr_average_speed_as_run": _lr(lambda p: lr.average_speed(p, "as_run")),
    "lr_lav": _lr(lambda p: lr.last_average_speed(lr.average_speed(p))),
    "lr_lav_running": _lr(lr_plan.running_lav),
    "lr_lav_as_run": _lr(_lav_as_run),
    "lr_count_vehicles": _lr(lr.count_vehicles),
    "lr_count_progress": _lr(lr.count_progress),
    "lr_count_as_run": _lr(lambda p: lr.count_vehicles(p, "as_run")),
    "lr_toll_las_as_run": _lr(lambda p: lr.toll_notification_las(_lav_as_run(p))),
    "lr_toll_cv_as_run": _lr(lambda p: lr.toll_notification_cv(lr.count_vehicles(p, "as_run"))),
    "lr_toll_pos_as_run": _lr(lambda p: lr.toll_notification_pos(p, semantics="as_run")),
    "lr_toll_las": _lr(lambda p: lr.toll_notification_las(lr_plan.running_lav(p), "spec")),
    "lr_toll_cv": _lr(lambda p: lr.toll_notification_cv(lr.count_vehicles(p).unionByName(lr.count_progress(p)), "spec")),
    "lr_toll": _lr(_toll),
    "lr_toll_accidents": lambda s, d: toll_rows(lr_plan.tolls(fx.positions(s, d), fx.accidents(s, d))),
    "lr_accident_block": lambda s, d: lr.accident_free(fx.positions(s, d), fx.accidents(s, d)).select("seq", "vid"),
    "lr_segment_changes": _lr(lambda p: lr.segment_changes(p).select("seq", "vid", "minute", "segment")),
    "lr_last_toll": _lr(lambda p: lr.last_toll(lr_plan.tolls(p), p).selectExpr("vid", "seq", TOLL)),
    "lr_as_run_total": _lr(lambda p: lr_plan.job_as_run(p).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))),
}


def _scored(df: DataFrame) -> DataFrame:
    return df.select("call_id", "caller", "answer_ts", *[rounded(c) for c in ("fofir", "url", "acd", "score")])


def _rate(df: DataFrame, name: str) -> DataFrame:
    return df.select("call_id", "caller", rounded(name))


def _decayed_callee(calls: DataFrame) -> DataFrame:
    rated = decayed_sums(calls, ["callee"], "answer_ts", "call_id", {"w": ("duration", voip.BETA)})
    return rated.select("call_id", "callee", rounded("w"))


def _slow_rates(calls: DataFrame) -> DataFrame:
    """Rates of slow and of fast decay side by side; the slow ones remember the whole stream."""
    features = {"day": ("duration", 0.99999), "hour": ("duration", 0.9999), "minute": ("duration", voip.BETA)}
    rated = decayed_sums(calls, ["callee"], "answer_ts", "call_id", features)
    return rated.select("call_id", "callee", *[rounded(name) for name in features])


def _acd(calls: DataFrame) -> DataFrame:
    return _rate(voip.acd(voip.caller_features(calls, names=["ecr24", "ct24"]), voip.global_acd(calls)), "acd")


def _fofir(calls: DataFrame) -> DataFrame:
    return _rate(voip.fofir(voip.ecr(calls), voip.rcr(calls)), "fofir")


def _score_messages(calls: DataFrame) -> DataFrame:
    return vs_plan.default(calls, "as_run").select("call_id", "source", rounded("score"))


def _ecr_sketch(calls: DataFrame) -> DataFrame:
    one = calls.filter("established").withColumn("_one", F.lit(1))
    rated = sketched_sums(one, ["caller"], "answer_ts", "call_id", "ecr", "_one", voip.BETA)
    return _rate(rated, "ecr")


def _new_callee_bloom(calls: DataFrame) -> DataFrame:
    return probably_new(calls, ["caller", "callee"], "call_id", "new_callee").select("call_id", "caller", "callee", "new_callee")


VOIP: dict[str, Query] = {
    "vs_new_callee_bloom": _vs(_new_callee_bloom),
    "vs_ecr_sketch": _vs(_ecr_sketch),
    "vs_parse_cdrs": lambda s, d: parsing.parse_calls(fx.call_lines(s, d)),
    "vs_new_callee": _vs(lambda c: voip.new_callee(c).select("call_id", "caller", "callee", "new_callee")),
    "vs_pre_rcr": _vs(lambda c: voip.pre_rcr(c).select("call_id", "role", "key", "answer_ts")),
    "vs_global_acd": _vs(lambda c: voip.global_acd(c).select("call_id", rounded("global_acd", 4))),
    "vs_decayed_rate": _vs(_decayed_callee),
    "vs_slow_rates": _vs(_slow_rates),
    "vs_ecr": _vs(lambda c: _rate(voip.ecr(c), "ecr")),
    "vs_ecr24": _vs(lambda c: _rate(voip.ecr24(c), "ecr24")),
    "vs_encr": _vs(lambda c: _rate(voip.encr(c), "encr")),
    "vs_ct24": _vs(lambda c: _rate(voip.ct24(c), "ct24")),
    "vs_rcr": _vs(lambda c: _rate(voip.rcr(c), "rcr")),
    "vs_score_fn": _vs(lambda c: c.select("call_id", score(F.col("duration").cast("double"), 900.0).alias("score"))),
    "vs_acd": _vs(_acd),
    "vs_fofir": _vs(_fofir),
    "vs_url": _vs(lambda c: _rate(voip.url(voip.caller_features(c, names=["ecr", "encr"])), "url")),
    "vs_reordering_ecr": _vs(lambda c: _rate(vs_plan.carried_ecr(c), "ecr")),
    "vs_score": _vs(lambda c: _scored(vs_plan.default(c))),
    "vs_variant_reordering": _vs(lambda c: _scored(vs_plan.reordering(c))),
    "vs_variant_forwarding": _vs(lambda c: _scored(vs_plan.forwarding(c))),
    "vs_score_top": _vs(lambda c: voip.top_scores(_scored(vs_plan.default(c)))),
    "vs_score_as_run": _vs(_score_messages),
}


def _ev(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(fx.events(spark, sf_dir))


def _ms(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(fx.metrics(spark, sf_dir))


def _recorded(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("name"), (F.col("sec") / 60).cast("long").alias("second"),
        F.floor(F.col("value") * 100).cast("double").alias("value"),
    )


def _latency(ev: DataFrame) -> DataFrame:
    sent = ev.select(
        F.col("event_id").alias("seq"),
        (F.col("sec") * 1000).alias("ts_ms"),
        (F.col("sec") * 1000 - F.col("k")).alias("ts_ext_ms"),
        (F.col("sec") * 1000 + F.floor(F.col("value"))).alias("now_ms"),
    )
    return st.latency(sent, "now_ms").select("seq", "latency", "end_latency")


def _metric_line(ev: DataFrame) -> DataFrame:
    counts = st.count_per_second(_recorded(ev), "second", ["name"])
    return st.metric_line(counts, F.concat(F.lit("source."), F.col("name"), F.lit(".rate")), "count", "second")


STATISTICS: dict[str, Query] = {
    "met_count_per_second": _ev(lambda e: st.count_per_second(_recorded(e), "second", ["name"])),
    "met_avg_per_second": _ev(lambda e: st.average_per_second(_recorded(e), "second", "value", ["name"])),
    "met_gauge": _ev(lambda e: st.gauge(_recorded(e), "second", "value", 10, ["name"])),
    "met_every_nth": _ev(lambda e: st.every_nth(_recorded(e), ["name"], "seq").select("seq", "name", "second", "value")),
    "met_rate_limited": _ev(lambda e: st.rate_limited(_recorded(e).withColumn("hour", F.expr("second div 60")), ["name"], "seq", "hour", 1).select("seq", "name")),
    "met_summary": _ev(lambda e: st.summary(st.every_nth(_recorded(e), ["name"], "seq", 3), "name", "value", _recorded(e))),
    "met_latency": _ev(_latency),
    "met_throughput": _ev(lambda e: st.throughput(e.withColumn("second", F.expr("sec div 2400")), "second")),
    "met_mean_rate": _ev(lambda e: st.mean_rate(e.withColumn("second", F.expr("sec div 2400")), "second")),
    "met_metric_line": _ev(_metric_line),
    "met_ewma": _ev(
        lambda e: st.arrival_average(_recorded(e), ["name"], "seq", "second").select("seq", "name", rounded("average_arrival", 4))
    ),
}

# Names in place of the measured parameters, so that every operator finds the ones it works on.
CPU_NAMES = {"latency": "cpu", "throughput": "graphite-cpu", "sink-throughput": "scheduler-cpu"}
ORDER = ["OS", "CUSTOM"]
RATES = [1000, 2000, 3000, 4000, 5000]
TWO_LEVEL = ["parameter", "variant", "rep", "rate"]


def _graphite(ev: DataFrame) -> DataFrame:
    point = "'[', if(k % 10 = 0, 'null', cast(k as string)), ',', cast(sec as string), ']'"
    json = ev.selectExpr(
        "event_id as seq",
        f"concat('[{{\"target\":\"Storm.node', user_id % 4, '.', event_type, '\",\"datapoints\":[', {point}, ',[1.5,', sec + 1, ']]}}]') as json",
    )
    return ex.graphite_flatten(json)


def _alias(ms: DataFrame) -> DataFrame:
    path = F.concat_ws(".", F.col("node"), F.col("parameter"), F.col("variant"), F.lit("value"))
    return ms.select("seq", ex.alias_by_node(path, 1, 3).alias("alias"))


def _dimensions(ms: DataFrame) -> DataFrame:
    coded = ms.withColumn("variant", F.concat_ws(".", "variant", "rate", F.col("rep").cast("string")))
    return ex.variant_columns(coded.select("seq", "variant"), "scheduler.load.parallelism").select(
        "seq", "scheduler", "load", "parallelism"
    )


def _raw(ms: DataFrame) -> DataFrame:
    raw = F.when((F.col("parameter") == "latency") & (F.col("rep") == 0), "latency-raw").otherwise(F.col("parameter"))
    return ex.prefer_raw(ms.withColumn("parameter", raw)).select("seq", "parameter")


def _units(ms: DataFrame) -> DataFrame:
    node = F.when(F.col("rep") == 2, F.concat(F.lit("taskmanager."), F.col("rate").cast("string"))).otherwise(F.col("node"))
    shifted = ms.withColumns({"node": node, "value": F.col("value") - 300})
    return ex.to_units(ex.per_second(shifted, ["CUSTOM-FCFS"])).select("seq", "parameter", "spe", "value")


def _overview(ms: DataFrame) -> DataFrame:
    raw = F.when((F.col("parameter") == "latency") & (F.col("rep") == 0), "latency-raw").otherwise(F.col("parameter"))
    ready = ex_plan.prepared(ms.withColumn("parameter", raw), ["CUSTOM-FCFS"])
    return ex_plan.overview(ready).select(*TWO_LEVEL, rounded("value", 4))


def _percentiles(ms: DataFrame) -> DataFrame:
    sampled = ms.withColumn("parameter", F.concat("parameter", F.lit("-sampled")))
    return ex.latency_percentiles(sampled, "latency-sampled").select(
        "experiment", "rate", "variant", "parameter", "rep", "node", "t", rounded("value", 4)
    )


def _spe(ms: DataFrame) -> DataFrame:
    spe = ex.to_units(ms.withColumn("node", F.when(F.col("rep") == 2, "taskmanager.a").otherwise(F.col("node"))))
    out = ex.two_level(spe.withColumn("value", F.col("value") * 1), "throughput", spe=True)
    return out.select("parameter", "variant", "rep", "spe", "rate", rounded("value", 4))


def _confidence(ms: DataFrame) -> DataFrame:
    return ex.confidence_95(ex.get(ms, parameter="latency"), ["variant", "rate"]).select(
        "variant", "rate", rounded("mean", 4), rounded("ci95", 4)
    )


def _total_cpu(ms: DataFrame) -> DataFrame:
    renamed = F.col("parameter")
    for old, new in CPU_NAMES.items():
        renamed = F.when(F.col("parameter") == old, new).otherwise(renamed)
    return ex.total_cpu(ms.withColumn("parameter", renamed)).select("variant", "rep", "t", "rate", "node", "parameter", "value")


def _boxes(ms: DataFrame) -> DataFrame:
    node = F.when(F.col("seq") % 50 == 0, "Storm.spout").when(F.col("seq") % 50 == 1, "system").otherwise(
        F.concat(F.col("node"), F.lit("-"), (F.col("seq") % 7).cast("string"))
    )
    out = ex.queue_boxes(ms.withColumn("node", node))
    return out.select("rate", "variant", *[rounded(c, 4) for c in ("q1", "median", "q3", "low", "high")], "outliers")


EXPERIMENTS: dict[str, Query] = {
    "ana_graphite_flatten": _ev(_graphite),
    "ana_alias_by_node": _ms(_alias),
    "ana_rebase_time": _ms(lambda m: ex.rebase_time(m).select("seq", "t")),
    "ana_trim": _ms(lambda m: ex.trim(ex.rebase_time(m)).select("seq", "t", "value")),
    "ana_variant_cols": _ms(_dimensions),
    "ana_prefer_raw": _ms(_raw),
    "ana_units": _ms(_units),
    "ana_overview": _ms(_overview),
    "ana_latency_percentiles": _ms(_percentiles),
    "ana_two_level_mean": _ms(lambda m: ex.two_level(m, "latency").select(*TWO_LEVEL, rounded("value", 4))),
    "ana_two_level_sum": _ms(lambda m: ex.two_level_sum(ex.trim(m), "throughput").select(*TWO_LEVEL, rounded("value", 4))),
    "ana_two_level_spe": _ms(_spe),
    "ana_max_latency": _ms(lambda m: ex.max_node(m, "latency", "max-latency").select(*TWO_LEVEL, "value")),
    "ana_queue_spread": _ms(lambda m: ex.node_spread(m, "input-queue").select(*TWO_LEVEL, rounded("value", 6))),
    "ana_ci95": _ms(_confidence),
    "ana_weighted_latency": _ms(
        lambda m: ex.weighted_latency(m).select("variant", "rep", "t", "rate", "node", "parameter", rounded("value", 4))
    ),
    "ana_total_cpu": _ms(_total_cpu),
    "ana_pivot": _ms(lambda m: ex.pivot_table(m, "throughput", RATES)),
    "ana_relative": _ms(lambda m: ex.relative_table(m, "throughput")),
    "ana_rolling": _ms(lambda m: ex.rolling_mean(m).select("parameter", "variant", "rate", "t", rounded("value", 4))),
    "ana_variant_order": _ms(lambda m: ex.variant_order(ex.rate_range(m, 2000, 4000), ORDER)),
    "ana_queue_box": _ms(_boxes),
    "ana_policy": _ms(lambda m: ex.scheduler_policy(m).select("seq", "scheduler", "policy")),
    "ana_run_summary": _ms(lambda m: ex.run_summary(m)),
}

CHAIN_QUERIES, CHAIN_LENGTH, CHAIN_SELECTIVITY = 20, 3, 0.01
EQUAL = synthetic.min_selectivity(CHAIN_SELECTIVITY, CHAIN_LENGTH)
VARIED = synthetic.query_selectivities(CHAIN_QUERIES, CHAIN_LENGTH, CHAIN_SELECTIVITY, variance=10, seed=7)
CLASSES = {
    synthetic.HIGH: synthetic.query_selectivities(5, CHAIN_LENGTH, CHAIN_SELECTIVITY, seed=11),
    synthetic.LOW: synthetic.query_selectivities(5, CHAIN_LENGTH, CHAIN_SELECTIVITY, seed=13),
}


def _count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def _classes(ev: DataFrame) -> DataFrame:
    classed = ev.withColumn("class", F.when(F.col("event_type") == "error", synthetic.HIGH).otherwise(synthetic.LOW))
    return _count_by(synthetic.multi_class(classed, "event_id", "class", CLASSES), "class", "priority", "query_id")


def _stress(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", synthetic.stress_value(F.pi(), F.col("k"), 5).alias("f1"))


SYNTHETIC: dict[str, Query] = {
    "syn_fanout": _ev(lambda e: synthetic.fan_out(e.select("event_id"), 20)),
    "syn_filter_chain": _ev(lambda e: synthetic.filter_chain(e, "event_id", [EQUAL] * CHAIN_LENGTH).select("event_id")),
    "syn_chain_counts": _ev(
        lambda e: _count_by(synthetic.chains(e, "event_id", [[EQUAL] * CHAIN_LENGTH] * CHAIN_QUERIES), "query_id")
    ),
    "syn_selectivity": _ev(lambda e: _count_by(synthetic.chains(e, "event_id", VARIED), "query_id")),
    "syn_multiclass": _ev(_classes),
    "syn_stress_value": _ev(_stress),
}

REPLAY_RATE = 4000


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.replay(fx.position_lines(spark, sf_dir), "seq", REPLAY_RATE, cycles=3)


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.position_lines(spark, sf_dir)
    return lines.select("seq", src.encode(F.col("seq") * 10 + 1_700_000_000_000).alias("value"))


SOURCES: dict[str, Query] = {
    "src_cyclic_replay": _replayed,
    "src_encode_envelope": _encoded,
    "src_decode_envelope": lambda s, d: src.decode(_encoded(s, d), now_ms=F.lit(1_800_000_000_000)),
}


def queries() -> dict[str, Query]:
    return {**LINEAR_ROAD, **VOIP, **STATISTICS, **EXPERIMENTS, **SYNTHETIC, **SOURCES}
