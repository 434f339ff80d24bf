"""The call-scoring job in its three wirings. All give the same scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.functions.skew import DEFAULT_SKEW, FIND, Hot, Skew, find_hot, spread, tasks_for
from rillstone.operators import voip

# Message tags of the original job.
SOURCES = {"ct24": 0, "global_acd": 1, "ecr24": 2, "rcr": 3, "ecr": 4, "encr": 5, "fofir": 6, "acd": 7, "url": 8}


def default(calls: DataFrame, semantics: str = "spec", skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Ratios and the final score.

    The caller's rates come as one row per call, so the three ratios need two joins on the unique call id
    between them: the rate received and the global average. as_run: see :func:`voip.scores`.
    """
    features = voip.caller_features(calls, skew)
    if semantics != "spec":
        fofirs = voip.fofir(features, voip.rcr(calls, skew=skew))
        return voip.scores(fofirs, voip.url(features), voip.acd(features, voip.global_acd(calls)), semantics)
    received = voip.rcr(calls, skew=skew).select("call_id", "rcr")
    new = features.filter("new_callee")
    return _rated(new.join(received, "call_id").join(voip.global_acd(calls), "call_id"))


def carried_ecr(calls: DataFrame, skew: Skew = DEFAULT_SKEW, hot: Hot = FIND) -> DataFrame:
    """Every call with the caller's rate computed up front; null on calls that were not established."""
    rated = voip.ecr(calls, skew, hot)
    others = calls.filter("not established").withColumn("ecr", F.lit(None).cast("double"))
    return rated.unionByName(others.select(rated.columns))


def reordering(calls: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """The caller's rate is computed first and travels with the call through the other operators."""
    hot = find_hot(calls, ["caller"], skew)
    features = voip.caller_features(carried_ecr(calls, skew, hot), skew, ["ecr24", "encr", "ct24"], hot)
    received = voip.rcr(calls, skew=skew).select("call_id", "rcr")
    new = features.filter("new_callee")
    return _rated(new.join(received, "call_id").join(voip.global_acd(calls), "call_id"))


def forwarding(calls: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Rates as tagged messages on one stream, collected per call instead of joined."""
    features = voip.caller_features(calls, skew)
    rates = ["ecr", "ecr24", "encr", "ct24"]
    tagged = features.filter("new_callee").select(
        "call_id", F.inline(F.array(*[F.struct(F.lit(SOURCES[r]).alias("source"), F.col(r).alias("rate")) for r in rates]))
    )
    received = voip.rcr(calls, skew=skew).select("call_id", F.lit(SOURCES["rcr"]).alias("source"), F.col("rcr").alias("rate"))
    averages = voip.global_acd(calls).select(
        "call_id", F.lit(SOURCES["global_acd"]).alias("source"), F.col("global_acd").alias("rate")
    )
    names = [*rates, "rcr", "global_acd"]
    messages = spread(tagged.unionByName(received).unionByName(averages), ["call_id"], tasks_for(2 * calls.count()))
    collected = (
        messages.groupBy("call_id")
        .agg(*[F.max(F.when(F.col("source") == SOURCES[n], F.col("rate"))).alias(n) for n in names])
        .dropna(subset=names)
    )
    who = calls.select("call_id", "caller", "answer_ts")
    return _rated(collected.join(who, "call_id"))


def _rated(rows: DataFrame) -> DataFrame:
    """Ratios and score of rows that hold all rates of a call."""
    ratios = rows.select(
        "call_id",
        "caller",
        "answer_ts",
        voip.fofir_score(F.col("ecr"), F.col("rcr")).alias("fofir"),
        voip.url_score(F.col("encr"), F.col("ecr")).alias("url"),
        voip.acd_score(F.col("ct24"), F.col("ecr24"), F.col("global_acd")).alias("acd"),
    )
    value = voip.total_score(F.col("fofir"), F.col("url"), F.col("acd"))
    return ratios.withColumn("score", value).filter(~F.isnan("score"))
