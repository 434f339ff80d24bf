"""Telephone-spam scoring over call detail records.

Call records have the columns ``call_id caller callee answer_ts duration established``; ``call_id`` is the
arrival order and unique. All features of a call are joined on ``call_id``.
"""

from __future__ import annotations

from functools import reduce

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions.decay import decay_hot, decay_plain, decayed_sums, divide, global_average, score
from rillstone.functions.skew import DEFAULT_SKEW, FIND, Hot, Skew, hot_or_find, split_hot, spread, tasks_for

# Fixed values of the benchmark.
BETA = 0.9672
BETA_24 = 0.9917
ACD_UPPER = 10.0
URL_UPPER = 1.0
FOFIR_UPPER = 10.0
ACD_WEIGHT = 3.0
URL_WEIGHT = 3.0
FOFIR_WEIGHT = 2.0

CALL = ["call_id", "caller", "callee", "answer_ts", "duration", "established"]
CALLER_FEATURES = {
    "ecr": ("_one", BETA),
    "ecr24": ("_one", BETA_24),
    "encr": ("_new", BETA),
    "ct24": ("_talk", BETA_24),
}


def _flag_plain(calls: DataFrame) -> DataFrame:
    window = Window.partitionBy("caller", "callee").orderBy("call_id")
    return calls.withColumn("new_callee", F.row_number().over(window) == 1)


def _flag_hot(calls: DataFrame) -> DataFrame:
    """First call of each pair by a partial aggregate, met again on the unique call id."""
    firsts = calls.groupBy("caller", "callee").agg(F.min("call_id").alias("call_id"))
    firsts = firsts.select("call_id", F.lit(True).alias("_first"))
    return calls.join(firsts, "call_id", "left").withColumn("new_callee", F.coalesce("_first", F.lit(False))).drop("_first")


def new_callee(calls: DataFrame, skew: Skew = DEFAULT_SKEW, hot: Hot = FIND) -> DataFrame:
    """Add ``new_callee``: whether this is the first call of the caller to the callee, established or not."""
    ordinary, heavy = split_hot(calls, ["caller"], hot_or_find(calls, ["caller"], skew, hot))
    out = _flag_plain(spread(ordinary, ["caller"], tasks_for(calls.count())))
    return out if heavy is None else out.unionByName(_flag_hot(heavy).select(out.columns))


def caller_features(
    calls: DataFrame, skew: Skew = DEFAULT_SKEW, names: Sequence[str] = tuple(CALLER_FEATURES), hot: Hot = FIND
) -> DataFrame:
    """Established calls with ``new_callee`` and the caller's decayed rates (all four, or ``names``).

    ecr, ecr24: calls; encr: calls to new callees; ct24: seconds of calls to new callees. encr and ct24 are
    null unless this call is to a new callee. Callers of ordinary size need one exchange for all of it.
    """
    features = {n: CALLER_FEATURES[n] for n in names}

    def quantities(rows: DataFrame) -> DataFrame:
        new = F.col("new_callee").cast("int")
        return rows.filter("established").withColumns(
            {"_one": F.lit(1), "_new": new, "_talk": new * F.col("duration")}
        )

    ordinary, heavy = split_hot(calls, ["caller"], hot_or_find(calls, ["caller"], skew, hot))
    dealt = quantities(_flag_plain(spread(ordinary, ["caller"], tasks_for(calls.count()))))
    out = decay_plain(dealt, ["caller"], "answer_ts", "call_id", features)
    if heavy is not None:
        hot = decay_hot(quantities(_flag_hot(heavy)), ["caller"], "answer_ts", "call_id", features, skew)
        out = out.unionByName(hot.select(out.columns))
    only_new = {n: F.when(F.col("new_callee"), F.col(n)) for n in ("encr", "ct24") if n in features}
    return out.withColumns(only_new).drop("_one", "_new", "_talk")


def ecr(calls: DataFrame, skew: Skew = DEFAULT_SKEW, hot: Hot = FIND) -> DataFrame:
    """Rate of established calls by the caller."""
    return _call_rate(calls, "ecr", BETA, skew, hot)


def ecr24(calls: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Rate of established calls by the caller with the slow decay."""
    return _call_rate(calls, "ecr24", BETA_24, skew, FIND)


def _call_rate(calls: DataFrame, name: str, beta: float, skew: Skew, hot: Hot) -> DataFrame:
    one = calls.filter("established").withColumn("_one", F.lit(1))
    return decayed_sums(
        one, ["caller"], "answer_ts", "call_id", {name: ("_one", beta)}, skew, hot, tasks_for(calls.count())
    ).drop("_one")


def encr(calls: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Rate of established calls to new callees by the caller, on such calls."""
    return caller_features(calls, skew, ["encr"]).filter("new_callee")


def ct24(calls: DataFrame, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Decayed talk time of established calls to new callees by the caller, on such calls."""
    return caller_features(calls, skew, ["ct24"]).filter("new_callee")


def pre_rcr(calls: DataFrame) -> DataFrame:
    """Each call twice: keyed by its caller and keyed by its callee."""
    roles = F.array(
        F.struct(F.lit("caller").alias("role"), F.col("caller").alias("key")),
        F.struct(F.lit("callee").alias("role"), F.col("callee").alias("key")),
    )
    return calls.select("*", F.inline(roles))


def rcr(calls: DataFrame, semantics: str = "spec", skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Rate of established calls the caller has received before this call.

    A call is read under its caller and then counted under its callee. as_run: a call to oneself is counted
    twice and not read, because the original tells the two copies apart by their key.
    """
    if semantics not in ("spec", "as_run"):
        raise ValueError(f"unknown semantics: {semantics}")
    established = calls.filter("established").select("call_id", "caller", "callee", "answer_ts")
    both = pre_rcr(established)
    read = F.col("role") == "caller"
    events = both.select(
        F.when(read, F.col("caller")).otherwise(F.col("callee")).alias("number"),
        "answer_ts",
        (F.col("call_id") * 2 + F.when(read, 0).otherwise(1)).alias("_order"),
        "call_id",
        F.when(read, 0).otherwise(1).alias("_add"),
        (F.col("caller") == F.col("callee")).alias("_self"),
    )
    if semantics == "as_run":
        events = events.withColumn("_add", F.when(F.col("_self"), 1).otherwise(F.col("_add")))
    tasks = tasks_for(2 * calls.count())
    rated = decayed_sums(events, ["number"], "answer_ts", "_order", {"rcr": ("_add", BETA)}, skew, tasks=tasks)
    reads = rated.filter("_add = 0")
    return reads.select("call_id", F.col("number").alias("caller"), "answer_ts", "rcr")


def global_acd(calls: DataFrame, **blocks: int) -> DataFrame:
    """Moving average of the duration over all calls, established or not, as of each call."""
    return global_average(calls, "call_id", "duration", "global_acd", tasks=tasks_for(calls.count()), **blocks)


def fofir_score(ecr_rate: Column, rcr_rate: Column) -> Column:
    return score(divide(ecr_rate, rcr_rate), FOFIR_UPPER)


def url_score(encr_rate: Column, ecr_rate: Column) -> Column:
    return score(divide(encr_rate, ecr_rate), URL_UPPER)


def acd_score(talk: Column, ecr24_rate: Column, average: Column) -> Column:
    return score(divide(divide(talk, ecr24_rate), average), ACD_UPPER)


def total_score(fofir: Column, url: Column, acd: Column) -> Column:
    return fofir * FOFIR_WEIGHT + url * URL_WEIGHT + acd * ACD_WEIGHT


def fofir(features: DataFrame, received: DataFrame) -> DataFrame:
    """Calls made relative to calls received, for every established call."""
    joined = features.join(received.select("call_id", "rcr"), "call_id")
    return joined.select("call_id", "caller", "answer_ts", fofir_score(F.col("ecr"), F.col("rcr")).alias("fofir"))


def url(features: DataFrame) -> DataFrame:
    """Share of new callees in the caller's calls, for established calls to a new callee."""
    return features.filter("new_callee").select(
        "call_id", "caller", "answer_ts", url_score(F.col("encr"), F.col("ecr")).alias("url")
    )


def acd(features: DataFrame, averages: DataFrame) -> DataFrame:
    """Average talk time of the caller relative to everyone's, for established calls to a new callee."""
    joined = features.filter("new_callee").join(averages, "call_id")
    value = acd_score(F.col("ct24"), F.col("ecr24"), F.col("global_acd"))
    return joined.select("call_id", "caller", "answer_ts", value.alias("acd"))


def scores(fofirs: DataFrame, urls: DataFrame, acds: DataFrame, semantics: str = "spec") -> DataFrame:
    """Weighted sum of the three features.

    spec: for calls that have all three as numbers. as_run: one row per feature message, in order of calls, and of
    fofir, url, acd within a call. Messages of a caller and second share one entry. While it lacks a feature a message
    is kept in it and gives 0; once it is full it stays as it is, and all later messages give its sum. The first call
    to a new callee whose acd is a number fills it: only such calls have a url and an acd, and NaN leaves it open.
    """
    joined = fofirs.join(urls.select("call_id", "url"), "call_id").join(acds.select("call_id", "acd"), "call_id")
    value = total_score(F.col("fofir"), F.col("url"), F.col("acd"))
    if semantics == "as_run":
        entry = joined.filter(~F.isnan(value)).groupBy("caller", "answer_ts").agg(
            F.min("call_id").alias("_full"), F.min_by(value, F.col("call_id")).alias("_sum")
        )
        parts = [(fofirs, "fofir"), (urls, "url"), (acds, "acd")]
        messages = reduce(
            DataFrame.unionByName, [df.select("call_id", "caller", "answer_ts", F.lit(name).alias("source")) for df, name in parts]
        )
        shown = F.when(F.col("call_id") > F.col("_full"), F.col("_sum")).otherwise(0.0)
        return messages.join(entry, ["caller", "answer_ts"], "left").select("call_id", "caller", "answer_ts", "source", shown.alias("score"))
    if semantics != "spec":
        raise ValueError(f"unknown semantics: {semantics}")
    return joined.select("call_id", "caller", "answer_ts", "fofir", "url", "acd", value.alias("score")).filter(
        ~F.isnan("score")
    )


def top_scores(scored: DataFrame, n: int = 100) -> DataFrame:
    """The highest scores; ties go to the earlier call."""
    return scored.orderBy(F.desc("score"), "call_id").limit(n)
