"""Analysis of repeated experiment runs.

Samples are rows ``experiment variant parameter rate rep node t value``: the value a node reported for a
parameter in second ``t`` of repetition ``rep``. Missing values are null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.functions.quantiles import exact_quantiles
from rillstone.functions.skew import DEFAULT_SKEW, Skew, row_numbers

# Fixed values of the analysis.
WARM_UP_SHARE = 0.3
COOL_DOWN_SHARE = 0.2
ROLLING_ROWS = 30
Z_95 = 1.96
SLOW_REPORT_SECONDS = 30
RAW_PARAMETERS = ["throughput", "sink-throughput", "latency", "end-latency"]
LATENCY_PARAMETERS = ["latency", "end-latency", "latency-sampled", "end-latency-sampled"]
PERCENTILES = {"p99": 0.99, "p999": 0.999}
HELPER_NODES = "system|spout"
ENGINE_NAMES = {"taskmanager": "Flink"}

RUN = ["experiment", "variant", "rate", "parameter", "rep"]
"""What tells runs apart; further dimensions of an experiment are added to it."""
GRAPHITE = "array<struct<target:string,datapoints:array<array<double>>>>"


def read_samples(spark: SparkSession, root: str, parameter: str) -> DataFrame:
    """Statistics files ``<root>/<rep>/<parameter>_<node>.csv``, without the first line of each."""
    raw = spark.read.csv(f"{root}/*/{parameter}_*.csv", header=True, enforceSchema=True, schema="t bigint, value double")
    path = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).cast("int").alias("rep"),
        F.regexp_extract(path, rf"{parameter}_([^/]*)\.csv$", 1).alias("node"),
        "t",
        "value",
    )


def read_reports(spark: SparkSession, root: str, parameter: str) -> DataFrame:
    """Collected reports ``<root>/<rep>/<parameter>.csv`` with node, time and value, all lines."""
    raw = spark.read.csv(f"{root}/*/{parameter}.csv", schema="node string, t bigint, value double")
    rep = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).cast("int")
    return raw.select(rep.alias("rep"), "node", "t", "value")


def read_experiments(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All analysis inputs ``<root>/<experiment>_<variant>/<parameter>.csv`` with rep, node, time and value, all lines.

    The variant is split at its dots into the dimensions of ``schema``; the first keeps its text, the others are
    numbers. ``run_keys(schema)`` tells the runs apart.
    """
    raw = spark.read.csv(f"{root}/*_*/*.csv", schema="rep int, node string, t bigint, value double")
    path = F.col("_metadata.file_path")
    named = raw.select(
        F.regexp_extract(path, r"([^/_]+)_[^/]*/[^/]+$", 1).alias("experiment"),
        F.regexp_extract(path, r"[^/_]+_([^/]*)/[^/]+$", 1).alias("variant"),
        F.regexp_extract(path, r"/([^/.]+)[^/]*$", 1).alias("parameter"),
        "rep",
        "node",
        "t",
        "value",
    )
    return variant_columns(named, schema)


def run_keys(schema: str) -> list[str]:
    """What tells the runs of ``read_experiments`` apart."""
    return ["experiment", *dict.fromkeys(["variant", *schema.split(".")]), "parameter", "rep"]


def graphite_flatten(df: DataFrame, json: str = "json") -> DataFrame:
    """One row per data point of Graphite JSON series; values that are null stay null."""
    kept = [c for c in df.columns if c != json]
    series = df.select(*kept, F.explode(F.from_json(json, GRAPHITE)).alias("s"))
    points = series.select(*kept, F.col("s.target").alias("target"), F.explode("s.datapoints").alias("p"))
    return points.select(*kept, "target", F.col("p")[1].cast("long").alias("t"), F.col("p")[0].alias("value"))


def alias_by_node(path: Column | str, *nodes: int) -> Column:
    """Some of the dot-separated parts of a metric path, joined by dots."""
    parts = F.split(path, r"\.")
    return F.concat_ws(".", *[F.get(parts, F.lit(i)) for i in nodes])


def group_series(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def rebase_time(samples: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Time since the first sample of the run."""
    first = samples.groupBy(*keys).agg(F.min("t").alias("_first"))
    joined = samples.join(first, list(keys))
    return joined.withColumn("t", F.col("t") - F.col("_first")).select(samples.columns)


def trim(
    samples: DataFrame, keys: Sequence[str] = RUN, warm_up: float = WARM_UP_SHARE, cool_down: float = COOL_DOWN_SHARE
) -> DataFrame:
    """Blank the values of the first and last part of each run."""
    last = samples.groupBy(*keys).agg(F.max("t").alias("_last"))
    joined = samples.join(last, list(keys))
    start = F.floor(F.col("_last") * F.lit(warm_up))
    end = F.ceil(F.col("_last") - F.col("_last") * F.lit(cool_down))
    kept = F.when((F.col("t") >= start) & (F.col("t") <= end), F.col("value"))
    return joined.withColumn("value", kept).select(samples.columns)


def variant_columns(samples: DataFrame, schema: str) -> DataFrame:
    """Split the variant at its dots into the dimensions of ``schema``; all but the first are numbers."""
    names = schema.split(".")
    parts = F.split("variant", r"\.")
    first = parts[0].alias(names[0])
    kept = [c for c in samples.columns if c not in names]
    return samples.select(*kept, first, *[parts[i].cast("double").alias(n) for i, n in enumerate(names) if i])


def prefer_raw(samples: DataFrame, parameters: Sequence[str] = RAW_PARAMETERS) -> DataFrame:
    """Where ``x-raw`` exists anywhere, it takes the place of ``x``, and ``x`` becomes ``x-ignored``."""
    raw = [f"{p}-raw" for p in parameters]
    found = samples.filter(F.col("parameter").isin(raw)).select(
        F.regexp_replace("parameter", "-raw$", "").alias("_base"), F.lit(True).alias("_has_raw")
    )
    present = F.broadcast(found.distinct())  # at most one row per entry of `parameters`
    base = F.regexp_replace("parameter", "-raw$", "")
    joined = samples.withColumn("_base", base).join(present, "_base", "left")
    renamed = F.when(F.col("_has_raw") & (F.col("parameter") == F.col("_base")), F.concat("parameter", F.lit("-ignored")))
    renamed = renamed.when(F.col("_has_raw"), F.col("_base")).otherwise(F.col("parameter"))
    return joined.withColumn("parameter", renamed).select(samples.columns)


def per_second(samples: DataFrame, slow_variants: Sequence[str] = (), seconds: int = SLOW_REPORT_SECONDS) -> DataFrame:
    """Collected throughput per second, for variants that report it for ``seconds`` at once."""
    if not slow_variants:
        return samples
    slow = F.col("variant").isin(*slow_variants) & F.col("parameter").isin("throughput", "sink-throughput")
    return samples.withColumn("value", F.when(slow, F.col("value") / seconds).otherwise(F.col("value")))


def to_units(samples: DataFrame, engines: Mapping[str, str] = ENGINE_NAMES) -> DataFrame:
    """Latency in seconds, negative latency missing; adds ``spe``, the engine: the first part of the node."""
    is_latency = F.col("parameter").isin(*LATENCY_PARAMETERS)
    value = (
        F.when(is_latency & (F.col("value") < 0), None)
        .when(is_latency, F.col("value") / 1000)
        .otherwise(F.col("value"))
    )
    engine = F.get(F.split("node", r"\."), F.lit(0))
    for name, shown in engines.items():
        engine = F.when(engine == name, shown).otherwise(engine)
    return samples.withColumns({"value": value, "spe": engine})


def get(samples: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns equal the given values; at least one is needed."""
    if not equal:
        raise ValueError("at least one condition is needed")
    return samples.filter(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in equal.items()]))


def latency_percentiles(samples: DataFrame, parameter: str, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """99th and 99.9th percentile per experiment, rate and variant, as samples of new parameters."""
    keys = ["experiment", "rate", "variant"]
    wide = exact_quantiles(get(samples, parameter=parameter), keys, "value", PERCENTILES, "linear", skew)
    names = F.array(
        *[F.struct(F.lit(f"{parameter}-{p}").alias("parameter"), F.col(p).alias("value")) for p in PERCENTILES]
    )
    long = wide.select(*keys, F.inline(names))
    return long.select(*keys, "parameter", F.lit(1).alias("rep"), F.lit("default").alias("node"), F.lit(1).alias("t"), "value")


def relative_deviation(value: str) -> Column:
    """Population standard deviation over the mean; null if the mean is not positive."""
    return F.when(F.avg(value) > 0, F.stddev_pop(value) / F.avg(value))


def exact_sum(value: str = "value") -> Column:
    """Sum to nine decimals that does not depend on the order of the rows; values that are not finite are left out."""
    return F.sum(F.col(value).try_cast("decimal(28,9)")).cast("double")


def exact_mean(value: str = "value") -> Column:
    """Mean by :func:`exact_sum`; null without values."""
    return F.try_divide(exact_sum(value), F.count(F.col(value).try_cast("decimal(28,9)")))


def two_level(
    samples: DataFrame,
    parameter: str,
    by: Sequence[str] = ("rate",),
    nodes: Column | None = None,
    spe: bool = False,
    name: str | None = None,
    samples_of_node: Column | None = None,
) -> DataFrame:
    """``samples_of_node`` per node and repetition, then ``nodes`` over the nodes of the repetition; both default to exact means."""
    groups = ["parameter", "variant", "rep", *(["spe"] if spe else []), *by]
    first = exact_mean() if samples_of_node is None else samples_of_node
    means = get(samples, parameter=parameter).groupBy(*groups, "node").agg(first.alias("value"))
    out = means.groupBy(*groups).agg((exact_mean() if nodes is None else nodes).alias("value"))
    return out if name is None else out.withColumn("parameter", F.lit(name))


def two_level_sum(samples: DataFrame, parameter: str, by: Sequence[str] = ("rate",)) -> DataFrame:
    """Sum of the node means; null only if all of them are missing."""
    return two_level(samples, parameter, by, exact_sum())


def max_node(samples: DataFrame, parameter: str, name: str, by: Sequence[str] = ("rate",)) -> DataFrame:
    """The largest node mean."""
    return two_level(samples, parameter, by, F.max("value"), name=name)


def node_spread(samples: DataFrame, parameter: str, by: Sequence[str] = ("rate",)) -> DataFrame:
    """Relative deviation between node means."""
    return two_level(samples, parameter, by, relative_deviation("value"))


def percent_difference(value: Column, reference: Column) -> Column:
    """Difference in percent of the reference; null for a missing or zero reference."""
    return F.when(reference != 0, 100 * (value - reference) / F.nullif(reference, F.lit(0.0)))


def confidence_95(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and half-width of its 95 % confidence interval; missing values count in the number of samples only."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), (F.lit(Z_95) * F.stddev_pop(value) / F.sqrt(F.count(F.lit(1)))).alias("ci95")
    )


def weighted_latency(samples: DataFrame, parameter: str = "latency", order: str = "seq") -> DataFrame:
    """Latency weighted with the node's share of the sink throughput of that second.

    Of several samples of a node and second the first counts, in the share and in the latency; the total
    counts all. Seconds without sink throughput give null.
    """
    at = ["variant", "rep", "t", "rate"]
    sink = get(samples, parameter="sink-throughput")
    totals = sink.groupBy(*at).agg(F.sum("value").alias("_total"))
    share = sink.groupBy(*at, "node").agg(F.min_by("value", order).alias("_sink"))
    share = share.join(totals, at).select(*at, "node", (F.col("_sink") / F.nullif("_total", F.lit(0.0))).alias("_share"))
    first = get(samples, parameter=parameter).filter("value is not null")
    first = first.groupBy(*at, "node").agg(F.min_by("value", order).alias("value"))
    weighted = first.join(share, [*at, "node"], "left")
    return weighted.select(
        *at, "node", F.lit(f"average-{parameter}").alias("parameter"), (F.col("value") * F.col("_share")).alias("value")
    )


def total_cpu(samples: DataFrame, order: str = "seq") -> DataFrame:
    """CPU of a node plus that of the statistics service and the scheduler in the same second."""
    at = ["variant", "rep", "t", "rate"]
    out = get(samples, parameter="cpu").select(*at, "node", "value")
    for other in ("graphite-cpu", "scheduler-cpu"):
        first = get(samples, parameter=other).groupBy(*at).agg(F.min_by("value", order).alias("_more"))
        out = out.join(first, at, "left").withColumn("value", F.col("value") + F.col("_more")).drop("_more")
    return out.withColumn("parameter", F.lit("total-cpu"))


def rounded3(value: Column) -> Column:
    return F.floor(value * 1000 + 0.5).cast("double") / 1000


def pivot_table(
    samples: DataFrame, parameter: str, rates: Sequence[int], index: Sequence[str] = ("variant",)
) -> DataFrame:
    """Mean per index and rate, one column per rate, rounded to three decimals."""
    wide = get(samples, parameter=parameter).groupBy(*index).pivot("rate", list(rates)).agg(F.avg("value"))
    return wide.select(*index, *[rounded3(F.col(str(rate))).alias(str(rate)) for rate in rates])


def relative_table(samples: DataFrame, parameter: str) -> DataFrame:
    """Mean per variant and rate relative to each variant as the baseline.

    "-" for the baseline itself, "+5%" for differences below 100 %, else the ratio as "+2.0x".
    """
    means = get(samples, parameter=parameter).groupBy("variant", "rate").agg(F.avg("value").alias("value"))
    base = means.select("rate", F.col("variant").alias("baseline"), F.col("value").alias("_base"))
    difference = percent_difference(F.col("value"), F.col("_base"))
    text = (
        F.when(F.col("variant") == F.col("baseline"), "-")
        .when(difference.isNull(), "missing")
        .when(F.abs(difference) < 100, F.format_string("%+.0f%%", difference))
        .otherwise(F.format_string("%+.1fx", F.col("value") / F.nullif("_base", F.lit(0.0))))
    )
    return means.join(base, "rate").select("baseline", "variant", "rate", text.alias("relative"))


def rolling_mean(
    samples: DataFrame, keys: Sequence[str] = ("parameter", "variant", "rate"), rows: int = ROLLING_ROWS, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Mean per second, smoothed over the last ``rows`` seconds that have values.

    Seconds of a key are cut into blocks; the last ``rows - 1`` of a block are also read by the next one.
    """
    per = samples.filter("value is not null").groupBy(*keys, "t").agg(F.avg("value").alias("value"))
    size = max(skew.block_rows, rows)
    place = F.col("_n") - 1
    own = F.floor(place / size)
    readers = F.when(place % size > size - rows, F.array(own, own + 1)).otherwise(F.array(own))
    placed = row_numbers(per, keys, "t", "_n", skew).select("*", own.alias("_own"), F.explode(readers).alias("_block"))
    window = Window.partitionBy(*keys, "_block").orderBy("t").rowsBetween(-(rows - 1), Window.currentRow)
    return placed.withColumn("value", F.avg("value").over(window)).filter("_own = _block").select(*keys, "t", "value")


def rate_range(samples: DataFrame, low: float = float("-inf"), high: float = float("inf")) -> DataFrame:
    return samples.filter(F.col("rate").between(low, high))


def variant_order(samples: DataFrame, order: Sequence[str]) -> DataFrame:
    """The variants with their position: the first entry of ``order`` contained in the name. Unknown ones raise."""
    position = F.raise_error(F.concat(F.lit("unknown variant: "), F.col("variant"))).cast("int")
    for i, part in reversed(list(enumerate(order))):
        position = F.when(F.col("variant").contains(part), F.lit(i)).otherwise(position)
    return samples.select("variant").distinct().withColumn("position", position)


def queue_boxes(samples: DataFrame, parameter: str = "input-queue", skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Box-plot numbers of the mean queue sizes of nodes, per rate and variant, without helper nodes."""
    queues = get(samples, parameter=parameter).filter(~F.col("node").rlike(HELPER_NODES))
    keys = ["rate", "variant"]
    means = queues.groupBy(*keys, "node").agg(F.avg("value").alias("value"))
    boxes = exact_quantiles(means, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "linear", skew)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    joined = means.join(boxes, keys)
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return joined.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("low"),
        F.max(F.when(inside, F.col("value"))).alias("high"),
        F.sum((~inside).cast("long")).alias("outliers"),
    )


def scheduler_policy(samples: DataFrame, plain: str = "OS") -> DataFrame:
    """Scheduler and policy named by a variant such as ``scheduler-policy``; plain variants have the default policy."""
    scheduler = F.regexp_replace("variant", r"^(\w+)-.+$", "$1")
    policy = F.regexp_replace("variant", r"^\w+-(\w+-)?(\w+)$", "$2")
    return samples.withColumns({"scheduler": scheduler, "policy": F.replace(policy, F.lit(plain), F.lit("default"))})


def run_summary(samples: DataFrame, by: Sequence[str] = ("experiment", "variant", "rate")) -> DataFrame:
    """Number of repetitions and length in minutes, by all dimensions."""
    return samples.groupBy(*by).agg(F.countDistinct("rep").alias("reps"), (F.max("t") / 60).alias("minutes"))
