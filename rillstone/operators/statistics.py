"""Throughput and latency statistics of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions.decay import keyed_average
from rillstone.functions.quantiles import exact_quantiles
from rillstone.functions.skew import DEFAULT_SKEW, Skew, find_hot, previous, row_numbers, running

SAMPLE_EVERY = 100
ARRIVAL_ALPHA = 0.5
SUMMARY = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


GAP_ROWS = 65_536


def fill_gaps(
    df: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], fill: Column, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Add the times missing between the first and last row of a key, with ``fill`` as their values.

    A gap is first cut into stretches of ``GAP_ROWS`` times, so that no row holds a whole gap.
    """
    lagged = previous(df, keys, t, {"_before": t}, skew)
    start = F.coalesce(F.col("_before") + 1, F.col(t))
    stretches = lagged.withColumn("_from", F.explode(F.sequence(start.cast("long"), F.col(t).cast("long"), F.lit(GAP_ROWS).cast("long"))))
    end = F.least(F.col("_from") + GAP_ROWS - 1, F.col(t).cast("long"))
    spread = stretches.withColumn("_t", F.explode(F.sequence(F.col("_from"), end)))
    spread = spread.withColumn("_t", F.col("_t").cast(df.schema[t].dataType))
    at = F.col("_t") == F.col(t)
    return spread.select(
        *keys, F.col("_t").alias(t), *[F.when(at, F.col(v)).otherwise(fill).alias(v) for v in values]
    )


def count_per_second(
    df: DataFrame, second: str, keys: Sequence[str] = (), amount: Column | None = None, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Rows (or the sum of ``amount``) per second, 0 in seconds without rows."""
    per = df.groupBy(*keys, second).agg(F.sum(F.lit(1) if amount is None else amount).cast("long").alias("count"))
    return fill_gaps(per, keys, second, ["count"], F.lit(0).cast("long"), skew)


def average_per_second(
    df: DataFrame, second: str, value: str, keys: Sequence[str] = (), skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Integer mean per second, -1 in seconds without rows."""
    per = df.groupBy(*keys, second).agg(F.sum(F.col(value).cast("long")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    per = per.select(*keys, second, F.expr("_s div _n").alias("average"))
    return fill_gaps(per, keys, second, ["average"], F.lit(-1).cast("long"), skew)


def gauge(
    df: DataFrame, second: str, value: str, period: int = 1, keys: Sequence[str] = (), skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Mean since the last report, reported every ``period`` seconds; -1 if nothing came."""
    report = F.floor(F.col(second) / F.lit(period)).cast("long")
    per = df.groupBy(*keys, report.alias("report")).agg(F.avg(F.col(value).cast("double")).alias("gauge"))
    return fill_gaps(per, keys, "report", ["gauge"], F.lit(-1.0), skew)


def every_nth(
    df: DataFrame, keys: Sequence[str], seq: str, n: int = SAMPLE_EVERY, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """The n-th, 2n-th, ... row of each recorder."""
    if n <= 0:
        raise ValueError("n must be positive")
    return row_numbers(df, keys, seq, "_pos", skew).filter(F.col("_pos") % n == 0).drop("_pos")


def rate_limited(
    df: DataFrame, keys: Sequence[str], seq: str, elapsed: str, per_second: int, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Rows that a sampler of ``per_second`` values accepts: those seen while accepted <= per_second * elapsed.

    ``elapsed`` (seconds since the start) does not decrease in ``seq`` order. With i rows seen, the number
    accepted is the smallest of i and floor(per_second * elapsed_j) + 1 + i - j over all rows j up to i, so a
    running minimum replaces the row-by-row counter. 0 accepts everything.
    """
    if per_second == 0:
        return df
    hot = find_hot(df, keys, skew) if keys else None
    placed = row_numbers(df, keys, seq, "_i", skew, hot)
    limit = F.floor(F.col(elapsed) * per_second) + 1 - F.col("_i")
    bound = running(placed, keys, seq, {"_least": ("min", limit)}, skew, hot)
    bound = bound.withColumn("_accepted", F.col("_i") + F.least(F.lit(0), F.col("_least")))
    before = previous(bound, keys, seq, {"_before": "_accepted"}, skew, hot)
    taken = F.col("_accepted") > F.coalesce("_before", F.lit(0))
    return before.filter(taken).select(*df.columns)


def summary(
    samples: DataFrame, name: str, value: str, offered: DataFrame | None = None, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Count, mean, extremes and percentiles (at p (n + 1) / 100) of all samples that share a name.

    ``total`` counts the rows of ``offered``, from which the samples were taken, if it is given.
    """
    basic = samples.groupBy(name).agg(
        F.count(value).alias("samples"), F.avg(value).alias("mean"), F.min(value).alias("p0"), F.max(value).alias("p100")
    )
    totals = (samples if offered is None else offered).groupBy(name).agg(F.count(F.lit(1)).alias("total"))
    percentiles = exact_quantiles(samples, [name], value, SUMMARY, "n_plus_1", skew)
    joined = basic.join(totals, name).join(percentiles, name)
    return joined.select(name, "samples", "total", "mean", "p0", *SUMMARY, "p100")


SKETCH_K = 400
"""Size of a sketch; the rank of a quantile is off by under 1 % then, with high probability."""


def sketched(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys samples sum least most sketch``: what of the samples can be merged later, in a few kilobytes for each group.

    Written per second and name it replaces the raw samples: see :func:`merged_summary`.
    """
    number = F.col(value).cast("double")
    return samples.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("samples"), F.sum(number).alias("sum"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.kll_sketch_agg_double(number, F.lit(SKETCH_K)).alias("sketch"),
    )


def merged_summary(sketches: DataFrame, name: str) -> DataFrame:
    """:func:`summary` of all groups of :func:`sketched` with the same name, without their samples.

    Counts, mean and extremes are exact; percentiles are values whose rank is within 1 % of the exact one.
    """
    merged = sketches.groupBy(name).agg(
        F.sum("samples").alias("samples"), (F.sum("sum") / F.sum("samples")).alias("mean"), F.min("least").alias("p0"), F.max("most").alias("p100"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("_sketch"),
    )
    percentiles = [F.kll_sketch_get_quantile_double("_sketch", F.lit(p)).alias(c) for c, p in SUMMARY.items()]
    return merged.select(name, "samples", "mean", "p0", *percentiles, "p100")


def summary_json(summaries: DataFrame, name: str) -> DataFrame:
    """Each summary as the JSON text the original writes to a file."""
    labels = {"samples": "samples", "total": "total", "mean": "mean", "p0": "0", **{p: p[1:] for p in SUMMARY}, "p100": "100"}
    fields = [F.col(name).alias("name"), *[F.col(c).alias(label) for c, label in labels.items()]]
    return summaries.select(name, F.to_json(F.struct(*fields)).alias("json"))


def latency(df: DataFrame, now: Column | str, ts: str = "ts_ms", ts_ext: str = "ts_ext_ms") -> DataFrame:
    """Add the time since ingestion and since production at the sink."""
    at = F.col(now) if isinstance(now, str) else now
    return df.withColumns({"latency": at - F.col(ts), "end_latency": at - F.col(ts_ext)})


def observed(df: DataFrame, name: str, ts: str) -> DataFrame:
    """Pass rows on while counting them: a listener or Observation receives the count and time range."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def throughput(df: DataFrame, second: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per second of the whole run, as an integer."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(second).alias("_b"), F.min(second).alias("_a"))
    return per.select(*keys, F.expr("case when _b > _a then _n div cast(_b - _a as bigint) else 0 end").alias("throughput"))


def mean_rate(df: DataFrame, second: str, keys: Sequence[str] = (), skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Rows per second since the start, at the end of each second with rows; 0 in the first second."""
    per = df.groupBy(*keys, second).agg(F.count(F.lit(1)).alias("_n"))
    outs = {"_rows": ("sum", F.col("_n")), "_start": ("min", F.col(second))}
    upto = running(per, keys, second, outs, skew)
    rate = F.expr(f"case when {second} > _start then _rows div cast({second} - _start as bigint) else 0 end")
    return upto.select(*keys, second, rate.alias("rate"))


def arrival_average(
    df: DataFrame, keys: Sequence[str], seq: str, value: str, alpha: float = ARRIVAL_ALPHA, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Moving average of arrival times per receiver, starting at the first arrival."""
    return keyed_average(df, keys, seq, value, "average_arrival", alpha, skew)


def metric_line(df: DataFrame, key: Column, value: str, ts: str) -> DataFrame:
    """Plain-text metric lines: key, value and time."""
    return df.select(F.concat_ws(" ", key, F.col(value).cast("string"), F.col(ts).cast("string")).alias("line"))
