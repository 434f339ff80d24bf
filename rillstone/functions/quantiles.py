"""Exact quantiles per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions.skew import DEFAULT_SKEW, Skew, find_hot, running_in_blocks, split_hot

SPLITTERS = 128


def _rank(p: float, total: Column, method: str) -> Column:
    """1-based fractional rank of quantile ``p`` among ``total`` values."""
    if method == "linear":
        return F.lit(p) * (total - 1) + 1
    if method == "n_plus_1":
        return F.greatest(F.lit(1.0), F.least(total.cast("double"), F.lit(p) * (total + 1)))
    raise ValueError(f"unknown method: {method}")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    method: str = "linear",
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Exact quantiles of ``value`` per group, one column per entry of ``probabilities``.

    ``linear`` interpolates at rank 1 + p (n - 1), ``n_plus_1`` at rank p (n + 1) kept within the data.
    Missing values are left out. Equal values are counted first. A group with very many different values is
    cut at approximate quantiles into value ranges, which are ranked by separate tasks; where the cuts fall
    has no influence on the result.
    """
    if not keys:
        whole = exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probabilities, method, skew)
        return whole.drop("_all")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ordinary, heavy = split_hot(counted, keys, find_hot(counted, keys, skew))
    window = Window.partitionBy(*keys)
    upto = window.orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ordinary.select("*", F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(window).alias("_total"))
    if heavy is not None:
        steps = [i / SPLITTERS for i in range(1, SPLITTERS)]
        cuts = heavy.groupBy(*keys).agg(
            F.percentile_approx("_x", steps, 10 * SPLITTERS).alias("_cuts"), F.sum("_n").alias("_total")
        )
        placed = heavy.join(cuts, list(keys)).withColumn(
            "_blk", F.size(F.filter("_cuts", lambda c: c < F.col("_x"))).cast("long")
        )
        spread = running_in_blocks(placed.drop("_cuts"), keys, "_x", {"_upto": ("sum", F.col("_n"))})
        ranked = ranked.unionByName(spread.select(ranked.columns))
    total = F.col("_total")
    ends = []
    for name, p in probabilities.items():
        low = F.floor(_rank(p, total, method))
        ends.append(F.min(F.when(F.col("_upto") >= low, F.col("_x"))).alias(f"_lo_{name}"))
        ends.append(F.min(F.when(F.col("_upto") >= F.least(low + 1, total), F.col("_x"))).alias(f"_hi_{name}"))
    found = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *ends)
    out = []
    for name, p in probabilities.items():
        rank = _rank(p, total, method)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    return found.select(*keys, *out)
