"""Preparation of raw experiment samples for analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rillstone.operators import experiments as ex


def prepared(samples: DataFrame, slow_variants: Sequence[str] = ()) -> DataFrame:
    """Samples on the time of their run, without warm-up and cool-down, in common units, with ``spe``.

    Slow reports are scaled before raw measurements replace collected ones; latency is converted afterwards,
    so both kinds are.
    """
    timed = ex.trim(ex.rebase_time(samples))
    return ex.to_units(ex.prefer_raw(ex.per_second(timed, slow_variants)))


def overview(samples: DataFrame) -> DataFrame:
    """Throughput summed and latency averaged over nodes, per repetition and rate."""
    latency = ex.two_level(samples, "latency")
    return ex.group_series(ex.two_level_sum(samples, "throughput"), latency, ex.max_node(samples, "latency", "max-latency"))
