"""Many filter chains over one stream."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, LOW = "HIGH", "LOW"
# Priorities of the two classes.
PRIORITIES = {HIGH: 3, LOW: 1}
# Multipliers of the hash that decides what a filter keeps.
MODULUS, BASE, STEP, SHIFT, QUERY_SHIFT = 999_983, 7_919, 104_729, 12_345, 7_907


def min_selectivity(selectivity: float, length: int) -> float:
    """Selectivity per operator that gives a chain of ``length`` the selectivity asked for."""
    return math.exp(math.log(selectivity) / length)


def keep_number(id_: Column, op: int, query: Column | int = 0) -> Column:
    """Number in 0..MODULUS-1 of a tuple at an operator; cubic, so operators are independent of each other."""
    q = F.lit(query) if isinstance(query, int) else query
    x = ((id_ + 1 + q * QUERY_SHIFT) % MODULUS) * (BASE + STEP * (op + 1)) % MODULUS
    return ((x * x % MODULUS) * x + SHIFT * op) % MODULUS


def keeps(id_: Column, op: int, selectivity: Column | float, query: Column | int = 0) -> Column:
    share = F.lit(selectivity) if isinstance(selectivity, float) else selectivity
    return keep_number(id_, op, query) < share * MODULUS


def filter_chain(df: DataFrame, id_: str, selectivities: Sequence[float], seed: int | None = None) -> DataFrame:
    """Rows that pass a chain of filters.

    Without ``seed`` a row's fate follows from its id, so results can be repeated on any partitioning; with
    ``seed`` each operator draws random numbers.
    """
    if seed is None:
        tests = [keeps(F.col(id_), op, s) for op, s in enumerate(selectivities)]
    else:
        tests = [F.rand(seed + op) <= s for op, s in enumerate(selectivities)]
    return df.filter(reduce(lambda a, b: a & b, tests))


def fan_out(df: DataFrame, n: int) -> DataFrame:
    """Every row once per query, marked with ``query_id`` 0..n-1."""
    return df.withColumn("query_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def query_selectivities(
    n: int, length: int, selectivity: float, variance: int = 0, seed: int = 0
) -> list[list[float]]:
    """Selectivity of every operator of every query: one drawn per query, varied by ``variance`` percent."""
    draw = random.Random(seed)
    low = min_selectivity(selectivity, length)
    table = []
    for _ in range(n):
        base = draw.uniform(low, 1.0)
        table.append([base + draw.uniform(-1.0, 1.0) * base * variance / 100 for _ in range(length)])
    return table


def query_costs(n: int, cost: int, variance_factor: int = 0, seed: int = 0) -> list[int]:
    """Work per tuple of every query: ``cost`` times a power of two drawn up to ``variance_factor``."""
    draw = random.Random(seed)
    return [cost * 2 ** draw.randint(0, variance_factor) for _ in range(n)]


def _table(selectivities: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(s)) for s in ops]) for ops in selectivities])


def _passed(df: DataFrame, id_: str, table: Column, length: int) -> DataFrame:
    """Each row with the queries of ``table`` (selectivities per operator) that it passes."""
    fanned = df.select("*", F.posexplode(table).alias("query_id", "_ops"))
    tests = [keeps(F.col(id_), op, F.element_at("_ops", op + 1), F.col("query_id")) for op in range(length)]
    return fanned.filter(reduce(lambda a, b: a & b, tests)).drop("_ops")


def chains(df: DataFrame, id_: str, selectivities: Sequence[Sequence[float]]) -> DataFrame:
    """All filter chains in one pass over the stream; rows are marked with the ``query_id`` they pass.

    The selectivities are one constant array, so the plan does not grow with the number of queries and
    nothing is shuffled.
    """
    return _passed(df, id_, _table(selectivities), len(selectivities[0]))


def multi_class(df: DataFrame, id_: str, class_: str, selectivities: dict[str, Sequence[Sequence[float]]]) -> DataFrame:
    """Chains per class in one pass: a row goes to the queries of its class only; adds ``priority``.

    All chains have the same length. Rows of other classes go nowhere.
    """
    table, priority = None, None
    for name, ops in selectivities.items():
        own = F.col(class_) == name
        table = F.when(own, _table(ops)) if table is None else table.when(own, _table(ops))
        level = F.lit(PRIORITIES[name])
        priority = F.when(own, level) if priority is None else priority.when(own, level)
    length = len(next(iter(selectivities.values()))[0])
    return _passed(df.withColumn("priority", priority), id_, table, length)


def stress_value(f1: Column, f2: Column, cost: int) -> Column:
    """Value of ``f1`` after ``cost`` multiplications by ``f2``."""
    return f1 * F.pow(f2.cast("double"), F.lit(float(cost)))
