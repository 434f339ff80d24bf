"""Ordered per-key computations that stay balanced when one key holds a large share of the rows.

A plain window sends every row of a key to one task. The helpers here first look up the *hot* keys: one
partially aggregated count over the key columns, whose result is bounded. Without hot keys the plan is the
plain window. Otherwise the rows of a hot key are cut into blocks of consecutive ``seq`` values, each block
is scanned by its own task, and what a block needs from the blocks before it arrives as one extra *carry*
row that sorts first in the block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Skew:
    """When a key counts as hot, and how long the blocks of a hot key are.

    The hot keys are the largest keys with more than ``min_rows`` rows, ``max_keys`` of them at most. A key
    that is not listed has at most ``min_rows`` rows, or at most ``1 / max_keys`` of all rows.
    """

    min_rows: int = 1_000_000
    max_keys: int = 65_536
    block_rows: int = 262_144


DEFAULT_SKEW = Skew()
FIND = "find"
Hot = DataFrame | str | None
"""Hot keys given to an operator: a table, None for "there are none", or FIND to look them up."""
BROADCAST_ROWS = 100_000
TASK_ROWS = 262_144
"""Rows that :func:`spread` gives to a task, on average."""
FNS = {"sum": F.sum, "min": F.min, "max": F.max}


def find_hot(df: DataFrame, keys: Sequence[str], skew: Skew = DEFAULT_SKEW) -> DataFrame | None:
    """The hot keys as a broadcast table, or None if there are none. Runs one counting job."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > skew.min_rows)
    largest = counts.orderBy(F.desc("_n"), *keys).limit(skew.max_keys).select(*keys)
    table = largest.toArrow()
    if table.num_rows == 0:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(table, schema=largest.schema))


def hot_or_find(df: DataFrame, keys: Sequence[str], skew: Skew, hot: Hot) -> DataFrame | None:
    return find_hot(df, keys, skew) if isinstance(hot, str) else hot


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """``(rows of ordinary keys, rows of hot keys or None)``."""
    if hot is None:
        return df, None
    ordinary, heavy = df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")
    return ordinary.select(df.columns), heavy.select(df.columns)


def tasks_for(rows: int) -> int:
    """The tasks among which so many rows are dealt."""
    return max(1, math.ceil(rows / TASK_ROWS))


def spread(df: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as its rows need.

    Left alone, Spark puts shuffle partitions together by their compressed bytes. Narrow rows compress well, so a task
    would get millions of them, and its sorts and windows gigabytes.
    """
    return df.repartition(*keys) if tasks == 1 else df.repartition(tasks, *keys)


def _in_pieces(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    skew: Skew,
    hot: Hot,
    plain: Callable[[DataFrame], DataFrame],
    blocked: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``plain`` on the rows of ordinary keys and ``blocked`` on the rows of hot keys, which get a ``_blk``."""
    block = F.floor(F.col(seq) / F.lit(skew.block_rows)).cast("long")
    if not keys:
        return blocked(df.withColumn("_blk", block))
    ordinary, heavy = split_hot(df, keys, hot_or_find(df, keys, skew, hot))
    if heavy is None:
        return plain(ordinary)
    return plain(ordinary).unionByName(blocked(heavy.withColumn("_blk", block)))


def previous(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    cols: Mapping[str, str],
    skew: Skew = DEFAULT_SKEW,
    hot: Hot = FIND,
) -> DataFrame:
    """Add the previous row's values of the same key, in ``seq`` order: ``cols`` maps new name to column.

    Null on the first row of a key; with no keys the previous row of the whole input is meant.
    """
    value = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])

    def out(rows: DataFrame, window) -> DataFrame:
        return rows.withColumn("_prev", F.lag("_v").over(window))

    def plain(rows: DataFrame) -> DataFrame:
        return pick(out(rows.withColumn("_v", value), Window.partitionBy(*keys).orderBy(seq)))

    def blocked(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_v", value)
        last = rows.groupBy(*keys, "_blk").agg(F.max_by("_v", seq).alias("_v"))
        order = Window.partitionBy(*keys).orderBy("_blk")
        carry = last.withColumn("_v", F.lag("_v").over(order)).filter(F.col("_v").isNotNull())
        both = with_carry(rows, carry)
        return pick(out(both, Window.partitionBy(*keys, "_blk").orderBy("_real", seq)).filter("_real"))

    def pick(rows: DataFrame) -> DataFrame:
        return rows.select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in cols])

    return _in_pieces(df, keys, seq, skew, hot, plain, blocked)


def with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows and carry rows together; ``_real`` tells them apart and sorts carry rows first."""
    return rows.withColumn("_real", F.lit(True)).unionByName(
        carry.withColumn("_real", F.lit(False)), allowMissingColumns=True
    )


def running_in_blocks(
    rows: DataFrame, keys: Sequence[str], seq: str, outs: Mapping[str, tuple[str, Column]]
) -> DataFrame:
    """Running aggregates of rows whose ``_blk`` numbers stretches of the order in ``seq``."""
    parts = [(name, FNS[kind], f"_q{i}", column) for i, (name, (kind, column)) in enumerate(outs.items())]
    rows = rows.select("*", *[column.alias(q) for _, _, q, column in parts])
    totals = rows.groupBy(*keys, "_blk").agg(*[fn(q).alias(q) for _, fn, q, _ in parts])
    order = Window.partitionBy(*keys).orderBy("_blk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_blk", F.row_number().over(order).alias("_i"), *[fn(q).over(before).alias(q) for _, fn, q, _ in parts]
    )
    both = with_carry(rows, carry.filter("_i > 1").drop("_i"))
    window = Window.partitionBy(*keys, "_blk").orderBy("_real", seq)
    window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = both.select("*", *[fn(q).over(window).alias(name) for name, fn, q, _ in parts])
    return scanned.filter("_real").drop("_real", "_blk", *[q for _, _, q, _ in parts])


def running(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    outs: Mapping[str, tuple[str, Column]],
    skew: Skew = DEFAULT_SKEW,
    hot: Hot = FIND,
) -> DataFrame:
    """Add running aggregates in ``seq`` order: ``outs`` maps new name to ("sum" | "min" | "max", column)."""
    def plain(rows: DataFrame) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select("*", *[FNS[kind](column).over(window).alias(name) for name, (kind, column) in outs.items()])

    def blocked(rows: DataFrame) -> DataFrame:
        return running_in_blocks(rows, keys, seq, outs).select(*df.columns, *outs)

    return _in_pieces(df, keys, seq, skew, hot, plain, blocked)


def row_numbers(
    df: DataFrame, keys: Sequence[str], seq: str, name: str, skew: Skew = DEFAULT_SKEW, hot: Hot = FIND
) -> DataFrame:
    """Add the 1-based position of each row within its key, in ``seq`` order."""
    return running(df, keys, seq, {name: ("sum", F.lit(1).cast("long"))}, skew, hot)


def runs(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    labels: Sequence[str],
    sums: Mapping[str, Column],
    skew: Skew = DEFAULT_SKEW,
    hot: Hot = FIND,
) -> DataFrame:
    """One row per maximal run of equal ``labels`` among a key's rows in ``seq`` order.

    Output: keys, labels, ``first_seq``, ``n`` and the requested sums. In a hot key, runs are cut at block
    borders; only the first and last run of a block are put together again, so that pass sees at most two
    rows a block.
    """
    label = F.struct(*labels)
    columns = [*keys, *labels, "first_seq", "n", *sums]

    def numbered(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(seq)
        rows = rows.select("*", *[c.alias(f"_s_{n}") for n, c in sums.items()])
        rows = rows.withColumn("_start", (~label.eqNullSafe(F.lag(label).over(window))).cast("int"))
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("_run", F.sum("_start").over(upto))

    def collapse(rows: DataFrame, by: Sequence[str], *extra: Column) -> DataFrame:
        return rows.groupBy(*by, "_run").agg(
            *[F.first(c).alias(c) for c in labels],
            F.min(seq).alias("first_seq"),
            F.count(F.lit(1)).alias("n"),
            *[F.sum(f"_s_{n}").alias(n) for n in sums],
            *extra,
        )

    def plain(rows: DataFrame) -> DataFrame:
        return collapse(numbered(rows, keys), keys).select(*columns)

    def blocked(rows: DataFrame) -> DataFrame:
        by = [*keys, "_blk"]
        rows = numbered(rows, by)
        rows = rows.withColumn("_last", F.lead(F.lit(1)).over(Window.partitionBy(*by).orderBy(seq)).isNull())
        local = collapse(rows, by, F.max("_last").alias("_last"))
        edge = F.col("_last") | (F.col("_run") == 1)
        order = Window.partitionBy(*keys).orderBy("first_seq")
        same = label.eqNullSafe(F.lag(label).over(order)) & (F.col("_blk") != F.lag("_blk").over(order))
        edges = local.filter(edge).withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edges = edges.withColumn("_run", F.sum("_new").over(upto))
        joined = edges.groupBy(*keys, "_run").agg(
            *[F.first(c).alias(c) for c in labels],
            F.min("first_seq").alias("first_seq"),
            F.sum("n").alias("n"),
            *[F.sum(n).alias(n) for n in sums],
        )
        return local.filter(~edge).select(*columns).unionByName(joined.select(*columns))

    return _in_pieces(df, keys, seq, skew, hot, plain, blocked)


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast copy of ``small`` if it has at most ``max_rows`` rows, else ``small`` itself.

    The rows are computed once for the check and handed on, so a small side is not evaluated again. Beyond
    the limit the join is left to the optimizer, which shuffles and splits skewed partitions.
    """
    if small.isStreaming:
        return small
    table = small.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return small
    return F.broadcast(small.sparkSession.createDataFrame(table, schema=small.schema))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
