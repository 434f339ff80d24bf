"""Exponentially decayed sums per key, the moving average over a whole stream, and the ratio score."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions.piecewise import Map, average_of, composed, value_at
from rillstone.functions.skew import DEFAULT_SKEW, FIND, Hot, Skew, hot_or_find, row_numbers, split_hot, spread, tasks_for, with_carry

# A weight of e^-68 is no weight: it is below the precision of a sum.
NO_WEIGHT = 68

# Fixed values of the average: age 86400 samples, warm-up level 10.
AVERAGE_AGE = 86_400.0
WARM_UP = 10.0

# Blocks of the moving average that one task combines, and the pieces a map may have.
SPAN = 256
MOST_PIECES = 64
PART_COLUMNS = "lo array<double>, slope array<double>, add array<double>, x array<double>"


def rate_constant(beta: float) -> float:
    """Decay per second as a positive exponent."""
    return math.log(1.0 / beta)


def block_seconds(beta: float) -> int:
    """Length of a time block: a power of two of seconds, after which a weight is below e^-68.

    Two blocks are at most e^272 apart, which a double can hold.
    """
    if not 0 < beta < 1:
        raise ValueError(f"a decay per second is between 0 and 1: {beta}")
    return 1 << max(0, math.ceil(math.log2(NO_WEIGHT / rate_constant(beta))))


def by_block(features: Mapping[str, tuple[str, float]]) -> dict[int, dict[str, tuple[str, float]]]:
    """The features by the length of their time block."""
    out: dict[int, dict[str, tuple[str, float]]] = {}
    for name, (q, beta) in features.items():
        out.setdefault(block_seconds(beta), {})[name] = (q, beta)
    return out


def _anchored(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], features: Mapping[str, tuple[str, float]],
    t: str, block: int, frame: tuple[int, int],
) -> DataFrame:
    """Decayed sums (without the leading constant) over ``frame``; exponents are relative to a time block.

    Every row is placed in its own and in the next time block, so a block sees the whole block before it
    and older rows have no weight left. Rows of ``rows`` must already be spread by ``keys`` if one exchange
    is to do.
    """
    own = F.floor(F.col(t) / F.lit(block)).cast("long")
    placed = rows.withColumn("_own", own).withColumn("_tb", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    d = (F.col(t) - F.col("_tb") * block).cast("double")
    window = Window.partitionBy(*keys, "_tb").orderBy(*order).rowsBetween(*frame)
    sums = {
        name: F.coalesce(
            F.sum(F.col(q) * F.exp(rate_constant(beta) * d)).over(window) * F.exp(-rate_constant(beta) * d), F.lit(0.0)
        )
        for name, (q, beta) in features.items()
    }
    summed = placed.select("*", *[c.alias(name) for name, c in sums.items()])
    return summed.filter(F.col("_tb") == F.col("_own")).drop("_own", "_tb")


def decay_plain(
    rows: DataFrame, keys: Sequence[str], t: str, seq: str, features: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """Decayed sums for keys of ordinary size: one exchange on the key, rows are doubled behind it.

    Features whose blocks differ in length take one window each.
    """
    out = rows
    for block, some in by_block(features).items():
        out = _anchored(out, keys, [t, seq], some, t, block, (Window.unboundedPreceding, Window.currentRow))
    constants = {name: rate_constant(beta) for name, (_, beta) in features.items()}
    return out.withColumns({name: F.col(name) * F.lit(c) for name, c in constants.items()})


def cell_sums(
    rows: DataFrame, keys: Sequence[str], t: str, seq: str, features: Mapping[str, tuple[str, float]],
    skew: Skew, left_over: Callable[[DataFrame, Mapping[str, tuple[str, float]]], DataFrame],
) -> DataFrame:
    """Decayed sums in cells of one second and at most ``skew.block_rows`` rows of a key.

    Within a cell nothing decays, so a cell is a plain running sum on top of what the cells before have left
    (without the leading constant). ``left_over`` works that out from the totals of the cells: it replaces
    each quantity by it. The results travel to the cells as carry rows.
    """
    rows = rows.withColumn("_sb", F.floor(F.col(seq) / F.lit(skew.block_rows)).cast("long"))
    quantities = {name: f"_q_{name}" for name in features}
    rows = rows.withColumns({quantities[n]: F.col(q).cast("double") for n, (q, _) in features.items()})
    cell = [*keys, t, "_sb"]
    cells = rows.groupBy(*cell).agg(*[F.sum(q).alias(q) for q in quantities.values()])
    carry = left_over(cells, {quantities[n]: (quantities[n], beta) for n, (_, beta) in features.items()})
    window = Window.partitionBy(*cell).orderBy("_real", seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = with_carry(rows, carry.select(*cell, *quantities.values()))
    summed = both.select(
        "*", *[(F.sum(quantities[n]).over(window) * rate_constant(beta)).alias(n) for n, (_, beta) in features.items()]
    )
    return summed.filter("_real").drop("_real", "_sb", *quantities.values())


def decay_hot(
    rows: DataFrame, keys: Sequence[str], t: str, seq: str, features: Mapping[str, tuple[str, float]],
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Decayed sums for hot keys: only the totals of cells are gathered by key and time block."""

    def left_over(cells: DataFrame, quantities: Mapping[str, tuple[str, float]]) -> DataFrame:
        before = (Window.unboundedPreceding, -1)
        named = {f"_c{q}": use for q, use in quantities.items()}
        summed = cells
        for block, some in by_block(named).items():
            summed = _anchored(summed, keys, [t, "_sb"], some, t, block, before)
        return summed.select(*keys, t, "_sb", *[F.col(f"_c{q}").alias(q) for q in quantities])

    return cell_sums(rows, keys, t, seq, features, skew, left_over)


def decayed_sums(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    seq: str,
    features: Mapping[str, tuple[str, float]],
    skew: Skew = DEFAULT_SKEW,
    hot: Hot = FIND,
    tasks: int | None = None,
) -> DataFrame:
    """Add, per key, ln(1/beta) * sum of q * beta^(seconds since), over the rows up to and with this one.

    ``features`` maps the new column to (quantity column, beta). Rows count in order of (``t``, ``seq``).
    ``tasks``: among how many tasks ordinary keys are dealt; without it rows are counted.
    """
    tasks = tasks_for(df.count()) if tasks is None else tasks
    ordinary, heavy = split_hot(df, keys, hot_or_find(df, keys, skew, hot))
    out = decay_plain(spread(ordinary, keys, tasks), keys, t, seq, features)
    if heavy is None:
        return out
    return out.unionByName(decay_hot(heavy, keys, t, seq, features, skew))


def score(ratio: Column, upper: float) -> Column:
    """Ratio relative to its upper threshold, kept within 0 and 1; NaN stays NaN.

    The lower threshold of the published formula cancels out.
    """
    scaled = ratio / F.lit(upper)
    return F.when(F.isnan(scaled), F.lit(float("nan"))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))


def divide(a: Column, b: Column) -> Column:
    """Floating division with IEEE results for a zero divisor (non-negative operands)."""
    at_zero = F.when(a == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def _line_of(row) -> Map | None:
    return None if row.lo is None else (np.asarray(row.lo), np.asarray(row.slope), np.asarray(row.add))


def _parts(lines: list[tuple[Map | None, object]], **keys: list[int]) -> pd.DataFrame:
    """Rows of parts: a map, or the samples themselves where a map would have too many pieces."""
    columns = {c: [None if line is None else line[k] for line, _ in lines] for k, c in enumerate(("lo", "slope", "add"))}
    return pd.DataFrame({**keys, **columns, "x": [x if line is None else None for line, x in lines]})


def _sample_by_sample(x: Sequence[float], state: float, decay: float) -> list[float]:
    """The average after each sample, exactly as defined."""
    out = []
    for value in x:
        if state < WARM_UP:
            state += value
        elif state == WARM_UP:
            state = state / WARM_UP
        else:
            state = value * decay + state * (1.0 - decay)
        out.append(state)
    return out


def _after(row, state: float, decay: float) -> float:
    """The state after a part that is entered with ``state``."""
    line = _line_of(row)
    return _sample_by_sample(row.x.tolist(), state, decay)[-1] if line is None else value_at(line, state)


def _combined(pdf: pd.DataFrame) -> pd.DataFrame:
    """A run of consecutive blocks with as few parts as possible, in order."""
    lines: list[tuple[Map | None, object]] = []
    for row in pdf.sort_values("_blk").itertuples():
        line = _line_of(row)
        if line is not None and lines and lines[-1][0] is not None:
            both = composed(lines[-1][0], line)
            if len(both[0]) <= MOST_PIECES:
                lines[-1] = (both, None)
                continue
        lines.append((line, row.x))
    return _parts(lines, _up=[int(pdf["_up"].iloc[0])] * len(lines), _part=list(range(len(lines))))


def block_starts(blocks: DataFrame, start: float, decay: float, span: int = SPAN) -> DataFrame:
    """``_blk carry``: the state before each block, from the rows ``_blk lo slope add x`` of the blocks.

    Runs of ``span`` block numbers are combined in parallel. The runs are gone through in order by one task that reads
    them as a stream and holds one at a time: a run is one row if its blocks have maps, and the samples of the blocks
    that have none. Within the runs the states are found in parallel again.
    """

    def through_runs(batches):
        state, last = start, None
        for pdf in batches:
            ups, carries = [], []
            for row in pdf.itertuples():
                if row.up != last:
                    last = row.up
                    ups.append(last)
                    carries.append(state)
                state = _after(row, state, decay)
            yield pd.DataFrame({"_up": pd.Series(ups, dtype="int64"), "carry": pd.Series(carries, dtype="float64")})

    def through_blocks(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        state, carries = float(before["carry"].iloc[0]), []
        pdf = pdf.sort_values("_blk")
        for row in pdf.itertuples():
            carries.append(state)
            state = _after(row, state, decay)
        return pd.DataFrame({"_blk": pdf["_blk"], "carry": carries})

    runs = blocks.withColumn("_up", F.floor(F.col("_blk") / F.lit(span)).cast("long")).groupBy("_up")
    parts = runs.applyInPandas(_combined, f"_up long, _part int, {PART_COLUMNS}")
    in_order = parts.repartition(1).sortWithinPartitions("_up", "_part").withColumnRenamed("_up", "up")
    entered = in_order.mapInPandas(through_runs, "_up long, carry double")
    return runs.cogroup(entered.groupBy("_up")).applyInPandas(through_blocks, "_blk long, carry double")


def global_average(
    df: DataFrame, seq: str, value: str, name: str = "average", age: float = AVERAGE_AGE,
    block_rows: int = 4096, span: int = SPAN, start: float = 0.0, state: str | None = None, tasks: int = 1,
) -> DataFrame:
    """Exponential moving average of ``value`` over all rows in ``seq`` order: columns ``seq`` and ``name``.

    Samples are added up until the sum reaches 10; a sum of exactly 10 turns into 1 and swallows the next
    sample; afterwards a <- x * d + a * (1 - d) with d = 2 / (age + 1). A state up to 10 reads as 0, and is
    in the warm-up again. ``seq`` and the values are not negative; a null counts as 0. ``start`` is the state before the
    first row; ``state`` names a column that tells the state after each row. ``tasks``: among how many the blocks are dealt;
    with 1, Spark decides.

    What a block of ``block_rows`` sequence numbers does to the state is a straight line by pieces: a few if the
    average stays warm, so blocks are mapped in parallel, combined by runs of ``span``, and walked from the state before
    them. A block in which the average is about to fall back takes more than ``MOST_PIECES``; its samples
    are handed on in place of a map, and one task reads them in order, as a stream. Nothing runs while
    the DataFrame is built, and the number of jobs does not depend on how often the average falls back. A decayed
    state that is 10 but for rounding may be taken for either side at the border of two blocks.
    """
    decay = 2.0 / (age + 1.0)
    # Weights within a block stay above e^-8.
    rows = min(block_rows, max(1, int(8 / -math.log1p(-decay)))) if decay < 1 else 1

    def block_map(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_seq")["_x"].to_numpy()
        return _parts([(average_of(x, decay, WARM_UP, MOST_PIECES), x)], _blk=[int(pdf["_blk"].iloc[0])])

    def walk(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq")
        states = _sample_by_sample(pdf["_x"].tolist(), float(before["carry"].iloc[0]), decay)
        return pdf[["_seq"]].assign(_state=states)

    samples = df.select(
        F.col(seq).cast("long").alias("_seq"),
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x"),
        F.floor(F.col(seq) / F.lit(rows)).cast("long").alias("_blk"),
    )
    samples = spread(samples, ["_blk"], tasks).groupBy("_blk") if tasks > 1 else samples.groupBy("_blk")
    starts = block_starts(samples.applyInPandas(block_map, f"_blk long, {PART_COLUMNS}"), start, decay, span)
    states = samples.cogroup(starts.groupBy("_blk")).applyInPandas(walk, "_seq long, _state double")
    shown = F.when(F.col("_state") <= WARM_UP, 0.0).otherwise(F.col("_state"))
    more = [F.col("_state").alias(state)] if state else []
    return states.select(F.col("_seq").alias(seq), shown.alias(name), *more)


def keyed_average(
    df: DataFrame, keys: Sequence[str], seq: str, value: str, name: str = "average", alpha: float = 0.5,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Add, per key, a <- (1 - alpha) * a + alpha * x in ``seq`` order, starting at the first value.

    Only the last values have weight: ``terms`` of them bring the rest below 2^-70.
    """
    terms = math.ceil(70 * math.log(2) / -math.log1p(-alpha))
    step = 8 * terms
    placed = row_numbers(df, keys, seq, "_n", skew)
    own = F.floor((F.col("_n") - 1) / F.lit(step)).cast("long")
    placed = placed.withColumn("_own", own)
    copies = F.when((F.col("_n") - 1) % step >= step - terms, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    spread = placed.withColumn("_nb", F.explode(copies))
    d = (F.col("_n") - F.col("_nb") * step).cast("double")
    keep = F.lit(1.0 - alpha)
    weight = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    window = Window.partitionBy(*keys, "_nb").orderBy("_n").rowsBetween(-(terms - 1), Window.currentRow)
    total = F.sum(weight * F.col(value) * F.pow(keep, -d)).over(window) * F.pow(keep, d)
    out = spread.withColumn(name, total).filter(F.col("_nb") == F.col("_own"))
    return out.select(*df.columns, name)
