"""Maps by pieces, and the moving average that is a parallel scan over them."""

import math
import random
from functools import reduce

import numpy as np
import pytest

from rillstone.functions.decay import global_average
from rillstone.functions.piecewise import average_of, composed, value_at


def walked(values, state, decay, ties=None):
    """The state after ``values``; one that was decayed before and is 10 but for rounding is noted in ``ties``."""
    decayed = False
    for x in values:
        if state < 10:
            state += x
        elif state == 10:
            state, decayed = 1.0, False
        else:
            state, decayed = x * decay + state * (1 - decay), True
        if ties is not None and decayed and abs(state - 10) < 1e-9:
            ties.append(state)
    return state


KINDS = {
    "warm": lambda d: d.randrange(20, 900),
    "about_to_fall": lambda d: d.randrange(0, 5),
    "fractions": lambda d: d.random() * 12,
    "mostly_nothing": lambda d: d.choice([0, 0, 0, 3, 10, 40]),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("decay", [2 / 86401, 0.01, 0.3])
def test_maps_and_their_combinations_follow_the_rule(kind, decay):
    draw, checked = random.Random(3), 0
    for _ in range(40):
        blocks = [[KINDS[kind](draw) for _ in range(draw.randrange(1, 20))] for _ in range(draw.randrange(1, 6))]
        maps = [average_of(np.array(b, dtype="float64"), decay, 10.0) for b in blocks]
        whole = reduce(composed, maps)
        for lo, slope, _ in [*maps, whole]:
            assert lo[0] == 0 and (np.diff(lo) > 0).all() and (slope >= 0).all()
        for start in [0.0, 4.0, 9.0, 10.0, 10.0001, 11.0, 12.5, 300.0, draw.random() * 20]:
            state, by_block, ties = start, start, []
            for b, line in zip(blocks, maps):
                state, by_block = walked(b, state, decay, ties), value_at(line, by_block)
            if ties:
                continue
            checked += 1
            assert math.isclose(state, by_block, rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(state, value_at(whole, start), rel_tol=1e-9, abs_tol=1e-9)
    assert checked > 300


def test_pieces_of_a_warm_average_are_few():
    draw = random.Random(4)
    line = average_of(np.array([draw.randrange(60, 900) for _ in range(4096)], dtype="float64"), 2 / 86401, 10.0)
    assert len(line[0]) < 5


def test_jobs_do_not_follow_the_restarts(spark):
    """An average that falls back again and again is built without a job, and read with as many as one that does not."""
    context, jobs = spark.sparkContext, {}
    for kind in ("warm", "about_to_fall"):
        draw = random.Random(9)
        values = [KINDS[kind](draw) for _ in range(60_000)]
        df = spark.createDataFrame(list(enumerate(values)), "seq long, x int")
        context.setJobGroup(f"build {kind}", "")
        averages = global_average(df, "seq", "x", "a", age=2000.0, block_rows=512, span=8)
        assert not context.statusTracker().getJobIdsForGroup(f"build {kind}")
        context.setJobGroup(f"read {kind}", "")
        got = [r["a"] for r in averages.orderBy("seq").collect()]
        jobs[kind] = len(context.statusTracker().getJobIdsForGroup(f"read {kind}"))
        state, falls, warm = 0.0, 0, False
        for g, x in zip(got, values, strict=True):
            state = walked([x], state, 2 / 2001)
            falls, warm = falls + (warm and state <= 10), state > 10
            assert math.isclose(g, state if warm else 0.0, rel_tol=1e-9)
        assert falls > 20 if kind == "about_to_fall" else not falls
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs["warm"] == jobs["about_to_fall"]


def test_nulls_count_as_nothing_and_age_one_keeps_the_last(spark):
    df = spark.createDataFrame([(0, 40), (1, None), (2, 30)], "seq long, x int")
    got = [r["a"] for r in global_average(df, "seq", "x", "a", age=1.0).orderBy("seq").collect()]
    assert got == [40.0, 0.0, 30.0]
