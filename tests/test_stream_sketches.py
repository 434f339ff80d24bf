"""Streams in a fixed amount of state: rotating Bloom filters and decayed counters, against exact answers."""

import math
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillstone.functions.decay import rate_constant
from rillstone.sources import fixtures as fx
from rillstone.streaming import sketches
from test_streaming import in_files, read, run

BETA = 0.9672


def test_filters_over_batches(spark, tiny, tmp_path):
    calls = fx.calls(spark, tiny).select("call_id", "caller", "callee")
    calls = calls.unionByName(calls.filter("call_id % 3 = 0").withColumn("call_id", F.col("call_id") + 10**6))
    schema = in_files(calls, "call_id", tmp_path / "in")
    pairs = calls.select("caller", "callee").distinct().count()
    new = sketches.probably_new(read(spark, schema, tmp_path / "in"), ["caller", "callee"], "call_id", 4 * pairs, buckets=4)
    got = {r["call_id"]: r["new"] for r in run(new, tmp_path / "out", tmp_path / "cp").collect()}
    seen, missed = set(), 0
    for r in calls.orderBy("call_id").collect():
        pair = (r["caller"], r["callee"])
        assert not (got[r["call_id"]] and pair in seen)
        missed += pair not in seen and not got[r["call_id"]]
        seen.add(pair)
    assert len(got) == calls.count() and missed <= 0.05 * pairs


class State:
    """A value state as the processors see it."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def feed(processor, name, batches):
    import pandas as pd

    setattr(processor, name, State())
    return [pd.concat(list(processor.handleInputRows((0,), iter([batch]), None))) for batch in batches]


def hashed(keys):
    rng = np.random.default_rng(5)
    table = rng.integers(-(2**63), 2**63 - 1, (int(max(keys)) + 1, 2))
    return table[keys]


def test_filters_turn_and_forget():
    import pandas as pd

    capacity, errors = 2000, 0.05
    bits, hashes, fill = sketches.filter_size(capacity, errors)
    keys = np.arange(12 * capacity)
    hashes_of = hashed(keys)
    frame = pd.DataFrame({"row": keys, "hash_one": hashes_of[:, 0], "hash_two": hashes_of[:, 1]})
    again = frame.iloc[-capacity // 2 :].assign(row=frame["row"].iloc[-capacity // 2 :] + 10**6)
    oldest = frame.iloc[: capacity].assign(row=frame["row"].iloc[:capacity] + 10**7)
    processor = sketches.RotatingFilters(bits, hashes, fill, "seq")
    batches = [frame.iloc[a : a + 997] for a in range(0, len(frame), 997)] + [again, oldest]
    *first, repeated, old = feed(processor, "filters", batches)
    missed = 1 - pd.concat(first)["new"].mean()
    assert 0 < missed <= 1.2 * errors
    assert not repeated["new"].any() and old["new"].mean() > 0.9
    assert sum(map(len, processor.filters.value)) == 2 * bits // 8


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 30), st.integers(0, 4000), st.integers(0, 50)), min_size=1, max_size=120),
    st.integers(1, 5),
    st.sampled_from([2, 8, 1024]),
)
def test_counters_never_fall_below_the_exact_rate(calls, parts, width):
    import pandas as pd

    decay = rate_constant(BETA)
    keys = np.array([k for k, _, _ in calls])
    frame = pd.DataFrame({"row": np.arange(len(calls)), "at": [t for _, t, _ in calls], "quantity": [float(q) for _, _, q in calls]})
    frame[["hash_one", "hash_two"]] = hashed(keys)
    batches = [frame.iloc[part] for part in np.array_split(np.arange(len(calls)), parts) if len(part)]
    got = pd.concat(feed(sketches.DecayedCounters(width, 4, BETA, "seq"), "counters", batches)).set_index("seq")["rate"]
    clock, state = None, defaultdict(lambda: (0, 0.0))
    for batch in batches:
        t = batch["at"] if clock is None else batch["at"].clip(lower=clock)
        clock = t.max()
        for _, seq, at in sorted(zip(t, batch["row"], t)):
            since, value = state[keys[seq]]
            value = value * math.exp(-decay * (at - since)) + decay * frame["quantity"][seq]
            state[keys[seq]] = (at, value)
            assert got[seq] >= value * (1 - 1e-9) - 1e-12
            assert width < 1024 or got[seq] <= value * (1 + 1e-9) + 1e-12


def test_counters_over_batches(spark, tiny, tmp_path):
    calls = fx.calls(spark, tiny).select("call_id", "caller", "answer_ts", "duration")
    lost = calls.agg(F.max("call_id")).first()[0] + 1
    odd = spark.createDataFrame([(lost, 1, None, 5)], "call_id long, caller long, answer_ts long, duration int")
    calls = calls.unionByName(odd.select(*[F.col(c).cast(calls.schema[c].dataType) for c in calls.columns]))
    schema = in_files(calls, "call_id", tmp_path / "in")
    stream = read(spark, schema, tmp_path / "in")
    rates = sketches.sketched_rates(stream, ["caller"], "answer_ts", "call_id", "duration", BETA, width=256, buckets=4)
    got = {r["call_id"]: r["rate"] for r in run(rates, tmp_path / "out", tmp_path / "cp").collect()}
    assert len(got) == calls.count() and got[lost] is None
    decay, state, close = rate_constant(BETA), {}, 0
    ordered = calls.filter("answer_ts IS NOT NULL").orderBy("answer_ts", "call_id").collect()
    for r in ordered:
        since, value = state.get(r["caller"], (r["answer_ts"], 0.0))
        value = value * math.exp(-decay * (r["answer_ts"] - since)) + decay * (r["duration"] or 0)
        state[r["caller"]] = (r["answer_ts"], value)
        assert got[r["call_id"]] >= value * (1 - 1e-9)
        close += got[r["call_id"]] <= value * 1.01 + 1e-6
    assert close >= 0.95 * len(ordered)
