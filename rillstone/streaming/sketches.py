"""Membership and decayed rates of unbounded streams in a fixed amount of state.

Keys are hashed to ``buckets`` state instances. Each has arrays of a fixed size, whatever the number of keys: a pair of Bloom
filters that take turns, or rows of decayed counters. A micro-batch of a bucket is one vectorized step, so within it keys do
not disturb each other.

Cases: null keys are keys of their own (``xxhash64`` skips them, so ``(null, x)`` and ``(x, null)`` are one key); a row without
time has a rate of null and is not added; rows with equal ``seq`` are told apart by their order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillstone.functions.decay import rate_constant

BUCKETS = 64
RATE_OF_ERRORS = 0.05
U64 = np.uint64


def _dealt(rows: DataFrame, keys: Sequence[str], buckets: int, *names: str) -> DataFrame:
    """``names``, two hashes of the keys and the bucket they are in."""
    one, two = F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)
    return rows.select(*names, one.alias("hash_one"), two.alias("hash_two"), F.pmod(one, F.lit(buckets)).cast("int").alias("bucket"))


def slots(one: np.ndarray, two: np.ndarray, count: int, width: int) -> np.ndarray:
    """``count`` slots below ``width`` for each pair of hashes; the bits that chose the bucket are mixed away."""
    one = one.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15)
    step = two.astype(np.int64).view(U64) | U64(1)
    return (((one ^ (one >> U64(29)))[:, None] + np.arange(count, dtype=U64) * step[:, None]) >> U64(11)).astype(np.int64) % width


class RotatingFilters(StatefulProcessor):
    """Two Bloom filters of ``bits`` bits: one learns, the other holds what was learned before.

    A key is known if either filter has all its slots. When the share of bits that are set in the learning filter reaches
    ``fill``, it takes the place of the other one, and an empty filter learns.
    """

    def __init__(self, bits: int, hashes: int, fill: float, seq: str) -> None:
        self.bits, self.hashes, self.fill, self.seq = bits, hashes, fill, seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.filters = handle.getValueState("filters", "learning binary, held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("row", kind="stable")
        if self.filters.exists():
            learning, held = (np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in self.filters.get())
        else:
            learning, held = np.zeros(self.bits, bool), np.zeros(self.bits, bool)
        first = ~batch.duplicated(["hash_one", "hash_two"]).to_numpy()
        places = slots(batch["hash_one"].to_numpy()[first], batch["hash_two"].to_numpy()[first], self.hashes, self.bits)
        new = np.zeros(len(places), bool)
        # Pieces set at most a 64th of the bits, so a filter is never much fuller than `fill`.
        piece = max(1, self.bits // (64 * self.hashes))
        for at in range(0, len(places), piece):
            part = places[at : at + piece]
            new[at : at + piece] = ~(learning[part].all(axis=1) | held[part].all(axis=1))
            learning[part] = True
            if learning.mean() >= self.fill:
                learning, held = np.zeros(self.bits, bool), learning
        self.filters.update((np.packbits(learning).tobytes(), np.packbits(held).tobytes()))
        flags = np.zeros(len(batch), bool)
        flags[first] = new
        yield pd.DataFrame({self.seq: batch["row"].to_numpy(), "new": flags})

    def close(self) -> None:
        pass


def filter_size(capacity: int, errors: float = RATE_OF_ERRORS) -> tuple[int, int, float]:
    """Bits (a multiple of 8), hashes and fill of one filter that learns ``capacity`` keys until it is held.

    ``errors`` is the share of new keys that the two filters, both full, take for known.
    """
    hashes = max(1, int(np.ceil(-np.log2(errors))))
    fill = float((errors / 2) ** (1 / hashes))
    return -(-int(np.ceil(-capacity * hashes / np.log1p(-fill))) // 8) * 8, hashes, fill


def probably_new(
    rows: DataFrame, keys: Sequence[str], seq: str, capacity: int, errors: float = RATE_OF_ERRORS, buckets: int = BUCKETS
) -> DataFrame:
    """``seq, new``: whether a stream's row is, probably, the first of its keys.

    A key seen since the last turn of its bucket's filters, or in the turn before, is never called new. A turn comes after about
    ``capacity / buckets`` different keys of a bucket; the share of new keys that are missed is at most about ``errors``.
    State is ``2 * buckets`` filters.
    """
    bits, hashes, fill = filter_size(-(-capacity // buckets), errors)
    dealt = _dealt(rows, keys, buckets, F.col(seq).cast("long").alias("row")).groupBy("bucket")
    return dealt.transformWithStateInPandas(
        statefulProcessor=RotatingFilters(bits, hashes, fill, seq),
        outputStructType=f"`{seq}` long, new boolean", outputMode="Append", timeMode="None",
    )


def decayed_sums(keys: np.ndarray, t: np.ndarray, quantity: np.ndarray, start: np.ndarray, decay: float) -> np.ndarray:
    """Decayed sum of each key after each of its rows, given what it had at its first row.

    Rows are ordered by key, then time; ``start`` is read at the first row of a key. Sums of 1, 2, 4, ... rows are put
    together, so factors are at most 1 whatever time passes.
    """
    head = np.append(True, keys[1:] != keys[:-1])
    keep = np.where(head, 0.0, np.exp(-decay * np.diff(t, prepend=t[:1])))
    total = quantity + np.where(head, start, 0.0)
    step = 1
    while step < len(keys) and keep[step:].any():
        total[step:] = total[step:] + keep[step:] * total[:-step]
        keep[step:] = keep[step:] * keep[:-step]
        keep[:step] = 0.0
        step *= 2
    return total


class DecayedCounters(StatefulProcessor):
    """Rows of decayed counters, each with the time it was set; a key reads the least of its counters.

    A key's counters are raised to what the key has, and no further.
    """

    def __init__(self, width: int, hashes: int, beta: float, seq: str) -> None:
        self.width, self.hashes, self.decay, self.seq = width, hashes, rate_constant(beta), seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "clock long, value binary, since binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        lost = batch[batch["at"].isna()]
        batch = batch[batch["at"].notna()].sort_values(["hash_one", "hash_two", "at", "row"], kind="stable")
        if len(lost):
            yield pd.DataFrame({self.seq: lost["row"].to_numpy(), "rate": np.full(len(lost), None, object)}).astype({"rate": "Float64"})
        if not len(batch):
            return
        clock, value, since = 0, np.zeros(self.hashes * self.width), np.zeros(self.hashes * self.width, np.int64)
        if self.counters.exists():
            clock, value, since = self.counters.get()
            value, since = np.frombuffer(value, np.float64).copy(), np.frombuffer(since, np.int64).copy()
            t = np.maximum(batch["at"].to_numpy(np.int64), clock)
        else:
            t = batch["at"].to_numpy(np.int64)
        one, two = batch["hash_one"].to_numpy(), batch["hash_two"].to_numpy()
        keys = np.cumsum(np.append(0, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        places = slots(one, two, self.hashes, self.width) + np.arange(self.hashes) * self.width
        held = value[places] * np.exp(-self.decay * np.maximum(t[:, None] - since[places], 0))
        rates = decayed_sums(keys, t, self.decay * batch["quantity"].fillna(0.0).to_numpy(np.float64), held.min(axis=1), self.decay)
        last = np.append(keys[1:] != keys[:-1], True)
        touched, own_t = places[last].ravel(), np.repeat(t[last], self.hashes)
        set_at = since.copy()
        np.maximum.at(set_at, touched, own_t)
        value *= np.where(value > 0, np.exp(-self.decay * (set_at - since)), 0.0)
        np.maximum.at(value, touched, np.repeat(rates[last], self.hashes) * np.exp(-self.decay * (set_at[touched] - own_t)))
        self.counters.update((int(max(clock, t.max())), value.tobytes(), set_at.tobytes()))
        yield pd.DataFrame({self.seq: batch["row"].to_numpy(), "rate": rates})

    def close(self) -> None:
        pass


def sketched_rates(
    rows: DataFrame, keys: Sequence[str], t: str, seq: str, quantity: str, beta: float,
    width: int = 1 << 12, hashes: int = 4, buckets: int = BUCKETS,
) -> DataFrame:
    """``seq, rate``: decayed rate of the keys of a stream's row, the row included; never less than the exact rate.

    ``t`` counts seconds. Quantities must not be negative. A late row is added, and read, at the latest time its bucket has seen.
    With K active keys in a bucket a rate is too large only if each of the key's counters is shared, a chance of about
    ``(1 - exp(-K / width)) ** hashes``. State is ``buckets * hashes * width`` counters of 16 bytes.
    """
    names = [F.col(seq).cast("long").alias("row"), F.col(t).cast("long").alias("at"), F.col(quantity).cast("double").alias("quantity")]
    return _dealt(rows, keys, buckets, *names).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=DecayedCounters(width, hashes, beta, seq),
        outputStructType=f"`{seq}` long, rate double", outputMode="Append", timeMode="None",
    )
