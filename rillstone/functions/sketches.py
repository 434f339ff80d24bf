"""Hashed stand-ins for exact keyed state, written as relations: a Bloom filter and decayed counters.

A key is hashed to a few slots of a table whose width follows the number of different keys. A slot is a group of rows, so
both sketches are aggregates and joins, and no task holds a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions.decay import decayed_sums
from rillstone.functions.skew import DEFAULT_SKEW, Skew

BITS_PER_KEY = 8
HASHES = 5
COUNTERS_PER_KEY = 8
COUNTER_ROWS = 3


def _hash(keys: Sequence[str], part: int) -> Column:
    """48 bits of the keys' MD5, which other engines compute alike."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1 + 12 * part, 12), 16, 10).cast("long")


def slots(keys: Sequence[str], count: int, width: int) -> Column:
    """``count`` slots below ``width``, from two hashes."""
    return F.array(*[F.pmod(_hash(keys, 0) + i * _hash(keys, 1), F.lit(width)) for i in range(count)])


def probably_new(
    df: DataFrame, keys: Sequence[str], seq: str, name: str = "new", bits_per_key: int = BITS_PER_KEY, hashes: int = HASHES
) -> DataFrame:
    """Add whether a Bloom filter that learns every row sees the keys for the first time.

    A slot is set at the smallest ``seq`` of all keys that own it. So the first row of a key is taken for known exactly
    if each of its slots was set before; the other rows of the key are known. ``seq`` is unique.
    """
    first = df.groupBy(*keys).agg(F.min(seq).alias("_first"))
    width = max(1, bits_per_key * first.count())
    owned = first.select("_first", F.explode(slots(keys, hashes, width)).alias("_slot"))
    since = owned.groupBy("_slot").agg(F.min("_first").alias("_set"))
    fresh = owned.join(since, "_slot").filter("_set = _first").select(F.col("_first").alias(seq)).distinct()
    return df.join(fresh.withColumn("_new", F.lit(True)), seq, "left").withColumn(name, F.coalesce("_new", F.lit(False))).drop("_new")


def sketched_sums(
    df: DataFrame, keys: Sequence[str], t: str, seq: str, name: str, quantity: str, beta: float,
    counters_per_key: int = COUNTERS_PER_KEY, rows: int = COUNTER_ROWS, skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Add the smallest of ``rows`` decayed counters of the keys; other keys in the same counters make it too large.

    Each counter is a decayed sum like any other, with its hot ones split. ``seq`` is unique.
    """
    width = max(1, counters_per_key * df.select(*keys).distinct().count())
    places = F.posexplode(slots(keys, rows, width)).alias("_row", "_slot")
    counters = df.select(seq, t, quantity, places)
    rated = decayed_sums(counters, ["_row", "_slot"], t, seq, {"_sum": (quantity, beta)}, skew)
    least = rated.groupBy(seq).agg(F.min("_sum").alias(name))
    return df.join(least, seq)
