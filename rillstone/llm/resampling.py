"""Importance resampling of documents towards a target (operator 7).

Words and word pairs are hashed to ``BUCKETS`` numbers. Two generative models give each bucket a probability: one from the
target texts, one from all texts. The importance of a document is the mean logarithm of their ratio over its n-grams times
``LENGTH`` at most, so that long texts are not decided by their length; Gumbel noise from a hash of the id and the largest
sums are a sample without replacement, proportional to importance. The size of the sample is a share of the documents.

Counts of buckets are added up inside each task first, so what is shuffled does not follow the text. The k-th largest sum
is found through counts of the sums' 2^-``BITS`` steps: only the rows of one step are ranked.

Cases: null and empty texts have no n-grams and importance 0; a null label is no label; without target texts all
importances are 0; equal rows (same id and text) get equal sums and are counted before they are ranked; ties go to
smaller ids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillstone.llm import shared, words

BUCKETS = 10_000
LENGTH = 100
BITS = 12
TARGETS = 50_000
"""The target model is fitted on so many labelled texts at most."""
COPIES = 1000
U64 = np.uint64


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of all words and word pairs."""
    pairs = words.grams(hashes, 2, words.SHINGLE) if len(hashes) > 1 else hashes[:0]
    return (np.concatenate([hashes, pairs]) % U64(BUCKETS)).astype(np.int64)


def _counts(rows: DataFrame) -> DataFrame:
    """``bucket, raw, target`` of each task: n-grams of all rows and of those with ``target``."""
    schema = "bucket int, raw bigint, target bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, aim = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            target = batch["target"].to_numpy(zero_copy_only=False)
            for at, _, texts in words.documents(batch["text"], lower=True):
                found = [buckets(h) for h in texts]
                aimed = [f for k, f in enumerate(found, at) if target[k]]
                raw += np.bincount(np.concatenate(found), minlength=BUCKETS)
                if aimed:
                    aim += np.bincount(np.concatenate(aimed), minlength=BUCKETS)
        used = np.flatnonzero(raw)
        columns = [pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(aim[used])]
        yield pa.record_batch(columns, ["bucket", "raw", "target"])

    return rows.select("target", "text").mapInArrow(run, schema)


def ratios(rows: DataFrame) -> np.ndarray:
    """Logarithm of target over raw probability of each bucket; ``BUCKETS`` rows come to the driver."""
    raw, aim = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in _counts(rows).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[row.bucket], aim[row.bucket] = row.raw, row.target
    if not aim.any():
        return np.zeros(BUCKETS)
    return np.log((aim + 1) / (aim.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def importances(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``doc_id, n_grams, importance`` of each row."""
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop, texts in words.documents(batch["text"], lower=True):
                n, mean = np.zeros(stop - at, np.int64), np.zeros(stop - at)
                for k, hashes in enumerate(texts):
                    found = table.value[buckets(hashes)]
                    if len(found):
                        n[k], mean[k] = len(found), found.mean() * min(len(found), LENGTH)
                yield pa.record_batch([batch["doc_id"].slice(at, stop - at), pa.array(n), pa.array(mean)], ["doc_id", "n_grams", "importance"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_grams bigint, importance double")


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise from a hash of the id."""
    part = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)), 11).cast("double")
    return -F.log(-F.log((part + 0.5) / float(1 << 53)))


def top_share(rows: DataFrame, share: float) -> DataFrame:
    """``rows`` (``doc_id, key``) with ``kept``: whether the key is among the largest ``share`` of all keys, rounded up."""
    rows = rows.withColumn("_step", F.floor(F.col("key") * (1 << BITS)).cast("long"))
    steps = shared.checkpointed(rows.groupBy("_step").agg(F.count(F.lit(1)).alias("n")))
    total = steps.agg(F.sum("n")).first()[0] or 0
    need = -(-int(total * share * 1_000_000) // 1_000_000)
    # Steps of a coarse width are counted first, so that no task sees all steps in order.
    low, above = None, 0
    for width in (1 << 20, 1 << 10, 1):
        coarse = steps.filter((F.col("_step") >= low[0]) & (F.col("_step") < low[1])) if low else steps
        counts = coarse.groupBy(F.floor(F.col("_step") / width).cast("long").alias("c")).agg(F.sum("n").alias("n")).orderBy(F.desc("c"))
        for row in counts.toLocalIterator():
            if above + row.n >= need:
                low = (row.c * width, (row.c + 1) * width)
                break
            above += row.n
        else:
            return rows.withColumn("kept", F.lit(True)).drop("_step")
    # Equal rows of the step are counted first, so what is put in order is as long as the step has different rows.
    edge = rows.filter(F.col("_step") == low[0])
    names = [c for c in edge.columns if c != "_step"]
    kinds = edge.groupBy(*names, "_step").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_step").orderBy(F.desc("key"), *[c for c in names if c != "key"])
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kinds = kinds.withColumn("_keep", F.greatest(F.lit(0), F.least(F.col("_n"), F.lit(need - above) - upto + F.col("_n"))))
    parts = F.array(F.struct(F.lit(True).alias("kept"), F.col("_keep").alias("_n")), F.struct(F.lit(False).alias("kept"), (F.col("_n") - F.col("_keep")).alias("_n")))
    ranked = kinds.select(*names, F.inline(parts)).filter("_n > 0")
    # In two steps, so that no array is as long as a row has copies.
    ranked = ranked.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES))).alias("_k"))
    times = F.least(F.lit(COPIES), F.col("_n") - F.col("_k") * COPIES).cast("int")
    ranked = ranked.select(*names, "kept", F.explode(F.array_repeat(F.lit(1), times)).alias("_one")).drop("_one")
    rest = rows.filter(F.col("_step") != low[0]).withColumn("kept", F.col("_step") > low[0])
    return rest.drop("_step").unionByName(ranked)


def resampled(docs: DataFrame, target_ids: DataFrame, share: float = 0.85, seed: int = 7, targets: int = TARGETS) -> DataFrame:
    """``doc_id, n_grams, importance, key, kept``; ``target_ids`` has the ``doc_id`` of the target texts.

    Target texts come from ``docs``. The target model is fitted on ``targets`` labelled ids at most, by hash of the id, so that
    they can be broadcast and no text is shuffled; the model of all texts has no such bound.
    """
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(targets).withColumn("target", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left")
    ratio = ratios(rows.select(F.coalesce("target", F.lit(False)).alias("target"), "text"))
    scores = importances(docs, ratio).withColumn("key", F.col("importance") + gumbel(F.col("doc_id"), seed))
    return top_share(shared.written(scores), share)
