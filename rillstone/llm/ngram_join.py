"""Jaccard join of documents on word shingles with prefix filters under several token orders (operator 6).

Two documents link if the Jaccard similarity of their sets of ``width``-word shingles is at least ``percent`` / 100.

1. *Sets.* One pass gives each document's number of shingles and a 128-bit digest of its set, and a table of counters
   of all shingles, one for 64 shingles, 2^24 at most (16 MB of levels in each task). A task hands its counters on as
   compressed blocks of 65 536, a few bits each. Documents with equal sets are one class and need no comparison.
2. *Orders.* An order sorts shingles by the level of their counter, so that frequent ones come last, and then by a hash
   of the order's own. Of n shingles the first ``n - ceil(percent n / 100) + 1`` are the prefix: linked sets share a prefix
   shingle under every order.
3. *Candidates* under the first order are compared in two steps, so that a large group of near copies does not
   become all of its pairs. First each document is compared with the documents that are the smallest ones of most of its
   prefix shingles. Then documents that still share prefix shingles across different components are compared with each
   other.
4. *Filters and verification.* A pair must agree in size, in as many prefix shingles under the first order as a link
   needs, and in a prefix shingle under each of the other orders. The filters are intersected on prefixes alone; only the texts
   of pairs that pass all of them are brought together and compared. A filter of bits, one hash for each id, keeps
   most other texts from moving at all.

Pairs within a component that is already known are never formed: no link between different components is lost.

Cases: null and empty texts have no shingles and link with nothing; fewer than ``width`` words make one shingle of all
words; equal texts link; rows with the same id count as one document with the links of all its texts, each row with its own
number of shingles; a row without id has no component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillstone.llm import shared, words
from rillstone.llm.components import components

LEAST_COUNTERS, MOST_COUNTERS = 1 << 18, 1 << 24
SHINGLES_PER_COUNTER = 64
BLOCK = 1 << 16
"""Counters in one row of a task's table."""
CHARS_PER_WORD = 6
ORDERS = (0x51ED270B9F4A7C15, 0x2545F4914F6CDD1D, 0x6C62272E07BB0142)
HEADS = 2
"""A document is compared with so many of the smallest documents of its prefix shingles; the second step has the rest."""
BITS_PER_PAIR, MOST_BITS = 32, 1 << 27
"""Bits of the filter of ids in front of the texts: 16 for each id of a pair; beyond 16 MB it lets more texts pass."""
U64 = np.uint64


def counters(chars: int) -> int:
    """How many counters a corpus of so many characters gets: a power of two that follows its number of shingles."""
    wanted = chars // CHARS_PER_WORD // SHINGLES_PER_COUNTER
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << max(wanted - 1, 0).bit_length()))


def counter(tokens: np.ndarray, size: int) -> np.ndarray:
    return (words.mix(tokens ^ U64(0xA0761D6478BD642F)) >> U64(65 - size.bit_length())).astype(np.int64)


def levels(counts: np.ndarray, mean: float) -> np.ndarray:
    """Level of each counter: 0 for what chance explains, else the binary logarithm of the count."""
    high = counts > mean + 8 * np.sqrt(mean) + 16
    return np.where(high, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0).astype(np.uint8)


def packed(counts: np.ndarray) -> bytes:
    """Counters in as few bytes each as the largest one needs (told by the first byte), compressed."""
    width = next(w for w in (1, 2, 4) if int(counts.max()) < 1 << 8 * w)
    return bytes([width]) + pa.compress(counts.astype(f"<u{width}").tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[1:], n * data[0], "zstd", asbytes=True), f"<u{data[0]}")


def prefix(tokens: np.ndarray, order: int, level: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set under an order; as many as a linked set cannot do without."""
    n = len(tokens)
    size = n - -(-percent * n // 100) + 1
    key = (words.mix(tokens ^ U64(order)) >> U64(6)) | (level[counter(tokens, len(level))].astype(U64) << U64(58))
    return tokens if size >= n else tokens[np.argpartition(key, size - 1)[:size]]


def _sets(rows: DataFrame, width: int, size: int) -> DataFrame:
    """One row for each text (``doc_id, n, a, b``), and after each task its counters (block ``a``, ``counts``)."""
    names = ["doc_id", "n", "a", "b", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        for batch in batches:
            for at, stop, texts in words.documents(batch["text"], lower=True):
                sets = [words.shingles(h, width) for h in texts]
                n = np.array([len(s) for s in sets], np.int64)
                a = np.array([words.mix(s).sum() for s in sets], U64)
                b = np.array([words.mix(s ^ U64(ORDERS[1])).sum() for s in sets], U64)
                met, times = np.unique(counter(np.concatenate(sets), size), return_counts=True)
                counts[met] += times.astype(np.uint32)
                columns = [batch["doc_id"].slice(at, stop - at), *[pa.array(x) for x in (n, a.view(np.int64), b.view(np.int64))]]
                yield pa.record_batch([*columns, pa.nulls(len(n), pa.binary())], names)
        for k in np.flatnonzero(counts.reshape(-1, BLOCK).any(axis=1)):
            block = packed(counts[k * BLOCK : (k + 1) * BLOCK])
            none = pa.nulls(1, pa.int64())
            yield pa.record_batch([none, none, pa.array([int(k)]), none, pa.array([block], pa.binary())], names)

    return rows.mapInArrow(run, "doc_id bigint, n bigint, a bigint, b bigint, counts binary")


def _levels(sets: DataFrame, size: int) -> np.ndarray:
    """Level of each counter. Blocks are summed in Spark, and come back as levels of one byte."""
    mean = (sets.filter("counts IS NULL").agg(F.sum("n")).first()[0] or 0) / size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch["a"].to_pylist(), batch["counts"].to_pylist()):
                total[k] = total.get(k, 0) + unpacked(data, BLOCK).astype(np.int64)
        for k, counts in total.items():
            yield pa.record_batch([pa.array([k]), pa.array([levels(counts, mean).tobytes()], pa.binary())], ["a", "level"])

    blocks = sets.filter("counts IS NOT NULL").select("a", "counts").repartition("a").mapInArrow(run, "a bigint, level binary")
    level = np.zeros(size, np.uint8)
    for row in blocks.collect():
        level[row.a * BLOCK : (row.a + 1) * BLOCK] = np.frombuffer(row.level, np.uint8)
    return level


def _prefixes(rows: DataFrame, width: int, percent: int, level) -> DataFrame:  # noqa: ANN001
    """``token, doc_id`` of each text's prefix under the first order; of equal sets in a task, the first one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for at, _, texts in words.documents(batch["text"], lower=True):
                tokens, docs = [], []
                for k, hashes in enumerate(texts, at):
                    found = words.shingles(hashes, width)
                    digest = (int(words.mix(found).sum()), len(found))
                    if len(found) and digest not in seen:
                        seen.add(digest)
                        tokens.append(prefix(found, ORDERS[0], level.value, percent))
                        docs.append(np.full(len(tokens[-1]), ids[k]))
                if tokens:
                    columns = [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(docs))]
                    yield pa.record_batch(columns, ["token", "doc_id"])

    return rows.mapInArrow(run, "token bigint, doc_id bigint")


def _marked(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``doc_id`` is in no pair, before their texts move.

    One bit for each hash of the ids in ``pairs``, as broadcast bitmaps of 4 KB; built-in expressions only.
    """
    size = min(MOST_BITS, max(1 << 16, 1 << (BITS_PER_PAIR * pairs.count()).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(size)) + 1
    block, place = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).select(block.alias("_block"), place.alias("_place"))
    bits = ids.groupBy("_block").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    met = rows.withColumns({"_block": block, "_place": place}).join(F.broadcast(bits), "_block")
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_place div 8 + 1 as int), 1)), 16, 10) as bigint)")
    return met.filter(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1).select(rows.columns)


def _held(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The different texts of the documents in ``pairs``: of equal rows, one. ``doc_id, row, text``."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    named = _marked(rows, pairs).select("doc_id", F.xxhash64("text").alias("row"), "text")
    return shared.written(named.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "row"]))


def _other_orders(held: DataFrame, width: int, percent: int, level) -> DataFrame:  # noqa: ANN001
    """``doc_id, row, n, orders``: the size of each text's set and its prefix under each order but the first.

    32 bits of a shingle stand for it here: two prefixes that share a shingle share its bits.
    """
    schema = "doc_id bigint, row bigint, n bigint, orders array<array<int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop, texts in words.documents(batch["text"], lower=True):
                sets = [words.shingles(h, width) for h in texts]
                firsts = [(prefix(s, o, level.value, percent) >> U64(32)).astype(np.uint32).view(np.int32) for s in sets for o in ORDERS[1:]]
                inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate(firsts)))
                orders = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * len(ORDERS[1:]), pa.int32()), inner)
                own = [batch["doc_id"].slice(at, stop - at), batch["row"].slice(at, stop - at)]
                yield pa.record_batch([*own, pa.array([len(x) for x in sets], pa.int64()), orders], ["doc_id", "row", "n", "orders"])

    return held.mapInArrow(run, schema)


def _candidates(pairs: DataFrame, held: DataFrame, width: int, percent: int, level) -> DataFrame:  # noqa: ANN001
    """``a, row_a, b, row_b``: texts of ``pairs`` that agree in size and share a prefix shingle under every order."""
    found = shared.written(_other_orders(held, width, percent, level))
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("row", "n", "orders")]), side)
    fits = F.greatest("n_a", "n_b") * percent <= F.least("n_a", "n_b") * 100
    for k in range(len(ORDERS) - 1):
        fits &= F.arrays_overlap(F.col("orders_a")[k], F.col("orders_b")[k])
    return shared.written(pairs.filter(fits).select("a", "row_a", "b", "row_b"))


def _linked(pairs: DataFrame, rows: DataFrame, width: int, percent: int, level) -> DataFrame:  # noqa: ANN001
    """Those of ``pairs`` (``a, b``, which share prefix shingles under the first order) whose texts link.

    The prefixes under the other orders are intersected first; texts travel for the pairs that are left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            keep = np.zeros(batch.num_rows, bool)
            second = words.documents(batch["text_b"], lower=True)
            ahead: list[np.ndarray] = []
            for at, stop, texts in words.documents(batch["text_a"], lower=True):
                while len(ahead) < stop - at:
                    ahead += next(second)[2]
                for k, (x, y) in enumerate(zip(texts, ahead), at):
                    x, y = words.shingles(x, width), words.shingles(y, width)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
                ahead = ahead[stop - at :]
            yield pa.record_batch([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep))

    held = _held(pairs, rows)
    texts = _candidates(pairs, held, width, percent, level)
    for side in ("a", "b"):
        texts = texts.join(held.toDF(side, f"row_{side}", f"text_{side}"), [side, f"row_{side}"])
    return texts.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def linked_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each document."""
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = counters(rows.agg(F.sum(F.length("text"))).first()[0] or 0)
    sets = shared.written(_sets(rows, width, size))
    level = spark.sparkContext.broadcast(_levels(sets, size))
    sizes = sets.filter("counts IS NULL").select("doc_id", "n", "a", "b")

    known = sizes.filter("doc_id IS NOT NULL AND n > 0")
    classes = known.groupBy("a", "b", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    classes = shared.written(classes.filter("first < last").select("a", "b", "n", "first"))
    copies = known.join(classes, ["a", "b", "n"]).filter("doc_id > first")
    copies = shared.written(copies.select("doc_id", "first").distinct())

    tokens = _prefixes(rows.filter("doc_id IS NOT NULL"), width, percent, level)
    heads = tokens.groupBy("token").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"))
    heads = shared.written(heads.filter("head < last").select("token", "head"))
    bucketed = shared.written(tokens.join(heads, "token"))

    def of_class(pairs: DataFrame) -> DataFrame:
        """Pairs of class representatives, smaller id first."""
        for side in ("a", "b"):
            first = copies.select(F.col("doc_id").alias(side), "first")
            pairs = pairs.join(first, side, "left").withColumn(side, F.coalesce("first", side)).drop("first")
        return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    n_of = sizes.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("n").alias("low"), F.max("n").alias("high"))

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes, and the number ``shared`` of prefix shingles in common, allow a link.

        Past the prefix that ends first, a set has fewer shingles than a link needs: a good part of the prefix must be
        in common. Rows with one id may have several sizes; the bounds take the widest.
        """
        for side in ("a", "b"):
            pairs = pairs.join(n_of.select(F.col("doc_id").alias(side), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}")), side)
        fits = (F.col("high_a") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low_a") * percent)
        rest = F.ceil(F.greatest("high_a", "high_b") * F.lit(percent) / 100) - 1
        need = F.ceil((F.col("low_a") + F.col("low_b")) * F.lit(percent) / (100 + percent))
        return pairs.filter(fits & (F.col("shared") + rest >= need)).select("a", "b", "shared")

    same = copies.select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    stars = bucketed.filter("doc_id <> head").groupBy(F.col("head").alias("a"), F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    most = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    stars = plausible(stars).withColumn("_r", F.row_number().over(most)).filter(F.col("_r") <= HEADS)
    stars = shared.written(of_class(stars.select("a", "b")))
    star_links = shared.written(_linked(stars, rows, width, percent, level))
    found = components(same.unionByName(star_links))

    labelled = bucketed.select("token", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled = labelled.select("token", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    several = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    labelled = shared.written(labelled.join(several.select("token"), "token", "left_semi"))
    other = labelled.select("token", F.col("doc_id").alias("b"), F.col("component").alias("component_b"))
    rest = labelled.withColumnRenamed("doc_id", "a").join(other, "token").filter("a < b AND component <> component_b")
    rest = plausible(rest.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")))
    rest = shared.written(of_class(rest.select("a", "b")).join(stars, ["a", "b"], "left_anti"))
    rest_links = shared.written(_linked(rest, rows, width, percent, level))
    links = same.unionByName(star_links).unionByName(rest_links)
    found = components(links) if not rest_links.isEmpty() else found
    out = sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
