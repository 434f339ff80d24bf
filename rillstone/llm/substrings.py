"""Removal of passages that another document with a smaller id already has (operator 8).

A window is ``length`` consecutive words of a text. Every window has a Rabin-Karp hash; a word is removed if it lies in a
window that also starts in a document with a smaller id. Counting each window of a corpus would shuffle every word, so
windows are first put into *runs*: a run is a maximal stretch of windows of one text whose smallest hash of ``GRAM`` words
is the same. Equal windows have equal smallest hashes, so they can only meet in runs with the same one:

1. of each run, the smallest hash and one hash of all its words are counted in Spark;
2. runs whose smallest hash stands in one document only are done, nothing of them is repeated;
3. a run with all its words in a document with a smaller id is a removal interval as it is;
4. of the runs that are left, the hash of each window is counted, and repeated windows become intervals.

Intervals of a document are merged into maximal ones, and its other words are kept. Hashes are pairs of 64 bits (smallest
hash with run hash, or with window hash).

Cases: a null text has no words; shorter texts have no window and stay whole; rows with the same id never remove each
other's words, and equal rows get equal results; rows without id keep all words; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm import shared, words

LENGTH = 50
GRAM = 16
_GRAM_POWERS = words._powers(words.SHINGLE_BASE, 64)
_SPAN = words.Powers(words.WINDOW_BASE)
U64 = np.uint64


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def span_hashes(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of the words ``first`` to ``end`` for each pair, from one running sum."""
    _SPAN.grow(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * _SPAN.up[: len(hashes)], out=sums[1:])
    return words.mix((sums[end] - sums[first]) * _SPAN.down[first] + (end - first).astype(U64))


def runs(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest hash, hash of all words, first window and number of windows of each run of a text."""
    low = smallest(words.grams(hashes, GRAM, _GRAM_POWERS), length - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.append(first, len(low)))
    return low[first], span_hashes(hashes, first, first + count + length - 1), first, count


def _runs_of(rows: DataFrame, length: int) -> DataFrame:
    schema = "doc_id bigint, row bigint, low bigint, span bigint, start int, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = batch["doc_id"].to_numpy(), batch["row"].to_numpy()
            for at, stop, texts in words.documents(batch["text"]):
                found = [(k, *runs(h, length)) for k, h in enumerate(texts, at) if len(h) >= length]
                if found:
                    which = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                    low, span, start, n = (np.concatenate([f[i] for f in found]) for i in range(1, 5))
                    columns = [ids[which], row[which], low.view(np.int64), span.view(np.int64)]
                    columns += [start.astype(np.int32), n.astype(np.int32)]
                    yield pa.record_batch([pa.array(c) for c in columns], ["doc_id", "row", "low", "span", "start", "n"])

    return rows.mapInArrow(run, schema)


def _windows_of(rows: DataFrame, length: int) -> DataFrame:
    """Hash of each window in the runs ``wanted`` of a text."""
    schema = "doc_id bigint, row bigint, low bigint, window bigint, start int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row, wanted = batch["doc_id"].to_numpy(), batch["row"].to_numpy(), batch["wanted"].to_pylist()
            for at, _, texts in words.documents(batch["text"]):
                for k, hashes in enumerate(texts, at):
                    first = np.concatenate([np.arange(w["start"], w["start"] + w["n"]) for w in wanted[k]])
                    low = np.repeat([w["low"] for w in wanted[k]], [w["n"] for w in wanted[k]])
                    window = span_hashes(hashes, first, first + length).view(np.int64)
                    same = np.ones(len(first), np.int64)
                    columns = [same * ids[k], same * row[k], low, window, first.astype(np.int32)]
                    yield pa.record_batch([pa.array(c) for c in columns], ["doc_id", "row", "low", "window", "start"])

    return rows.mapInArrow(run, schema)


def repeated(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, row, cuts``: the removal intervals of ``rows`` (``doc_id, row, text``) in windows, not yet merged."""
    shared.bounded_batches(rows.sparkSession)
    known = rows.filter("doc_id IS NOT NULL")
    all_runs = shared.written(_runs_of(known, length))
    docs_of = all_runs.groupBy("low").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    common = shared.written(docs_of.filter("a < b").select("low"))
    all_runs = shared.written(all_runs.join(common, "low", "left_semi"))
    spans = all_runs.groupBy("low", "span").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("b"))
    same = shared.written(spans.filter("first < b").select("low", "span", "first"))
    placed = all_runs.join(same, ["low", "span"], "left")
    whole = placed.filter("doc_id > first").select("doc_id", "row", "start", "n")
    open_runs = placed.filter("first IS NULL OR doc_id = first")
    # Sets and not lists, and one row of equal ones: copies of a row neither add entries nor windows.
    wanted = open_runs.groupBy("doc_id", "row").agg(F.collect_set(F.struct("low", "start", "n")).alias("wanted"))
    asked = known.join(wanted, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    windows = _windows_of(asked.select("doc_id", "row", "text", "wanted"), length)
    counted = windows.groupBy("low", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("b"))
    counted = shared.written(counted.filter("first < b").select("low", "window", "first"))
    single = windows.join(counted, ["low", "window"]).filter("doc_id > first")
    single = single.select("doc_id", "row", "start", F.lit(1).alias("n"))
    cuts = whole.unionByName(single)
    return cuts.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("cuts"))


def merged(cuts: list[dict], length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each maximal interval."""
    first = np.array([c["start"] for c in cuts], np.int64)
    end = first + np.array([c["n"] for c in cuts], np.int64) + length - 1
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], first[1:] > end[:-1]])
    return first[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def deduplicated(docs: DataFrame, length: int = LENGTH, as_is: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: kept words joined by one space. Other columns of ``docs`` follow it.

    With ``as_is`` a text of which nothing is removed stays as it is, null included.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]) if others else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text", packed.alias("others"))
    cuts = repeated(rows.select("doc_id", "row", "text"), length)
    joined = rows.join(cuts, ["doc_id", "row"], "left").select("doc_id", "text", "cuts", "others")
    kind = joined.schema["others"].dataType.simpleString() if others else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_words, n_removed, kept = [], [], []
                for data, gone in zip(part["text"].cast(pa.large_binary()).to_pylist(), part["cuts"].to_pylist()):
                    found = (data or b"").split()
                    n_words.append(len(found))
                    if gone:
                        rest, upto = [], 0
                        for first, end in zip(*merged(gone, length)):
                            rest += found[upto:first]
                            upto = end
                        found = rest + found[upto:]
                    n_removed.append(n_words[-1] - len(found))
                    kept.append(data if as_is and not gone else b" ".join(found))
                columns = [part["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
                text = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.record_batch([*columns, text, part["others"]], ["doc_id", "n_words", "n_removed", "kept", "others"])

    out = joined.mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, kept string, others {kind}")
    extra = [F.col(f"others.c{i}").alias(c) for i, c in enumerate(others) if c not in ("n_words", "n_removed", "kept")]
    return out.select("doc_id", "n_words", "n_removed", "kept", *extra)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each document."""
    out = deduplicated(docs.select("doc_id", "text"), length)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
