"""Stupid-backoff scores of documents under a language model of all other documents (operator 9).

The model has words and word pairs of the whole corpus; what a document itself contributes is taken off its counts, so it
is scored by the rest of the corpus. A word after another scores ``c(pair) / c(first)``, or ``BACKOFF * c(word) / N`` where the
pair is not known, or ``BACKOFF * UNSEEN / N`` where the word is not known either; a first word scores as after an unknown
pair without the factor. Scores are summed as logarithms per document.

Exploded n-grams of a corpus are several times its size, so they travel packed: documents are dealt into blocks by a hash
of their id, and a block sends each n-gram once, with its count, to the partition of the count table that the n-gram's
hash names. There counts are added up and joined back to the n-grams asked for; the answer is as long as the
request and in its order, so it holds counts alone. A block then joins answers to its documents' n-grams. Blocks and
partitions of the table grow in number with the corpus and not in size.

Cases: null and empty texts have no words and score 0; equal rows score alike, as each is left out as its own; a long text
makes its block larger; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm import words

BACKOFF = 0.4
UNSEEN = 0.5
BLOCK_CHARS = 8 << 20
TABLE_WORDS = 1 << 21
U64 = np.uint64
SPACES = " \t\n\u000b\f\r"


def grams_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of word pairs, which never meet: their lowest bit differs."""
    pairs = words.grams(hashes, 2, words.SHINGLE) if len(hashes) > 1 else hashes[:0]
    return hashes & ~U64(1), pairs | U64(1)


def parted(grams: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams in the order of their table and hash, their counts, the tables and where each begins."""
    found, counts = np.unique(grams, return_counts=True)
    table = (words.mix(found) % U64(tables)).astype(np.int32)
    order = np.argsort(table, kind="stable")
    names, begin = np.unique(table[order], return_index=True)
    return found[order], counts[order], names, np.append(begin, len(found))


def _block(text: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [h for _, _, texts in words.documents(text, lower=True) for h in texts]


def _all_grams(texts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, U64), *[g for h in texts for g in grams_of(h)]])


def _ask(tables: int):  # noqa: ANN202
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found, counts, names, begin = parted(_all_grams(_block(rows["text"])), tables)
        parts = list(zip(begin[:-1], begin[1:]))
        return pa.table({
            "block": pa.array(np.full(len(names), key[0].as_py(), np.int64)),
            "part": pa.array(names),
            "grams": pa.array([found[a:b].tobytes() for a, b in parts], pa.binary()),
            "counts": pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in parts], pa.binary()),
        })

    return run


def _answer(key: tuple, rows: pa.Table) -> pa.Table:
    """The count table of a part, joined back to each block's n-grams."""
    asked = [np.frombuffer(x, U64) for x in rows["grams"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["counts"].to_pylist()])
    _, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(place, counts).astype(np.int64)[place]
    at = np.cumsum([0, *map(len, asked)])
    totals = [total[a:b].tobytes() for a, b in zip(at, at[1:])]
    return pa.table({"block": rows["block"], "part": rows["part"], "totals": pa.array(totals, pa.binary())})


def _score(tables: int, n_words: int):  # noqa: ANN202
    def own(values: np.ndarray) -> np.ndarray:
        """How often each value stands in ``values``."""
        _, place, counts = np.unique(values, return_inverse=True, return_counts=True)
        return counts[place]

    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _block(rows["text"])
        found, _, _, _ = parted(_all_grams(texts), tables)
        parts = answers["part"].to_numpy()
        totals = answers["totals"].to_pylist()
        total = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(totals[i], np.int64) for i in np.argsort(parts)]])
        order = np.argsort(found)
        found, total = found[order], total[order]
        scores = np.zeros(len(texts))
        for k, hashes in enumerate(texts):
            if not len(hashes):
                continue
            single, pair = grams_of(hashes)
            rest = max(n_words - len(hashes), 1)
            ones = total[np.searchsorted(found, single)] - own(single)
            twos = total[np.searchsorted(found, pair)] - own(pair)
            alone = np.log10(np.maximum(ones, UNSEEN) / rest)
            after = np.where(twos > 0, np.log10(np.maximum(twos, 1) / np.maximum(ones[:-1], 1)), alone[1:] + np.log10(BACKOFF))
            scores[k] = alone[0] + after.sum()
        n = pa.array([len(h) for h in texts], pa.int64())
        return pa.table({"doc_id": rows["doc_id"], "n_words": n, "score": pa.array(scores)})

    return run


def scored(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, score`` (sum of log10) and ``mean_score`` per word of each document."""
    text = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACES))
    n = F.when(F.length(text) > 0, F.size(F.split(text, r"[ \t-\r]+"))).otherwise(0)
    sizes = docs.agg(F.sum(n).alias("words"), F.sum(F.length("text")).alias("chars")).first()
    n_words, chars = sizes.words or 0, sizes.chars or 0
    blocks, tables = chars // BLOCK_CHARS + 1, n_words // TABLE_WORDS + 1
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = rows.groupBy("block").applyInArrow(_ask(tables), "block bigint, part int, grams binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "block bigint, part int, totals binary")
    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(tables, n_words), "doc_id bigint, n_words bigint, score double")
    return out.select("*", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).otherwise(0.0).alias("mean_score"))
