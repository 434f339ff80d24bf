"""Operators 6 and 8 against brute force."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpora  # noqa: E402

from rillstone.llm import catalog, components, ngram_join, shared, substrings  # noqa: E402


@pytest.fixture(scope="module")
def texts(spark, tiny):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]


def edited(words, rnd, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return " ".join(words)


def near_copies():
    """Chains of ever more distant copies, groups of near copies, and texts that share one long passage."""
    rnd = random.Random(9)
    rows, base = [], [f"b{rnd.randrange(500)}" for _ in range(120)]
    chain = list(base)
    for i in range(40):
        chain[(7 * i) % 120] = f"c{i}"
        rows.append(" ".join(chain))
    rows += [edited(base, rnd, rnd.randrange(4)) for _ in range(60)]
    passage = [f"p{rnd.randrange(900)}" for _ in range(60)]
    rows += [" ".join([*passage, *(f"q{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 40)))]) for _ in range(60)]
    rows += rows[40:50]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def joined(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(docs).collect()}


def test_near_copies(spark):
    rows = near_copies()
    want = corpora.components(rows)
    assert joined(spark, rows) == {i: (len(corpora.shingle_set(t)), want[i]) for i, t in rows}


def test_join_query(spark, tiny, texts):
    want = corpora.components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in catalog.op6_ngram_jaccard(spark, tiny).collect()}
    assert got == {i: (len(corpora.shingle_set(t)), want[i]) for i, t in texts}


def test_join_of_odd_rows(spark):
    rows = [(r[0], r[1]) for r in corpora.odd_rows()]
    want = corpora.components(rows)
    got = ngram_join.linked_components(corpora.odd(spark)).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(
        ((i, len(corpora.shingle_set(t)), want.get(i)) for i, t in rows), key=key
    )
    assert ngram_join.linked_components(corpora.empty(spark)).count() == 0


def test_every_order_keeps_links():
    """Linked sets share a prefix shingle under each order."""
    rnd, level = np.random.default_rng(4), np.zeros(ngram_join.counters(0), np.uint8)
    for n in [1, 2, 3, 4, 7, 20, 101]:
        a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
        changed = n // 8
        b = np.unique(np.concatenate([a[changed:], rnd.integers(0, 1 << 62, changed).astype(np.uint64)]))
        for order in ngram_join.ORDERS:
            assert len(np.intersect1d(ngram_join.prefix(a, order, level, 75), ngram_join.prefix(b, order, level, 75)))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 300), (300, 250), (5, 5)]
    rows = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in rows} == {**{i: 0 for i in range(91)}, 200: 200, 250: 200, 300: 200}


def digest(kept):
    return hashlib.sha256(kept).hexdigest()


def test_substring_query(spark, tiny, texts):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in catalog.op8_substring_dedup(spark, tiny).collect()}
    want = {(i, n, gone, digest(kept)) for i, n, gone, kept in corpora.removed(texts)}
    assert got == want and any(w[2] for w in want)


def test_substrings_of_edited_copies(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for length in (20, 50):
        got = {(r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in substrings.deduplicated(docs, length).collect()}
        assert got == set(corpora.removed(rows, length))


def test_substrings_of_odd_rows(spark):
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    got = substrings.digests(corpora.odd(spark)).collect()
    want = [(i, n, gone, digest(kept)) for i, n, gone, kept in corpora.removed([(r[0], r[1]) for r in corpora.odd_rows()])]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert substrings.digests(corpora.empty(spark)).count() == 0


def sharing(passage_words, passages):
    """500 unrelated documents, each around one of the passages, and near copies (ids from 1000) of every tenth."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(10**6)}"
    held = [[word() for _ in range(passage_words)] for _ in range(passages)]
    rows = [(i, " ".join([word() for _ in range(60)] + held[i % passages] + [word() for _ in range(60)])) for i in range(500)]
    return rows + [(1000 + i, rows[i][1] + " tail") for i in range(0, 500, 10)]


def test_orders_are_intersected_before_texts_move(spark):
    """The four shingles of a short passage are seldom in the prefixes of all orders; near copies always share some."""
    docs = spark.createDataFrame(sharing(8, 25), "doc_id long, text string").repartition(4)
    level = spark.sparkContext.broadcast(np.zeros(ngram_join.counters(0), np.uint8))
    every = docs.filter("doc_id < 500").select(F.col("doc_id").alias("a"))
    pairs = every.join(docs.select(F.col("doc_id").alias("b")), F.expr("b < 500 AND b > a AND b % 25 = a % 25 OR b = a + 1000"))
    pairs = shared.written(pairs)
    left = ngram_join._candidates(pairs, ngram_join._held(pairs, docs), 5, 75, level)
    assert {(r.a, r.b) for r in left.filter("b >= 1000").collect()} == {(i, i + 1000) for i in range(0, 500, 10)}
    assert 0 < left.filter("b < 500").count() < 0.65 * pairs.filter("b < 500").count()


def test_a_passage_of_many_documents_makes_no_pairs(spark, monkeypatch):
    rows, met, real = sharing(80, 1), [], ngram_join._candidates

    def counted(pairs, *rest):
        out = real(pairs, *rest)
        met.append((pairs.filter("b - a <> 1000").count(), out.filter("b - a <> 1000").count()))
        return out

    monkeypatch.setattr(ngram_join, "_candidates", counted)
    got = joined(spark, rows)
    assert {k: v[1] for k, v in got.items()} == {k: k - 1000 if k >= 1000 else k for k, _ in rows}
    assert len(met) == 2 and sum(formed for formed, _ in met) <= 50 and sum(left for _, left in met) == 0


def test_counters_travel_in_blocks(spark):
    """A task hands on one row for 65 536 counters, and their sum gives the levels of one table of all shingles."""
    size, texts = 1 << 18, [" ".join(f"w{i}x{k}" for k in range(300)) for i in range(40)] + [" ".join("same words again and again".split() * 9)] * 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = ngram_join._sets(docs, 5, size).cache()
    assert len(texts) < sets.count() <= len(texts) + 4 * size // ngram_join.BLOCK
    counts = np.zeros(size)
    for text in texts:
        found = ngram_join.words.shingles(next(ngram_join.words.documents(pa.array([text]), lower=True))[2][0])
        np.add.at(counts, ngram_join.counter(found, size), 1)
    level = ngram_join._levels(sets, size)
    assert (level == ngram_join.levels(counts, counts.mean())).all() and level.any()
    for block in (counts[: 1 << 16], np.arange(1 << 16), np.arange(1 << 16) * 9):
        assert (ngram_join.unpacked(ngram_join.packed(block), len(block)) == block).all()


def test_texts_outside_all_pairs_stay(spark):
    rows = spark.range(20_000).selectExpr("id - 10000 as doc_id", "cast(id as string) as text")
    pairs = spark.range(100).selectExpr("id * 7 as a", "-id * 3 as b")
    left = {r.doc_id for r in ngram_join._marked(rows, pairs).collect()}
    wanted = {r.doc_id for r in ngram_join._held(pairs, rows).collect()}
    assert wanted == {i * 7 for i in range(100)} | {-i * 3 for i in range(100)} <= left and len(left) < 2000
