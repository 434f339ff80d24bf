"""Many copies of a row: results as by brute force, and work that does not multiply."""

import hashlib
import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpora  # noqa: E402
import public_tokenizers  # noqa: E402

from rillstone.llm import bpe, graph_search, ngram_join, resampling, shared, substrings, token_counts, words  # noqa: E402

SCHEMA = "doc_id bigint, text string"


def passages(copies):
    """Two documents that share a passage in different surroundings; the second one stands in many rows."""
    rnd = random.Random(1)
    shared_words = [f"p{rnd.randrange(10**6)}" for _ in range(130)]
    around = [[f"{k}{rnd.randrange(10**6)}" for _ in range(40)] for k in "abcd"]
    texts = [" ".join([*around[2 * k], *shared_words, *around[2 * k + 1]]) for k in (0, 1)]
    return [(1, texts[0])] + [(2, texts[1])] * copies


def cuts(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = substrings.repeated(docs.select("doc_id", F.xxhash64("text").alias("row"), "text"))
    return sorted((r.doc_id, len(r.cuts)) for r in found.collect())


def test_cuts_do_not_follow_the_copies(spark):
    one, many = cuts(spark, passages(1)), cuts(spark, passages(1000))
    assert one == many and len(one) == 1
    rows = passages(1000)
    got = substrings.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {(i, n, gone, hashlib.sha256(kept).hexdigest()) for i, n, gone, kept in corpora.removed(passages(1))}
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_each_text_is_encoded_once(spark, monkeypatch):
    rows = [(1, "same words")] * 500 + [(2, "same words")] * 500 + [(None, "other words")] * 500 + [(3, None)] * 3
    encoded, plain = [], token_counts.counted
    monkeypatch.setattr(token_counts, "counted", lambda texts, *a: encoded.append(texts.count()) or plain(texts, *a))
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = token_counts.count_tokens(docs, path, public_tokenizers.PATTERN, token_counts.fresh_cache(spark)).collect()
    assert encoded == [3] and len(got) == len(rows)
    assert len({(r.doc_id, r.n_tokens) for r in got}) == 4


def test_pairs_are_verified_once(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text)] * 1000 + [(2, text + " more")] * 1000 + [(2, "another text")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    level = spark.sparkContext.broadcast(np.zeros(ngram_join.counters(0), np.uint8))
    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    assert ngram_join._linked(pairs, docs, 5, 75, level).count() == 1
    got = ngram_join.linked_components(docs).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {1}


def test_counters_follow_the_corpus():
    assert ngram_join.counters(0) == 1 << 18
    assert ngram_join.counters(6 * 64 * (1 << 20)) == 1 << 20
    assert ngram_join.counters(10**15) == 1 << 24
    tokens = np.random.default_rng(1).integers(0, 1 << 63, 10_000).astype(np.uint64)
    for size in (1 << 18, 1 << 21):
        at = ngram_join.counter(tokens, size)
        assert at.min() >= 0 and size // 2 < at.max() < size


def buckets(text):
    hashed = [h for _, _, texts in words.documents(__import__("pyarrow").array([text]), lower=True) for h in texts][0]
    both = [int(h) for h in hashed]
    two = [int(words.mix(np.array([a], np.uint64) * words.SHINGLE[0] + np.array([b], np.uint64) * words.SHINGLE[1])[0]) for a, b in zip(hashed, hashed[1:])]
    return [x % resampling.BUCKETS for x in both + two]


def test_importance_by_a_plain_model(spark, tiny):
    """The log ratio of two unigram models over hashed words and pairs, by counting in dictionaries."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{tiny}/labels.parquet").filter("quality = 1").collect()}
    raw, aim = [0] * resampling.BUCKETS, [0] * resampling.BUCKETS
    found = {i: buckets(t) for i, t in rows}
    for i, own in found.items():
        for b in own:
            raw[b] += 1
            aim[b] += i in good
    ratio = [math.log((a + 1) / (sum(aim) + len(aim))) - math.log((r + 1) / (sum(raw) + len(raw))) for a, r in zip(aim, raw)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = resampling.resampled(docs, spark.createDataFrame([(i,) for i in good], "doc_id bigint")).collect()
    for r in got:
        own = found[r.doc_id]
        want = sum(ratio[b] for b in own) / len(own) * min(len(own), resampling.LENGTH) if own else 0.0
        assert r.n_grams == len(own) and r.importance == pytest.approx(want, abs=1e-9)
    ranked = sorted(got, key=lambda r: (-r.key, r.doc_id))
    n = math.ceil(len(got) * 0.85)
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in ranked[:n]}


def test_top_share_of_many_ties(spark):
    rows = [(1, 0.5)] * 4000 + [(2, 0.5)] * 3000 + [(None, 0.5)] * 10 + [(3, 0.9), (4, 0.1)]
    keyed = spark.createDataFrame(rows, "doc_id bigint, key double").repartition(4)
    for share in (0.0, 0.3, 0.7, 1.0):
        got = resampling.top_share(keyed, share).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == math.ceil(round(share * len(rows), 6))
        kept = {}
        for r in got:
            kept[r.doc_id] = kept.get(r.doc_id, 0) + r.kept
        if share == 0.3:
            assert kept[3] == 1 and kept[4] == 0 and kept[2] == 0


def test_target_texts_are_not_shuffled(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    few = resampling.resampled(docs, labels.filter("quality = 1").select("doc_id"), targets=5)
    assert few.filter("kept").count() == math.ceil(0.85 * docs.count())


def test_neighbours_of_nearly_equal_doubles(spark):
    """Vectors that are equal in single precision."""
    rows = [(i, [1 + i * 1e-9, 1.0]) for i in range(60)]
    got = graph_search.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), spark.createDataFrame([(0,), (20,)], "vec_id bigint"))
    for query in (0, 20):
        own = sorted((r.rank, r.vec_id, r.score) for r in got.collect() if r.query_id == query)
        want = sorted(((sum(a * b for a, b in zip(v, rows[query][1])), -i) for i, v in rows if i != query), reverse=True)[:20]
        assert [(v, s) for _, v, s in own] == [(-i, s) for s, i in want]


def test_recall_with_large_shards(spark):
    """Shards of 5000 points and a beam of 128: most of a graph is never looked at."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 24))
    vectors = centres[rng.integers(0, 60, 20_000)] + 0.6 * rng.normal(size=(20_000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>").repartition(4)
    least = graph_search.LEAST_SHARDS
    graph_search.LEAST_SHARDS = 4
    try:
        got = graph_search.neighbours(table, table.filter("vec_id % 200 = 0").select("vec_id"), shard_rows=5000).collect()
    finally:
        graph_search.LEAST_SHARDS = least
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for query, ids in found.items():
        near = vectors @ vectors[query]
        near[query] = -np.inf
        hits += len(ids & set(np.argsort(-near)[:20].tolist()))
    assert len(found) == 100 and hits / 2000 >= 0.9, hits / 2000


def test_tables_are_deleted(spark):
    from pathlib import Path as Local

    with shared.scope(spark):
        kept = shared.written(spark.range(3)).count()
        path = Local(shared._TABLES[-1].removeprefix("file:"))
        assert path.exists()
    assert kept == 3 and not path.exists()


OPERATORS = {
    "ngram_join": ngram_join.linked_components,
    "substrings": substrings.deduplicated,
    "bpe_encode": lambda docs: bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "bpe_digests": lambda docs: bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
}


def largest_batch(rows):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["bytes"])

    return rows.mapInArrow(run, "bytes bigint").agg(F.max("bytes")).first()[0]


@pytest.mark.parametrize("name", OPERATORS)
def test_texts_reach_python_in_bounded_batches(spark, name):
    docs = spark.newSession().range(200, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 12500) AS text")
    assert largest_batch(docs) > 2 * shared.BATCH_BYTES
    assert OPERATORS[name](docs).count() == 200
    assert largest_batch(docs) < 1.1 * shared.BATCH_BYTES


def test_a_limit_of_the_session_holds(spark):
    own = spark.newSession()
    own.conf.set(shared.BATCH_LIMIT, "1m")
    shared.bounded_batches(own)
    assert own.conf.get(shared.BATCH_LIMIT) == "1m"
