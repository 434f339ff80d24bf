"""Operators 3 and 10, the pipeline and its registration."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from check import compare, connect
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpora  # noqa: E402

import corpus_pipeline  # noqa: E402
from rillstone.llm import catalog, graph_search, mixing  # noqa: E402


def nearest(ids, vectors, query, k=20):
    x = np.asarray(vectors, float)
    score = (x * x[list(ids).index(query)]).sum(1)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != query][:k]
    return [(ids[i], score[i]) for i in order]


def test_search_query_has_high_recall(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in rows], [r.embedding for r in rows]
    found = {}
    for r in catalog.op3_graph_neighbours(spark, small).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in ids if i % 20 == 0}
    hits = 0
    for query, got in found.items():
        want, got = nearest(ids, vectors, query), sorted(got)
        assert [g[0] for g in got] == list(range(1, 21))
        hits += len({w[0] for w in want} & {g[1] for g in got})
    assert hits >= 0.95 * 20 * len(found)


def test_graph_recall_on_clusters_of_unequal_length():
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(40, 24))
    vectors = (centres[rnd.integers(0, 40, 4000)] + 0.3 * rnd.normal(size=(4000, 24))).astype(np.float32)
    vectors *= rnd.uniform(0.5, 1.5, (4000, 1)).astype(np.float32)
    points = graph_search.lifted(vectors, np.sqrt((vectors.astype(float) ** 2).sum(1)).max())
    links, entry = graph_search.build(points)
    assert links.shape == (4000, graph_search.DEGREE)
    asked = np.hstack([vectors[:200], np.zeros((200, 1), np.float32)])
    found = graph_search.beam_search(points, links, entry, asked, graph_search.BEAM)[:, :20]
    want = np.argsort(-(vectors[:200] @ vectors.T), 1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, want)]) >= 0.95


def test_search_with_equal_and_odd_vectors(spark):
    rnd = random.Random(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 120)]
    rows += [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(120, 300)]
    good = list(rows)
    rows += [(400, None), (420, []), (440, [0.0, 0.0, 0.0]), (460, [1.0, None, 2.0]), (480, [float("nan"), 1.0, 1.0]),
             (500, [float("inf"), 1.0, 1.0]), (520, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), rows[0]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    found = {}
    for r in graph_search.neighbours(table, table.filter("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    ids, vectors = [r[0] for r in good], np.array([r[1] for r in good], float)
    assert set(found) == {i for i in ids if i % 20 == 0}
    for query, got in found.items():
        assert [g[1] for g in sorted(got)] == [w[0] for w in nearest(ids, vectors, query)]
    few = graph_search.neighbours(table.filter("vec_id >= 290 AND vec_id < 300"), table.filter("vec_id = 290"))
    assert few.count() == 9
    assert graph_search.neighbours(table.filter("vec_id >= 400"), table).count() in (0, 1)
    assert graph_search.neighbours(table.filter("false"), table).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.statements()))
def test_query_matches_sql(spark, tiny, name):
    assert compare(catalog.queries()[name](spark, tiny), connect(tiny), catalog.statements()[name]) is None


def test_marginals_meet_their_targets(spark):
    rnd = random.Random(3)
    cells = [(f"s{a}", f"l{b}", f"t{c}", rnd.randrange(1, 1000)) for a in range(6) for b in range(3) for c in range(4)]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint").repartition(4)
    rows = mixing.raked(frame, {"source": 0.5, "lang": 0.0, "topic": 1.0}, rounds=30).collect()
    total = sum(c[3] for c in cells)

    def shares(name, weight):
        out = {}
        for r in rows:
            out[r[name]] = out.get(r[name], 0) + r.tokens * (r.factor if weight else 1) / total
        return out

    assert all(abs(v - 1 / 3) < 1e-9 for v in shares("lang", True).values())
    before, after = shares("topic", False), shares("topic", True)
    assert all(abs(before[k] - after[k]) < 1e-9 for k in before)
    root = {k: v**0.5 for k, v in shares("source", False).items()}
    assert all(abs(v - root[k] / sum(root.values())) < 1e-6 for k, v in shares("source", True).items())


def test_mixing_of_odd_rows(spark):
    rows = mixing.mixed(corpora.odd(spark)).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(corpora.words(r[1])) for r in corpora.odd_rows())
    assert all(0 < r.probability <= 1 and r.weight > 0 for r in rows)
    assert mixing.mixed(corpora.empty(spark)).count() == 0
    docs = corpora.odd(spark)
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in rows)


def test_kept_tokens_of_the_mixing_stage_meet_the_targets(spark):
    """Without weights, and with factors above 1: the stage passes on nothing but documents."""
    rnd = random.Random(8)
    says = {"prose": "plain words", "legal": "all rights reserved", "contact": "write a@b"}
    rows = []
    for i in range(12_000):
        source, lang = rnd.choices(["hot", "s1", "s2"], [90, 7, 3])[0], rnd.choices(["en", "de", None], [70, 25, 5])[0]
        text = " ".join([says[rnd.choices(list(says), [93, 5, 2])[0]], *["w"] * rnd.randrange(20)])
        rows.append((i, text, lang, source, len(text)))
    docs = spark.createDataFrame(rows, corpora.SCHEMA).repartition(4)

    def shares(frame):
        parts = frame.select("source", F.coalesce("lang", F.lit("none")).alias("lang"), mixing.topic(F.col("text")).alias("topic"), mixing.n_words(F.col("text")).alias("n"))
        found = {}
        for r in parts.collect():
            for name in mixing.POWERS:
                found[name, r[name]] = found.get((name, r[name]), 0) + r.n
        return {k: v / sum(x for o, x in found.items() if o[0] == k[0]) for k, v in found.items()}, sum(v for k, v in found.items() if k[0] == "topic")

    (before, n_before), (after, n_after) = shares(docs), shares(corpus_pipeline.mix(spark, docs, ""))
    raised = {k: v ** mixing.POWERS[k[0]] for k, v in before.items()}
    target = {k: v / sum(x for o, x in raised.items() if o[0] == k[0]) for k, v in raised.items()}
    assert min(before[k] / target[k] for k in target) < 0.5, "some factors are above 1"
    assert all(abs(after[k] - target[k]) < 0.015 for k in target), {k: (before[k], after[k], target[k]) for k in target}
    assert n_after / n_before == pytest.approx(min(before[k] / target[k] for k in target), rel=0.05), "no more is lost than must be"


def test_bounded_probabilities_meet_every_target(spark):
    rnd = random.Random(3)
    cells = [(f"s{a}", f"l{b}", f"t{c}", rnd.randrange(1, 1000) * (500 if a + b == 0 else 1)) for a in range(6) for b in range(3) for c in range(4)]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint").repartition(4)
    factors = mixing.raked(frame).agg(F.max("factor")).first()[0]
    p = {(r.source, r.lang, r.topic): r.probability for r in mixing.bounded(frame).collect()}
    assert len(p) == len(cells) and all(0 < x <= 1 for x in p.values())
    kept = sum(c[3] * p[c[:3]] for c in cells)
    assert kept > 1.1 * sum(c[3] for c in cells) / factors, "more than with the rate that fits the largest factor"
    for at in range(3):
        tokens, found = {}, {}
        for c in cells:
            tokens[c[at]] = tokens.get(c[at], 0) + c[3]
            found[c[at]] = found.get(c[at], 0) + c[3] * p[c[:3]] / kept
        whole = sum(v**0.7 for v in tokens.values())
        assert all(found[k] == pytest.approx(v**0.7 / whole, rel=0.03) for k, v in tokens.items())
    assert mixing.bounded(frame.filter("false")).count() == 0


@pytest.fixture(scope="module")
def stages(spark, tiny):
    docs, out = spark.read.parquet(f"{tiny}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, stage(spark, docs, tiny)))
        docs = out[-1][1]
    return out


def test_stages_keep_the_columns(stages):
    for docs, result in stages[:-1]:
        assert result.dtypes == docs.dtypes
    assert stages[-1][1].columns == ["doc_id", "tokens"]


def test_near_copy_stage_leaves_one_of_each_group(stages):
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in stages[1])
    want = corpora.components(list(before.items()))
    assert set(after) == set(want.values())


def test_passage_stage_removes_repeats_only(stages):
    before, after = ({r.doc_id: r for r in x.collect()} for x in stages[2])
    for i, _, gone, kept in corpora.removed([(i, r.text) for i, r in before.items()]):
        assert after[i].text == (kept.decode() if gone else before[i].text)
        assert after[i].n_chars == (len(kept.decode()) if gone else before[i].n_chars)


def test_pipeline_of_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(17, 1, 1), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (corpora.odd(spark), corpora.empty(spark)):
        left = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, str(tmp_path))
            assert left.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).count() == left.count()


def test_run_is_the_chain_of_stages(spark, tiny, stages):
    got = {r.doc_id: r.tokens for r in corpus_pipeline.run(spark, tiny).collect()}
    assert got == {r.doc_id: r.tokens for r in stages[-1][1].collect()}


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names
