"""Operators 2, 5, 7 and 9."""

import math
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpora  # noqa: E402

from rillstone.llm import backoff, catalog, outliers, resampling, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def judged(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    return texts, labels, catalog.op2_robust_outliers(spark, small).collect()


def test_base_statistics(judged):
    texts, _, rows = judged
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, lines, repeats = corpora.base_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)


def test_junk_goes_and_good_documents_stay(judged):
    _, labels, rows = judged
    passed = [r for r in rows if not r.base_failed and r.doc_id in labels]
    good = [r.kept for r in passed if labels[r.doc_id].quality == 1]
    junk = [r.kept for r in passed if labels[r.doc_id].quality == 0]
    assert np.mean(good) > 0.97 and np.mean(junk) < 0.05


def brute_mcd(x: np.ndarray, steps: int = 25):
    """Concentration steps on sorted distances, with the same floors, from the same starts."""
    floors, h = np.diag(np.square(outliers.FLOORS)), math.ceil(outliers.SHARE * len(x))
    middle = np.median(x, 0)
    starts = [(x.mean(0), np.cov(x.T, bias=True) + floors), (middle, np.diag((1.4826 * np.median(abs(x - middle), 0)) ** 2) + floors)]
    best = None
    for mean, cov in starts:
        for _ in range(steps):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            inner = x[np.argsort(d)[:h]]
            mean, cov = inner.mean(0), outliers._consistency() * np.cov(inner.T, bias=True) + floors
        if best is None or np.linalg.det(cov) < best[0]:
            best = (np.linalg.det(cov), mean, cov)
    return best


def test_estimates_are_near_brute_force(spark):
    rnd = np.random.default_rng(8)
    clean = rnd.multivariate_normal([5, 1, 0.5, 0.3], np.diag([0.2, 0.1, 0.1, 0.02]) + 0.02, 800)
    x = np.vstack([clean, rnd.normal([9, 5, 3, 0.9], 0.1, (150, 4))])
    docs = spark.createDataFrame([(["g"], *map(float, r)) for r in x], "key array<string>, x0 double, x1 double, x2 double, x3 double")
    row = outliers.estimates(docs.repartition(3), steps=8).first()
    _, mean, cov = brute_mcd(x)
    assert np.allclose([row[f"m{i}"] for i in range(4)], mean, atol=0.03)
    got = np.array([[row[f"s{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
    assert np.allclose(got, cov, atol=0.05)
    assert abs(mean[0] - 5) < 0.1, "far points do not move the mean"


def test_outliers_of_odd_rows(spark):
    got = outliers.judged(corpora.odd(spark)).collect()
    want = sorted(corpora.base_statistics(r[1]) for r in corpora.odd_rows())
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got), "too few rows for an estimate: the base rules decide"
    assert outliers.judged(corpora.empty(spark)).count() == 0


def test_outliers_use_no_python(spark, small):
    plan = outliers.judged(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_toxicity_on_held_out_rows(spark, small):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = catalog.op5_weak_toxicity(spark, small).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    caught = [p for p, t in held if t == 1]
    assert np.mean(caught) > 0.6 and not any(p for p, t in held if t == 0)


def test_labels_that_are_held_out_teach_nothing(spark, small):
    """Turning all held-out labels around changes no score."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_label_model_finds_accuracies():
    """Votes drawn from a known model, few labels: good voters get larger weights, and the posterior follows the class."""
    rnd = np.random.default_rng(2)
    y = rnd.random(20_000) < 0.2
    hit = np.linspace(0.9, 0.3, toxicity.VOTERS)
    votes = rnd.random((len(y), toxicity.VOTERS)) < np.where(y[:, None], hit, 0.05)
    votes[:, 1] = votes[:, 0]
    pattern = votes @ (1 << np.arange(toxicity.VOTERS))
    size = 1 << toxicity.VOTERS
    counts = np.bincount(pattern, minlength=size).astype(float)
    clean, toxic = (np.bincount(pattern[:300][y[:300] == k], minlength=size).astype(float) for k in (0, 1))
    model = toxicity.LabelModel().fit(counts, clean, toxic)
    assert ((model.posterior[pattern] > 0.5) == y).mean() > 0.97
    assert (1, 0) in model.pairs, "a copied voter counts as correlated"
    assert model.accuracy[2] > model.accuracy[-1]


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(17, 1, 1), (3, 1, 0), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity(corpora.odd(spark), labels).collect()
    assert len(rows) == len(corpora.odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.toxicity(corpora.odd(spark), labels.filter("false")).collect()
    assert max(none, key=lambda r: r.score).doc_id == 17
    assert toxicity.toxicity(corpora.empty(spark), labels).count() == 0


def test_resampling_prefers_the_target(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = catalog.op7_importance_resampling(spark, small).collect()
    order = sorted(rows, key=lambda r: (-r.key, r.doc_id))
    n = math.ceil(0.85 * len(rows))
    assert {r.doc_id for r in order[:n]} == {r.doc_id for r in rows if r.kept}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    junk = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.95 and np.mean(junk) < 0.2


def test_importance_is_the_mean_log_ratio(spark):
    docs = corpora.odd(spark).filter("doc_id IS NOT NULL")
    target = spark.createDataFrame([(4,), (7,)], "doc_id bigint")
    ratio = resampling.ratios(docs.join(target.withColumn("target", F.lit(True)), "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False))))
    rows = resampling.importances(docs, ratio).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.n_grams >= 0 and (r.n_grams or r.importance == 0)
    assert resampling.resampled(corpora.empty(spark), target).count() == 0
    assert all(r.importance == 0 for r in resampling.resampled(docs, target.filter("false")).collect())


def test_top_share_with_ties(spark):
    rows = spark.createDataFrame([(i, float(i // 10)) for i in range(100)], "doc_id bigint, key double").repartition(5)
    for share in (0.0, 0.33, 0.5, 1.0):
        kept = {r.doc_id for r in resampling.top_share(rows, share).filter("kept").collect()}
        want = sorted(range(100), key=lambda i: (-(i // 10), i))[: math.ceil(100 * share)]
        assert kept == set(want)


def brute_scores(rows):
    words = [(i, [w.lower() for w in corpora.words(t)]) for i, t in rows]
    one = Counter(w for _, ws in words for w in ws)
    two = Counter(p for _, ws in words for p in zip(ws, ws[1:]))
    n, out = sum(one.values()), []
    for i, ws in words:
        mine, pairs, rest = Counter(ws), Counter(zip(ws, ws[1:])), max(n - len(ws), 1)
        single = [math.log10(max(one[w] - mine[w], 0.5) / rest) for w in ws]
        score = single[0] if ws else 0.0
        for k, p in enumerate(zip(ws, ws[1:]), 1):
            c = two[p] - pairs[p]
            score += math.log10(c / max(one[p[0]] - mine[p[0]], 1)) if c > 0 else math.log10(0.4) + single[k]
        out.append((i, len(ws), score))
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_backoff_scores(spark, tiny, odd):
    docs = corpora.odd(spark) if odd else spark.read.parquet(f"{tiny}/documents.parquet")
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], round(x[2], 3))
    want = sorted(brute_scores([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    got = sorted(((r.doc_id, r.n_words, r.score) for r in backoff.scored(docs).collect()), key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want])
    assert backoff.scored(corpora.empty(spark)).count() == 0


def test_many_blocks_and_tables_give_the_same_scores(spark, tiny, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    whole = {r.doc_id: r.score for r in backoff.scored(docs).collect()}
    monkeypatch.setattr(backoff, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(backoff, "TABLE_WORDS", 5_000)
    parts = {r.doc_id: r.score for r in backoff.scored(docs).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-6 for k in whole)
