"""Operator 12 against a plain scan of each text."""

import random
import re
import sys
from itertools import groupby
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import corpora  # noqa: E402

from rillstone.llm import catalog, licenses  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").encode().lower().decode())


def places(words, phrase):
    phrase = phrase.split()
    return [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]


def scanned(text, notices=licenses.NOTICES, phrases=licenses.PHRASES):
    """The result of one text, by comparing every run with every run."""
    words, base, labels, score = words_of(text), [], set(), 0.0
    for t in phrases:
        base += [(i, t.label) for i in places(words, t.words)]
    for t in [*phrases, *notices]:
        own = t.words.split()
        met = sorted((i - j, i, j) for i in range(len(words) - t.k + 1) for j in range(len(own) - t.k + 1) if words[i : i + t.k] == own[j : j + t.k])
        part, before, parts = 0, None, []
        for d, i, j in met:
            part += before is not None and d - before > t.shift
            before = d
            parts.append((part, i, j))
        for _, held in groupby(parts, lambda x: x[0]):
            held = list(held)
            share = len({w for _, _, j in held for w in range(j, j + t.k)}) / len(own)
            score = max(score, share)
            if share >= t.least and max(i for _, i, _ in held) + t.k - min(i for _, i, _ in held) <= 2 * len(own):
                labels.add(t.label)
    first = [i for i, _ in base]
    names = ",".join(sorted({x for _, x in base}))
    return len(words), len(base), min(first, default=None), max(first, default=None), names, ",".join(sorted(labels)), score


def test_query(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = {tuple(r) for r in catalog.op12_license_diagonals(spark, tiny).collect()}
    assert got == {(i, *scanned(t)) for i, t in rows} and any(r[2] for r in got)


def test_edited_notices(spark):
    """Notices with inserted, deleted and replaced words, in running text, twice, cut short or spread out."""
    rnd, texts = random.Random(8), []
    for t in licenses.NOTICES:
        for _ in range(6):
            words = t.words.split()
            for _ in range(rnd.randrange(5)):
                at = rnd.randrange(len(words))
                words[at : at + rnd.randrange(2)] = [f"w{rnd.randrange(99)}"] * rnd.randrange(2)
            around = [f"v{rnd.randrange(50)}" for _ in range(rnd.randrange(60))]
            texts.append(" ".join([*around, *words[: rnd.randrange(3, 40)], *around, *words]))
        texts.append(" filler ".join(t.words.split()))
    texts += ["cc by cc by CC-BY general public license General, Public: License", "All rights. Reserved all rights reserved", "general public", "cc"]
    texts += ["Éall rights reserved", "all rights reserved", "cc by " * 5000]
    rows = list(enumerate(texts))
    got = {tuple(r) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    want = {(i, *scanned(t)) for i, t in rows}
    assert got == want
    assert sum(bool(w[6]) for w in want) > len(licenses.NOTICES) * 4


def test_odd_rows(spark):
    notice = "Licensed under the Apache License, Version 2.0. All rights reserved."
    rows = [(r[0], r[1]) for r in corpora.odd_rows()] + [(None, notice), (None, notice), (7, notice), (7, None), (8, notice), (8, notice)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for name in ("words", "row", "hash", "i", "j", "k", "template", "score", "labels", "_id", "_row"):
        docs = docs.withColumn(name, docs.doc_id)
    key = lambda x: tuple((v is not None, v or 0) for v in x[:1]) + tuple(str(v) for v in x[1:])
    got = sorted(map(tuple, licenses.scanned(docs).collect()), key=key)
    assert got == sorted(((i, *scanned(t)) for i, t in rows), key=key)
    assert licenses.scanned(corpora.empty(spark)).collect() == []


def test_copies_add_no_votes(spark):
    docs = spark.range(1).selectExpr("1L AS doc_id", "'All rights reserved' AS text").crossJoin(spark.range(1000).select()).select("doc_id", "text")
    assert licenses.votes(docs, licenses.PHRASES).count() == 2
    assert {tuple(r) for r in licenses.scanned(docs).collect()} == {(1, *scanned("All rights reserved"))}


def test_native(spark, tiny):
    """No Python worker, and the runs of the texts meet the templates before anything is shuffled."""
    plan = licenses.scanned(spark.read.parquet(f"{tiny}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "BroadcastHashJoin" in plan


def test_only_first_words_of_runs_are_hashed(spark, monkeypatch):
    """A text without them gives no runs to the join; with them, and without the list, votes are the same."""
    docs = spark.createDataFrame([(1, "plain words " * 50), (2, "Released under the MIT license, all rights reserved")], "doc_id long, text string")
    templates = [*licenses.PHRASES, *licenses.NOTICES]
    first = sorted({w for t in templates for w in t.words.split()[: 1 - t.k or None]})
    starts = docs.select(licenses._starts(licenses.words_of(docs.text), first).alias("s")).collect()
    assert [r.s for r in starts] == [[], [0, 1, 2, 4, 5, 6]]
    want = set(licenses.votes(docs, templates).collect())
    monkeypatch.setattr(licenses, "MOST_FIRST", 0)
    assert set(licenses.votes(docs, templates).collect()) == want != set()
