"""Operator 11 against brute force."""

import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import corpora  # noqa: E402

from rillstone.llm import catalog, spelling  # noqa: E402


def words_of(rows) -> Counter:
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").encode().lower().decode()):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += len(run) >= 7
    return Counter({w: n for w, n in out.items() if n >= 2})


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :])


def near_of(words) -> dict[str, set]:
    """Near words by comparing all words that agree in their first or last three code points, or are in a small table."""
    near, groups = defaultdict(set), defaultdict(list)
    for w in words:
        groups[w[:3]].append(w)
        groups[w[-3:] + "$"].append(w)
    for held in groups.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                    near[a].add(b)
                    near[b].add(a)
    return near


def expected(words: Counter) -> set[tuple]:
    near, forms, out = near_of(words), {}, set()
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            forms[w] = best
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, len(near[w]), words[forms[w]] if w in forms else None))
    return out


def test_query(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = catalog.op11_spelling_variants(spark, tiny).collect()
    assert {tuple(r) for r in got} == expected(words_of(rows)) and len(got) == len({r.word for r in got})
    assert any(r.form for r in got)


def crowd():
    """Many words that share half of their code points, chains of forms, long words and words of other scripts."""
    rnd, out = random.Random(5), Counter()
    for _ in range(3000):
        out["prefixed" + "".join(rnd.choice("abcé") for _ in range(rnd.randrange(6, 9)))] += rnd.randrange(1, 40)
        out["".join(rnd.choice("xyz") for _ in range(rnd.randrange(6, 9))) + "suffixed"] += rnd.randrange(1, 9)
    for k in range(6):
        out["chained" + "a" * k + "end"] = 2 * 10**k
    out |= {"a" * 7: 3, "a" * 8: 40, "ab" * 500: 5, "ab" * 500 + "c": 70, "ab" * 499 + "bb": 3, "çèéêëìíî": 2, "çèéêëìíï": 30}
    return out


def test_crowded_buckets(spark):
    """Whatever bucket size sends words to the longer keys, the pairs are the same."""
    words = crowd()
    table = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(4)
    want = expected(words)
    for bucket in (0, 32):
        got = spelling.grouped(table, bucket=bucket).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert next(r.root for r in got if r.word == "chainedend") == "chainedaaaaaend"


def test_candidates_of_a_crowded_bucket_follow_its_words(spark):
    """4000 words with one half in common and random rests: next to no two are near, and few pairs are verified."""
    rnd = random.Random(3)
    words = {"common" + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)): 2 for _ in range(4000)}
    level = spelling.entries(spark.createDataFrame(list(words.items()), "word string, n bigint"))
    for _ in range(2):
        level = spelling.refined(level.filter("aligned"))
    sides = level.groupBy("key").agg({"chunk": "count"}).toPandas()
    assert sides["count(chunk)"].max() < 200


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in corpora.odd_rows()]
    rows += [(None, "colouring colouring Colouring"), (None, None), (3, "coloring, coloring; COLOURING"), (3, "coloring, coloring; COLOURING")]
    rows += [(None, "colouring " * 30), (50, "z" * 20_000 + " " + "z" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for name in ("word", "n", "key", "run", "h"):
        docs = docs.withColumn(name, docs.doc_id)
    got = spelling.variants(docs).collect()
    assert {tuple(r) for r in got} == expected(words_of(rows))
    assert spelling.variants(corpora.empty(spark)).collect() == []
