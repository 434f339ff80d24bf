"""Small corpora for the tests, and brute-force forms of the operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = "tokens int, n int, row string, cuts int, found int, hits int, kept string, score int, part int, block int, key int, low int, others int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, long texts, repeated rows, ties, odd code points."""
    passage = " ".join(f"w{i * i % 97}" for i in range(60))
    texts = [
        None, "", "  \n\t ", "one", "a b c d", "a b c d", "A B C D", passage, passage.upper(), passage + " and more words",
        "before it " + passage, "x " * 20_000, "y" * 30_000, "   zwei drei", "日本語 テキスト 🙂\n\n🙂", "\x00 \x1c\x1d",
        "line\nline\nline\n\nother", "idiot moron you are stupid!!!", "<|endoftext|> <|endoftext|>", "'s 're don't   stop",
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["src0", "src0", "src0", None][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[9], (None, passage, None, None, None), (7, "another text under the same id", "en", "src0", 30)]
    return rows


def odd(spark, clashes: bool = True):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    if clashes:
        for name, kind in (x.split() for x in CLASHES.split(", ")):
            docs = docs.withColumn(name, F.lit(1).cast(kind))
    return docs


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def shingle_set(text: str | None) -> set:
    found = words(text.lower() if text is None else re.sub("[A-Z]", lambda m: m.group().lower(), text)) if text else []
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())


def components(rows: list[tuple], percent: int = 75) -> dict:
    """Smallest id reachable by links, for every id; all pairs that share a shingle are compared."""
    sets, index, parent = [(i, shingle_set(t)) for i, t in rows if i is not None], defaultdict(list), {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for at, (_, found) in enumerate(sets):
        for shingle in found:
            index[shingle].append(at)
    pairs = {(a, b) for held in index.values() for k, a in enumerate(held) for b in held[k + 1 :]}
    for a, b in pairs:
        both = len(sets[a][1] & sets[b][1])
        if 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
            x, y = root(sets[a][0]), root(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def removed(rows: list[tuple], length: int = 50) -> list[tuple]:
    """``doc_id, n_words, n_removed, kept`` of rows ``doc_id, text``."""
    first: dict = {}
    found = [(i, words(t)) for i, t in rows]
    for i, w in found:
        for k in range(len(w) - length + 1 if i is not None else 0):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in found:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1 if i is not None else 0):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(kept), b" ".join(kept)))
    return out


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    found = [w.decode() for w in words(text)]
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(zip(found, found[1:], found[2:]))
    twice = [False] * len(found)
    for i in range(len(found) - 2):
        if windows[tuple(found[i : i + 3])] > 1:
            twice[i : i + 3] = [True] * 3
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(twice)
