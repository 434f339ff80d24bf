"""Operator 13 against a search over all edits."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from rillstone.llm import catalog, repair  # noqa: E402

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PATTERN = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def least(rows):
    """``cost, audit, repaired`` by memoised search over (row, roles so far) with the pattern itself as the test."""

    def roles_end(so_far, role):
        """Roles are cut to what matters: an s at the front and whether a user is open."""
        whole = so_far + role
        return whole if any(PATTERN.fullmatch(whole + rest) for rest in ("", "a", "ua")) else None

    def short(roles):
        return ("s" if roles[:1] == "s" else "") + ("ua" * (len(roles) > 2) + roles[-1] if roles[-1:] == "u" else "ua" if roles[-1:] == "a" else "")

    @lru_cache(None)
    def best(i, roles, inserts):
        options = [(0, "", ())] if i == len(rows) and PATTERN.fullmatch(roles) else []

        def add(price, letter, role, text, j, more):
            to = roles_end(roles, role[:1]) if role else None
            if role and to is not None:
                cost, audit, kept = best(j, short(to), more)
                options.append((price + cost, letter + audit, (f"{role}:{text}", *kept)))

        if inserts < 4:
            for role in ("user", "assistant"):
                add(5, "I", role, "", i, inserts + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, kept = best(i + 1, roles, 0)
            options.append((2 + cost, "D" + audit, kept))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                add(more, "K", role, text, i + 1, 0)
                add(1 + more, "R", "user", text, i + 1, 0)
                add(1 + more, "R", "assistant", text, i + 1, 0)
        return min(options, default=(10**9, "", ()))

    sys.setrecursionlimit(10_000)
    return best(0, "", 0)


def expected(rows):
    convs = defaultdict(list)
    for row in damaged(rows):
        convs[row[0]].append(row[1:])
    out = set()
    for conv in {r[0] for r in rows}:
        held = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in held:
            bare = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        cost, audit, kept = least([(r, t, f) for (_, r, t), f in zip(held, faults)])
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.add((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def invented(n, most, seed, roles=("user", "assistant", "system", "tool", "", "sales", None)):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Long\ntext. ", "x.\x1c", "Ü?", "z.\u2028"]
    rows = []
    for conv in range(n):
        turns = list(range(rnd.randrange(most)))
        for t in turns:
            role = rnd.choice(("user", "assistant")) if rnd.random() < 0.7 else rnd.choice(roles)
            text = f"{rnd.randrange(50)} {rnd.choice('.!?x')}" if rnd.random() < 0.7 else rnd.choice(texts)
            rows.append((conv, rnd.choice((t, t, t, t + 3, None)), role, text))
    return rows


def got(frame):
    rows = frame.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {tuple(r) for r in rows}


def test_query(spark, tiny, small):
    for folder in (tiny, small):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert got(catalog.op13_conversation_repair(spark, folder)) == expected(rows)


def test_odd_conversations(spark):
    rows = invented(300, 9, 4) + [(None, 0, "user", "a."), (None, 1, "user", "b."), (None, None, None, None), (900, None, "user", "x.")]
    rows += [(901, 2, "user", "same."), (901, 2, "user", "same."), (901, 2, "assistant", "same."), (902, 5, "assistant", "y" * 50_000 + ".")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("part", "piece", "fault", "copies", "first", "one", "kind", "digest", "_conv"):
        table = table.withColumn(name, table.turn)
    assert got(repair.audited(table)) == expected(rows)
    assert repair.audited(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256().hexdigest()
    assert got(repair.audited(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA))) == {(gone, 0, 0, 0, 0, 0, 0, "", empty)}


def test_a_conversation_over_many_parts(spark):
    """The result does not depend on where conversations are cut."""
    rows = [(c, t, r, x) for c, t, r, x in invented(12, 60, 6, ("user", "assistant", "tool"))] + invented(3, 5, 7)
    table = spark.createDataFrame(rows, SCHEMA)
    whole = repair.repaired(repair.damaged(table)).collect()
    for part_rows in (5, 17):
        cut = repair.repaired(repair.damaged(table), part_rows=part_rows).collect()
        assert sorted(map(str, cut)) == sorted(map(str, whole)) and len(whole) == 12


def test_copies_of_one_row(spark):
    """Equal rows are counted before they are put in order."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.lit(1).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("a.").alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(1, 1, "assistant", "b.")], SCHEMA))
    (result,) = repair.repaired(rows, part_rows=400).collect()
    assert result.duplicate == 2999 and result.cost == 2 * 2999 and result.audit == "K" + "D" * 2999 + "K"
    assert result.repaired_sha256 == hashlib.sha256(b"user:a.\nassistant:b.").hexdigest()
