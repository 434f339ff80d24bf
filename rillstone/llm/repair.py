"""Repair of conversations by cheapest edits, the least of equally cheap ones by prefix-doubling ranks (operator 13).

The rows of a conversation in order are edited so that their roles read ``(system? (user assistant)+)?``: Keep costs 0, Rerole
to user or assistant 1, Delete 2, Insert of an empty row 5; a truncated row that is not deleted adds 5, and blank rows and
duplicates must be deleted. A *node* is a place between rows with what the roles so far end in; an edit is an arc.

1. *Faults* are found in Spark: equal rows are counted first, and the first of equal role and text is the smallest turn of
   an aggregate, so a row that is repeated without end is no hot key.
2. *Pieces.* Rows are dealt by ranges of conversation, turn, role and text. A part holds ``PART_ROWS`` rows or ``PART_CHARS`` characters or
   so, and a conversation of any size is cut into pieces at the parts' borders. Only the first and the last
   conversation of a part can go on elsewhere.
3. *Cost.* Going back through a piece gives the cheapest cost from each node to the end. What lies behind a border enters
   as four numbers, one for each ending of the roles; a cut piece is a 4 x 4 matrix of costs for that, and the matrices
   of a conversation are multiplied from its end.
4. *Ranking.* Arcs that are on a cheapest path are kept. Nodes are ranked by the least audit (initials of the edits) of
   length 1, 2, 4, ... that begins there: the rank for twice the length is the rank of the pair (own rank, rank of the
   pointer's end), and pointers double with it. An edit's initial leads from a node to one other node only, so the end
   of the least audit of each length is one node. Ranks then select the arc of each node, and the doubled pointers give
   the node at every step of the least path at once.
5. *Joining.* A cut piece has a path for each of its four entries; pieces are read in order as a stream, which picks
   the entry that the piece before led to and feeds one hash. It never holds more than a batch of pieces.

Cases: a null role, text, id or turn reads as one space in the damage's key, and a null role or text is one space; null turns come
first; rows of one turn are taken by role and text, and equal rows next to each other; a null id is a conversation of
its own; a role without initial, or with one that is not s, u or a, cannot be kept; a conversation that loses all rows has zeros,
an empty audit and the hash of nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm import shared

PART_ROWS = 50_000
PART_CHARS = 8 << 20
BLANK = " \t\n\u000b\f\r"
COPIES = 1000
NONE = 1 << 60
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# What the roles so far end in: nothing, system, user, assistant. The next role that may follow, and where a kept role leads.
NEXT = np.array([2, 2, 3, 2])
KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
END = (0, 2 * INSERT, INSERT, 0)
LETTERS = np.frombuffer(b" DIKR", np.uint8)
FAULTS = ("", "blank", "duplicate", "truncated")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that a hash of conversation and turn asks for."""

    def shown(name: str):  # noqa: ANN202
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).cast("int")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_one")).drop("_one")


def faulty(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, fault`` of ``rows``, with the number of the first fault in ``FAULTS``."""
    early = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    kinds = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    kinds = shared.written(kinds.withColumn("digest", F.md5("text")))
    firsts = kinds.groupBy("conv_id", "role", "digest").agg(F.min(early).alias("first"))
    firsts = firsts.withColumnsRenamed({"conv_id": "_conv", "role": "_role", "digest": "_digest"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    placed = kinds.join(firsts, same).withColumn("is_first", early == F.col("first"))
    # Copies are made in two steps, so that no array is as long as a row has copies.
    many = placed.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))).alias("thousand"))
    few = F.least(F.lit(COPIES), F.col("copies") - F.col("thousand") * COPIES).cast("int")
    single = many.select("*", F.explode(F.sequence(F.lit(0), few - 1)).alias("one"))
    bare = F.rtrim(F.col("text"), F.lit(BLANK))
    fault = F.when(bare == "", 1).when(~F.col("is_first") | (F.col("thousand") + F.col("one") > 0), 2).when(~F.substring(bare, -1, 1).isin(*".!?"), 3).otherwise(0)
    return single.select("conv_id", "turn", "role", "text", fault.cast("int").alias("fault"))


def costs(roles: list[int], faults: list[int], end: tuple) -> list[tuple]:
    """Cheapest cost to the end from the four nodes before each row, and after the last one (``end``)."""
    out = [tuple(end)]
    c0, c1, c2, c3 = end
    for role, fault in zip(reversed(roles), reversed(faults)):
        d0, d1, d2, d3 = c0 + DELETE, c1 + DELETE, c2 + DELETE, c3 + DELETE
        if fault in (0, 3):
            more = TRUNCATED if fault else 0
            user, assistant = c2 + more + (role != 1), c3 + more + (role != 2)
            d0, d1, d2, d3 = min(d0, user), min(d1, user), min(d2, assistant), min(d3, user)
            if role == 0:
                d0 = min(d0, c1 + more)
        c2, c3 = min(d2, d3 + INSERT), min(d3, d2 + INSERT)
        c0, c1 = min(d0, c2 + INSERT), min(d1, c2 + INSERT)
        out.append((c0, c1, c2, c3))
    return out[::-1]


class Part:
    """The rows of a part in order, cut into conversations."""

    def __init__(self, table: pa.Table) -> None:
        order = [(c, "ascending") for c in ("conv_id", "turn", "role", "text", "fault")]
        self.rows = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))
        n = self.rows.num_rows
        conv = self.rows["conv_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1])) if n else np.zeros(0, np.int64)
        self.first, self.end = first, np.append(first[1:], n)
        self.role, self.text = self.rows["role"].to_pylist(), self.rows["text"].to_pylist()
        self.initial = [r[:1] for r in self.role]
        self.code = [{"s": 0, "u": 1, "a": 2}.get(i, 3) for i in self.initial]
        self.fault = self.rows["fault"].to_pylist()
        self.turn = self.rows["turn"].to_pylist()

    def costs(self, piece: int, end: tuple) -> list[tuple]:
        a, b = self.first[piece], self.end[piece]
        return costs(self.code[a:b], self.fault[a:b], end)

    def ends(self) -> list[int]:
        """The pieces that may go on in another part."""
        return sorted({0, len(self.first) - 1})

    def statistics(self, piece: int) -> dict:
        a, b = self.first[piece], self.end[piece]
        turns = [t for t in self.turn[a:b] if t is not None]
        counts = {name: self.fault[a:b].count(k) for k, name in enumerate(FAULTS) if name}
        illegal = sum(pair not in LEGAL for pair in zip(self.initial[a : b - 1], self.initial[a + 1 : b]))
        return counts | {"illegal": illegal, "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
                         "head": self.initial[a], "tail": self.initial[b - 1]}


def arcs(part: Part, cost: np.ndarray, place: np.ndarray, row: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node and edit (D, I, K, R) the node it leads to on a cheapest path, or -1; nodes are 4 x place + ending.

    ``row`` is the row behind a place or -1 at the end of a piece, ``last`` whether nothing follows that piece.
    """
    states = np.arange(4)
    role, fault = (np.array([*x, 0])[row] for x in (part.code, part.fault))
    inside, free = row >= 0, (row >= 0) & np.isin(fault, (0, 3))
    after = np.vstack([cost[1:], cost[:1]])
    more = TRUNCATED * (fault == 3)[:, None]
    keep = KEEP[:, role].T
    ways = np.full((len(place), 4, 4), -1, np.int64)

    def way(k: int, fits: np.ndarray, left: np.ndarray, to: np.ndarray) -> None:
        ways[:, :, k] = np.where(fits & (cost == left) & (cost < NONE), to, -1)

    way(0, inside[:, None], after + DELETE, 4 * (place + 1)[:, None] + states)
    way(1, (inside | last)[:, None], cost[:, NEXT] + INSERT, 4 * place[:, None] + NEXT)
    kept = np.take_along_axis(after, np.maximum(keep, 0), 1)
    way(2, free[:, None] & (keep >= 0), kept + more, 4 * (place + 1)[:, None] + keep)
    way(3, free[:, None], after[:, NEXT] + REROLE + more, 4 * (place + 1)[:, None] + NEXT)
    ways = ways.reshape(-1, 4)
    known = ways >= 0
    return np.where(known.any(1), known.argmax(1) + 1, 0), ways


def ranked(label: np.ndarray, ways: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Label of the arc that each node's least path takes, its pointers of length 1, 2, 4, ..., and the length of the path."""
    nodes = np.arange(len(label))
    ahead = np.where(label > 0, ways[nodes, np.maximum(label - 1, 0)], nodes)
    rank, pointers, length = label.astype(np.int64), [ahead], (label > 0).astype(np.int64)
    while (label[ahead] > 0).any():
        _, rank = np.unique(rank * (rank.max() + 1) + rank[ahead], return_inverse=True)
        length = length + length[ahead]
        ahead = ahead[ahead]
        pointers.append(ahead)
    # The arc of a node: the least initial, then the rank of what follows.
    high = rank.max(initial=0) + 1
    value = np.where(ways >= 0, np.arange(1, 5) * high + rank[np.maximum(ways, 0)], 5 * high + high)
    taken = np.where(label > 0, value.argmin(1) + 1, 0)
    assert (taken == label).all()
    return taken, pointers, length


def paths(part: Part, ends: dict[int, tuple[tuple, bool]]) -> Iterator[dict]:
    """The least path of each piece: from its beginning for whole conversations, from each ending of roles for the others.

    ``ends`` has the costs behind the pieces that may be cut, and whether they are the last of their conversation.
    """
    pieces = len(part.first)
    found = [part.costs(p, ends[p][0] if p in ends else END) for p in range(pieces)]
    cost = np.array([c for piece in found for c in piece], np.int64)
    begin = np.cumsum([0, *map(len, found)])
    row = np.full(len(cost), -1, np.int64)
    for p in range(pieces):
        row[begin[p] : begin[p + 1] - 1] = np.arange(part.first[p], part.end[p])
    last = np.zeros(len(cost), bool)
    last[[begin[p + 1] - 1 for p in range(pieces) if p not in ends or ends[p][1]]] = True
    label, ways = arcs(part, cost, np.arange(len(cost)), row, last)
    label, pointers, length = ranked(label, ways)
    for p in range(pieces):
        for entry in range(4) if p in ends else (0,):
            start = 4 * begin[p] + entry
            if cost[begin[p], entry] >= NONE:
                continue
            step, at = np.arange(length[start]), np.full(length[start], start)
            for k, ahead in enumerate(pointers):
                at = np.where(step >> k & 1, ahead[at], at)
            edits = label[at]
            to = pointers[0][at] % 4
            shown = edits > 1
            lines = [
                (part.role[row[a // 4]] if e == 3 else "user" if s == 2 else "assistant") + ":" + ("" if e == 2 else part.text[row[a // 4]])
                for a, e, s in zip(at[shown].tolist(), edits[shown].tolist(), to[shown].tolist())
            ]
            leave = int(pointers[-1][start] % 4)
            yield {"piece": p, "entry": entry, "leave": leave, "cost": int(cost[begin[p], entry]), "audit": LETTERS[edits].tobytes().decode(), "lines": lines}


COUNTS = ("blank", "duplicate", "truncated", "illegal")
RESULT = ("gaps", *COUNTS, "cost")


def _result(conv: str) -> str:
    return f"conv_id {conv}, {', '.join(f'{c} bigint' for c in RESULT)}, audit string, repaired_sha256 string"


class Joined:
    """Pieces of one conversation in order, put together."""

    def __init__(self, conv) -> None:  # noqa: ANN001
        self.conv, self.state, self.part, self.audit, self.hash, self.lines = conv, 0, None, [], hashlib.sha256(), 0
        self.counts, self.cost, self.low, self.high, self.turns, self.tail = dict.fromkeys(COUNTS, 0), None, None, None, 0, None

    def add(self, piece: dict) -> None:
        """The path of the piece that begins where the one before ended; the others are passed over."""
        if piece["part"] == self.part or piece["entry"] != self.state:
            return
        self.part, self.state = piece["part"], piece["leave"]
        self.cost = piece["cost"] if self.cost is None else self.cost
        self.audit.append(piece["audit"])
        if piece["lines"]:
            self.hash.update((("\n" if self.lines else "") + piece["text"]).encode())
            self.lines += piece["lines"]
        for c in COUNTS:
            self.counts[c] += piece[c]
        self.counts["illegal"] += self.tail is not None and (self.tail, piece["head"]) not in LEGAL
        self.tail = piece["tail"]
        if piece["low"] is not None:
            self.turns += piece["turns"] - (piece["low"] == self.high)
            self.low = piece["low"] if self.low is None else self.low
            self.high = piece["high"]

    def result(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _table(rows: list[dict], names: list[str], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array([r[n] for r in rows], kinds[n]) for n in names})


def repaired(rows: DataFrame, part_rows: int = PART_ROWS, part_chars: int = PART_CHARS) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation that has rows.

    ``rows`` has ``conv_id, turn, role, text``, without null roles and texts.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    rows = shared.written(faulty(rows))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    parts = max(size.n // part_rows, (size.chars or 0) // part_chars) + 1
    dealt = rows.repartitionByRange(parts, "conv_id", "turn", "role", "text").withColumn("part", F.spark_partition_id())
    dealt = shared.written(dealt)

    def matrices(key: tuple, table: pa.Table) -> pa.Table:
        part = Part(table)
        out = []
        for piece in part.ends():
            columns = [part.costs(piece, tuple(0 if k == e else NONE for k in range(4)))[0] for e in range(4)]
            flat = [min(columns[e][s], NONE) for s in range(4) for e in range(4)]
            out.append({"conv_id": part.rows["conv_id"][part.first[piece]].as_py(), "part": key[0].as_py(), "piece": piece, "matrix": flat})
        kinds = {"conv_id": table.schema.field("conv_id").type, "part": pa.int32(), "piece": pa.int32(), "matrix": pa.list_(pa.int64())}
        return _table(out, list(kinds), kinds)

    def borders(key: tuple, table: pa.Table) -> pa.Table:
        behind, last, out = END, True, []
        for piece in sorted(table.to_pylist(), key=lambda r: -r["part"]):
            out.append({"part": piece["part"], "piece": piece["piece"], "behind": list(behind), "last": last, "whole": False})
            m = piece["matrix"]
            behind = tuple(min(NONE, *(m[4 * s + e] + behind[e] for e in range(4))) for s in range(4))
            last = False
        if len(out) == 1:
            out[0]["whole"] = True
        kinds = {"part": pa.int32(), "piece": pa.int32(), "behind": pa.list_(pa.int64()), "last": pa.bool_(), "whole": pa.bool_()}
        return _table(out, list(kinds), kinds)

    cut = dealt.groupBy("part").applyInArrow(matrices, f"conv_id {conv}, part int, piece int, matrix array<bigint>")
    cut = cut.groupBy("conv_id").applyInArrow(borders, "part int, piece int, behind array<bigint>, last boolean, whole boolean")
    cut = shared.written(cut.filter("NOT whole"))
    stats = {c: pa.int64() for c in (*COUNTS, "low", "high", "turns")} | {"head": pa.string(), "tail": pa.string()}
    plain = {c: pa.int64() for c in RESULT} | {"audit": pa.string(), "repaired_sha256": pa.string()}
    pieces = {"part": pa.int32(), "entry": pa.int32(), "leave": pa.int32(), "lines": pa.int64(), "text": pa.string()}

    def walk(key: tuple, table: pa.Table, behind: pa.Table) -> pa.Table:
        """Results of whole conversations, and the paths of cut pieces (with a ``part``)."""
        part, out = Part(table), []
        ends = {r["piece"]: (tuple(r["behind"]), r["last"]) for r in behind.to_pylist()}
        for path in paths(part, ends):
            one, conv_id = Joined(None), part.rows["conv_id"][part.first[path["piece"]]].as_py()
            text = "\n".join(path["lines"])
            piece = {**path, **part.statistics(path["piece"]), "part": key[0].as_py(), "lines": len(path["lines"]), "text": text}
            if path["piece"] in ends:
                out.append({c: None for c in plain} | piece | {"conv_id": conv_id})
            else:
                one.add(piece)
                out.append({c: None for c in (*stats, *pieces)} | one.result() | {"conv_id": conv_id})
        kinds = {"conv_id": table.schema.field("conv_id").type, **plain, **pieces, **stats}
        return _table(out, list(kinds), kinds)

    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}
    schema = ", ".join(f"{n} {names[k]}" for n, k in (plain | pieces | stats).items())
    walked = dealt.groupBy("part").cogroup(cut.groupBy("part")).applyInArrow(walk, f"conv_id {conv}, {schema}")
    walked = shared.written(walked)
    whole = walked.filter("part IS NULL").select("conv_id", *plain)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {**plain}
        current: Joined | None = None
        for batch in batches:
            done = []
            kinds = {"conv_id": batch.schema.field("conv_id").type, **plain}
            for k in range(batch.num_rows):
                piece = batch.slice(k, 1).to_pylist()[0]
                if current is None or current.conv != piece["conv_id"]:
                    done += [current.result()] if current else []
                    current = Joined(piece["conv_id"])
                current.add(piece)
            if done:
                yield _table(done, list(kinds), kinds).to_batches()[0]
        if current:
            yield _table([current.result()], list(kinds), kinds).to_batches()[0]

    some = walked.filter("part IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "part", "entry")
    joined = some.mapInArrow(stream, _result(conv)).select("conv_id", *plain)
    return whole.unionByName(joined)


def audited(conversations: DataFrame) -> DataFrame:
    """The result for every conversation of ``conversations`` after the damage."""
    known = repaired(damaged(conversations)).withColumnRenamed("conv_id", "_conv")
    every = conversations.select("conv_id").distinct()
    out = every.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in RESULT]
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
