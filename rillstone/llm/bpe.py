"""Byte-level BPE as a finite-state transducer, and streaming decoding (operator 1).

Encoding. A sequence of tokens is the BPE result of its bytes exactly when each token is the result of its own bytes
and each two neighbours are the result of theirs. So the results are the paths of a nondeterministic transducer that
walks the trie of the vocabulary and, where a token ends, may go back to the root if the token follows the one before
it. ``Transducer`` determinises it as bytes come in: a state is the set of live paths, as the tokens not yet given out
and the place in the trie; a token goes out once all live paths agree on it, which takes a bounded lookahead. States
and steps are kept in arrays that are emptied when they are full, so their size is bounded and their content has no effect.
Pieces are kept with their ids as packed integers, in two generations: a full one becomes the older one, and what is met
again moves to the younger one. A worker process keeps its encoder from task to task.

Decoding. The bytes of many ids are taken from one Arrow array. ``Utf8Stream`` takes tokens or their bytes as they come and
gives out text. Bytes of an unfinished code point wait in a state machine; ill-formed bytes become U+FFFD, as
``bytes.decode(errors="replace")`` has it.

Cases: null text is empty and has no tokens; equal texts give equal rows; texts of any length are cut into pieces in
batches, so memory follows the text and not its tokens; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import islice
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm import shared
from rillstone.llm.splitting import Splitter, tiktoken_class

ROOT = 0
ID_BYTES = 4
Path = tuple[tuple[int, ...], int]


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """The ids of byte strings, plain BPE of short ones, and the trie of the tokens that BPE can give."""

    def __init__(self, ids: dict[bytes, int]) -> None:
        self.ids = ids
        self.bytes_of = {i: b for b, i in ids.items()}
        self._last: dict[int, tuple[int, ...] | None] = {}
        self.child: dict[int, int] = {}
        self.inner, self.token = bytearray(1), array("i", (-1,))
        for text, i in ids.items():
            node = ROOT
            for byte in text:
                below = self.child.get(node << 8 | byte)
                if below is None:
                    below = self.child[node << 8 | byte] = len(self.token)
                    self.inner[node] = 1
                    self.inner.append(0)
                    self.token.append(-1)
                node = below
            self.token[node] = i

    def merged(self, text: bytes, stop: int = 1) -> list[int]:
        """BPE by definition, until ``stop`` parts are left: the neighbours with the lowest id are joined, the leftmost
        first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > stop:
            found = [(self.ids.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, at = min(found)
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Whether BPE of the token's bytes is the token; if so, it knows the two tokens that were joined last."""
        if token not in self._last:
            text = self.bytes_of[token]
            parts = self.merged(text, 2)
            own = len(text) == 1 or len(parts) == 2 and self.merged(text) == [token]
            self._last[token] = tuple(parts) if own else None
        return self._last[token] is not None

    def follows(self, before: int, token: int) -> bool:
        """Whether BPE leaves the border between two reachable tokens alone.

        Goes back in time through the parts that touch the border, undoing the younger one first. Two parts that
        touch are joined if their union has a lower id than what the left one becomes part of, and no higher one than
        what the right one becomes part of: among equal ids the leftmost goes first.
        """
        bytes_of, ids, last = self.bytes_of, self.ids, self._last
        left_limit = right_limit = 1 << 62
        while True:
            joined = ids.get(bytes_of[before] + bytes_of[token])
            if joined is not None and joined < left_limit and joined <= right_limit:
                return False
            if len(bytes_of[before]) > 1 and (before > token or len(bytes_of[token]) == 1):
                left_limit = before
                before = last[before][1]
                self.reachable(before)
            elif len(bytes_of[token]) > 1:
                right_limit = token
                token = last[token][0]
                self.reachable(token)
            else:
                return True


class Numbers:
    """Integers by integers that are not negative, 16 bytes a place; full at three quarters of its places."""

    def __init__(self, places: int) -> None:
        self.mask = (1 << (places - 1).bit_length()) - 1
        self.clear()

    def clear(self) -> None:
        self.n, self.keys, self.values = 0, array("q", (-1,)) * (self.mask + 1), array("q", (0,)) * (self.mask + 1)

    def full(self) -> bool:
        return 4 * self.n >= 3 * self.mask

    def _place(self, key: int) -> int:
        keys, mask = self.keys, self.mask
        at = (key ^ key >> 29) * 0x9E3779B1 >> 11 & mask
        while keys[at] != key and keys[at] >= 0:
            at = at + 1 & mask
        return at

    def get(self, key: int) -> int:
        """-1 for none."""
        at = self._place(key)
        return self.values[at] if self.keys[at] == key else -1

    def put(self, key: int, value: int) -> None:
        at = self._place(key)
        self.n += self.keys[at] != key
        self.keys[at], self.values[at] = key, value


class States:
    """Live paths and the token given out before them, numbered, as integers in one array. The path at the root comes first."""

    def __init__(self, most: int) -> None:
        self.flat, self.ends = array("i"), array("q", (0,))
        self.places = array("i", (-1,)) * (1 << (2 * most).bit_length())

    def __len__(self) -> int:
        return len(self.ends) - 1

    def integers(self, number: int) -> array:
        return self.flat[self.ends[number] : self.ends[number + 1]]

    def add(self, own: array) -> int:
        """The number of the state, a new one if it has none."""
        mask = len(self.places) - 1
        at = hash(own.tobytes()) & mask
        while (number := self.places[at]) >= 0:
            if self.integers(number) == own:
                return number
            at = at + 1 & mask
        self.places[at] = number = len(self)
        self.flat += own
        self.ends.append(len(self.flat))
        return number

    def __getitem__(self, number: int) -> tuple[list[Path], int]:
        flat, at, paths = self.integers(number).tolist(), 1, []
        while at < len(flat):
            end = at + 1 + flat[at]
            paths.append((tuple(flat[at + 1 : end]), flat[end]))
            at = end + 1
        return paths, flat[0]

    def at_root(self, number: int) -> array:
        """Tokens that wait on the path at the root."""
        start = self.ends[number]
        return self.flat[start + 2 : start + 2 + self.flat[start + 1]]


def state(paths: list[Path], given: int) -> array:
    own = [given]
    for waiting, node in paths:
        own += (len(waiting), *waiting, node)
    return array("i", own)


class Transducer:
    """Bytes in, tokens out; determinised as it goes, with at most ``max_states`` states at a time.

    States and steps lie in arrays, some 140 bytes a state with its steps. ``steps`` has those of late as objects.
    """

    def __init__(self, vocabulary: Vocabulary, max_states: int = 300_000, late: int = 32_768) -> None:
        self.vocabulary, self.max_states, self.late = vocabulary, max_states, late
        self.neighbours = Numbers(max_states)
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._clear()

    def _clear(self) -> None:
        self.steps.clear()  # the same table, as encode() is reading it
        self.states = self.stored = None  # their memory goes before that of the next ones comes
        self.states, self.stored = States(self.max_states), Numbers(3 * self.max_states)
        self.outs: list[tuple[int, ...]] = []
        self.out_number: dict[tuple[int, ...], int] = {}
        self.states.add(state([((), ROOT)], -1))

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        if len(self.states) >= self.max_states or self.stored.full():
            own = self.states.integers(number)
            self._clear()
            number = self.states.add(own)
        if len(self.steps) >= self.late:
            self.steps.clear()
        stored = self.stored.get(number << 8 | byte)
        if stored < 0:
            target, out = self._determinised(number, byte)
            at = self.out_number.setdefault(out, len(self.outs))
            if at == len(self.outs):
                self.outs.append(out)
            stored = target << 32 | at
            self.stored.put(number << 8 | byte, stored)
        step = self.steps[number << 8 | byte] = (stored >> 32, self.outs[stored & 0xFFFFFFFF])
        return step

    def _determinised(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        (paths, given), vocabulary = self.states[number], self.vocabulary
        child, inner, token_at, known = vocabulary.child, vocabulary.inner, vocabulary.token, self.neighbours
        moved: list[Path] = []
        for waiting, node in paths:
            below = child.get(node << 8 | byte)
            if below is None:
                continue
            if inner[below]:
                moved.append((waiting, below))
            token = token_at[below]
            if token >= 0:
                before = waiting[-1] if waiting else given
                if before < 0:
                    fits = vocabulary.reachable(token)
                else:
                    fits = known.get(before << 32 | token)
                    if fits < 0:
                        if known.full():
                            known.clear()
                        fits = vocabulary.reachable(token) and vocabulary.follows(before, token)
                        known.put(before << 32 | token, fits)
                if fits:
                    moved.insert(0, ((*waiting, token), ROOT))
        first, agreed = moved[0][0], 0
        if len(moved) == 1:
            agreed = len(first)
        elif all(w and w[0] == first[0] for w, _ in moved):
            shortest, longest = min(w for w, _ in moved), max(w for w, _ in moved)
            while agreed < len(shortest) and shortest[agreed] == longest[agreed]:
                agreed += 1
        out = first[:agreed]
        if agreed:
            moved, given = [(w[agreed:], n) for w, n in moved], out[-1]
        return self.states.add(state(moved, given if any(not w for w, _ in moved) else -1)), out

    def encode(self, piece: bytes) -> list[int]:
        number, out, known = 0, [], self.steps.get
        for byte in piece:
            number, tokens = known(number << 8 | byte) or self._step(number, byte)
            if tokens:
                out += tokens
        # If the input ends here, the one path that stands at the end of a token is the result.
        out += self.states.at_root(number)
        return out


class Pieces(dict):
    """Tokens of pieces as packed 32-bit integers; short ones are kept.

    A whole piece that is a token is that token. Once ``limit`` pieces are held they become the older generation, of which only
    what is met again is kept on.
    """

    def __init__(self, ids: dict[bytes, int], limit: int = 100_000) -> None:
        self.ids, self.limit, self.older = ids, limit, {}
        self.transducer = Transducer(Vocabulary(ids))

    def __missing__(self, piece: str) -> bytes:
        entry = self.older.pop(piece, None)
        if entry is None:
            data = piece.encode()
            whole = self.ids.get(data)
            entry = array("i", (whole,) if whole is not None else self.transducer.encode(data)).tobytes()
        if len(piece) <= 48:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = entry
        return entry


class Encoder:
    """Tokens of whole texts; each match of the pattern is encoded on its own."""

    def __init__(self, ids: dict[bytes, int], pattern: str) -> None:
        self.ids, self.splitter, self.pieces = ids, Splitter(pattern, tiktoken_class(ids)), Pieces(ids)

    @cached_property
    def decimals(self) -> Strings:
        return Strings({i: b"%d," % i for i in self.ids.values()})

    @cached_property
    def bytes(self) -> Strings:
        return Strings({i: b for b, i in self.ids.items()})

    def stream(self, text: str, batch: int = 65_536) -> Iterator[list[int]]:
        """Runs of tokens, each from at most ``batch`` pieces."""
        for run in self.runs(text, batch):
            yield unpacked(run).tolist()

    def runs(self, text: str, batch: int = 65_536) -> Iterator[bytes]:
        """Packed runs of tokens, each from at most ``batch`` pieces."""
        entry_of = self.pieces.__getitem__
        if len(text) <= batch:
            yield b"".join(map(entry_of, self.splitter.pieces(text)))
            return
        found = self.splitter.stream(text)
        while part := list(islice(found, batch)):
            yield b"".join(map(entry_of, part))


def unpacked(run: bytes) -> np.ndarray:
    return np.frombuffer(run, np.int32)


class Strings:
    """A byte string for each id, to be joined for many ids at a time."""

    def __init__(self, string_of: dict[int, bytes]) -> None:
        self.table = pa.array([string_of.get(i) for i in range(max(string_of, default=-1) + 1)], pa.large_binary())

    def joined(self, runs: list[bytes]) -> Iterator[memoryview]:
        """The strings of each packed run, joined."""
        ids = unpacked(b"".join(runs))
        if not len(ids):
            return (memoryview(b"") for _ in runs)
        _, offsets, data = self.table.take(pa.array(ids)).buffers()
        ends = np.cumsum([len(run) // ID_BYTES for run in runs])
        ends, data = np.frombuffer(offsets, np.int64, len(ids) + 1)[ends].tolist(), memoryview(data)
        return (data[a:b] for a, b in zip([0, *ends], ends))


def _utf8_classes() -> list[list[int]]:
    """For every state and byte the next state; 0 is between code points, 8 is ill-formed."""
    table = [[8] * 256 for _ in range(8)]
    table[0][0x00:0x80] = [0] * 0x80
    table[0][0xC2:0xE0] = [1] * 30
    table[0][0xE0], table[0][0xED] = 4, 5
    table[0][0xE1:0xED], table[0][0xEE:0xF0] = [2] * 12, [2] * 2
    table[0][0xF0], table[0][0xF4] = 6, 7
    table[0][0xF1:0xF4] = [3] * 3
    for state, low, high, target in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1),
                                     (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        table[state][low : high + 1] = [target] * (high + 1 - low)
    return table


UTF8 = _utf8_classes()


class Utf8Stream:
    """Text from tokens as they come; at most three bytes wait for the rest of a code point."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of, self.waiting = bytes_of, b""

    def push(self, tokens: Iterable[int]) -> str:
        return self.push_bytes(b"".join(map(self.bytes_of.__getitem__, tokens)))

    def push_bytes(self, data: bytes) -> str:
        data = self.waiting + data
        done = len(data) - self._unfinished(data)
        self.waiting = data[done:]
        return data[:done].decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end are the beginning of a code point that more bytes can finish."""
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                state = 0
                for byte in data[-back:]:
                    state = UTF8[state][byte]
                    if state == 8:
                        return 0
                return back if state else 0
        return 0

    def end(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


def kept() -> dict:
    """What this process keeps from task to task. Functions that travel by value have new globals in every task."""
    name = "_rillstone_llm_bpe_kept"
    return sys.modules.setdefault(name, ModuleType(name)).__dict__


def encoder(path: str, pattern: str) -> tuple[Encoder, dict[int, bytes]]:
    """One encoder for each worker process, vocabulary file as it is now, and pattern."""
    file = os.stat(path)
    key, found = (path, file.st_mtime_ns, file.st_size, pattern), kept()
    if key not in found:
        made = Encoder(ranks(path), pattern)
        found[key] = (made, made.pieces.transducer.vocabulary.bytes_of)
    return found[key]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", most: int = 1 << 24) -> DataFrame:
    """``key`` and ``tokens``, the ids of each whole text. ``path`` is a file that every executor has.

    Rows go out 256 at a time, or once their ids fill ``most`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _ = encoder(path, pattern)
        for batch in batches:
            done, size, rows = 0, 0, []
            for at, text in enumerate(batch["text"], 1):
                rows.append(b"".join(found.runs(text.as_py() or "")))
                size += len(rows[-1])
                if size >= most or len(rows) >= 256 or at == batch.num_rows:
                    ends = np.cumsum([0, *map(len, rows)]) // ID_BYTES
                    tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(unpacked(b"".join(rows))))
                    yield pa.record_batch([batch["key"].slice(done, len(rows)), tokens], ["key", "tokens"])
                    done, size, rows = at, 0, []
        pa.default_memory_pool().release_unused()

    shared.bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, tokens array<int>").select(F.col("key").alias(key), "tokens")


def decode(tokens: DataFrame, path: str, column: str = "tokens", chunk: int = 4096) -> Column:
    """The text of an id column; unknown ids are an error, null gives an empty text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(ids):  # noqa: ANN001, ANN202
        _, bytes_of = encoder(path, "")
        out = []
        for row in ids:
            stream, row = Utf8Stream(bytes_of), [] if row is None else row
            out.append("".join(stream.push(row[i : i + chunk]) for i in range(0, len(row), chunk)) + stream.end())
        return ids.__class__(out)

    return run(tokens[column])


def digests(docs: DataFrame, path: str, pattern: str, most: int = 1 << 20) -> DataFrame:
    """Round trip of every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Texts are encoded run by run. Once the runs of some texts, or of a part of one, fill ``most`` bytes, they are written as
    decimals and decoded together, so neither a long text's ids nor its second copy is held whole. Null is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, bytes_of = encoder(path, pattern)

        def add(states: list[list], runs: list[bytes]) -> None:
            for state, own, digits, data in zip(states, runs, found.decimals.joined(runs), found.bytes.joined(runs)):
                n, ids, back, stream = state
                if n and own:
                    ids.update(b",")
                ids.update(digits[:-1])
                back.update(stream.push_bytes(data).encode())
                state[0] = n + len(own) // ID_BYTES

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [[0, hashlib.sha256(), hashlib.sha256(), Utf8Stream(bytes_of)] for _ in range(part.num_rows)]
                states, runs, size = [], [], 0
                for state, text in zip(rows, part["text"]):
                    for own in found.runs(text.as_py() or ""):
                        states.append(state)
                        runs.append(own)
                        size += len(own)
                        if size >= most:
                            add(states, runs)
                            states, runs, size = [], [], 0
                add(states, runs)
                for _, _, back, stream in rows:
                    back.update(stream.end().encode())
                counts, ids, back, _ = zip(*rows)
                columns = [part["doc_id"], pa.array(counts, pa.int64()), *(pa.array([x.hexdigest() for x in k]) for k in (ids, back))]
                yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    shared.bounded_batches(docs.sparkSession)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, schema)
