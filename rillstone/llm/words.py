"""Words of whole texts as 64-bit hashes, computed with numpy over an Arrow batch.

A word is a maximal run of bytes other than space and 0x09-0x0D. Equal words have equal hashes wherever they stand;
nothing here depends on the batch, the task or the process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 18
"""Texts are hashed in chunks of about this many bytes, so that memory does not follow the batch."""


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


BASE = 0x9E3779B97F4A7C13
SHINGLE_BASE = 0xD1342543DE82EF93
WINDOW_BASE = 0xA24BAED4963EE40B
BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, np.uint64) * U64(2) + U64(1)
LOWERED = BYTES.copy()
LOWERED[65:91] = BYTES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of a base and of its inverse, made longer when they are needed."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, _powers(base, 1024), _powers(_inverse(base), 1024)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, n), _powers(_inverse(self.base), n)


_CHARS = Powers(BASE)


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The bytes of a text column in one Arrow array; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def _spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; ``starts`` are the bytes at which a text begins."""
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hashed(data: np.ndarray, first: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    _CHARS.grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * _CHARS.up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[first]) * _CHARS.down[first] + (end - first).astype(U64))


def _cuts(data: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Stretches of one long text, cut at white space only."""
    out, at = [], 0
    while len(data) - at > limit:
        gap = np.flatnonzero(SPACE[data[at : at + limit]])
        reach = limit
        while not len(gap) and at + reach < len(data):
            gap = np.flatnonzero(SPACE[data[at + reach : at + 2 * reach]]) + reach
            reach *= 2
        stop = at + int(gap[-1]) + 1 if len(gap) else len(data)
        out.append((at, stop))
        at = stop
    return [*out, (at, len(data))] if at < len(data) else out


def documents(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """``(first row, end row, [word hashes of each row])`` for consecutive stretches of the rows.

    ``lower`` takes A-Z as a-z. A text longer than a chunk comes in a stretch of its own.
    """
    texts, table = binary(column), LOWERED if lower else BYTES
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    values = texts.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        part, starts = data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        if stop == row + 1:
            pieces = []
            for a, b in _cuts(part, CHUNK_BYTES):
                first, end = _spans(part[a:b], np.zeros(0, np.int64))
                pieces.append(_hashed(part[a:b], first, end, table))
            yield row, stop, [np.concatenate(pieces) if pieces else np.zeros(0, U64)]
        else:
            first, end = _spans(part, starts[:-1])
            hashes = _hashed(part, first, end, table) if len(part) else np.zeros(0, U64)
            yield row, stop, np.split(hashes, np.searchsorted(first, starts[1:-1]))
        row = stop
    pa.default_memory_pool().release_unused()


def grams(words: np.ndarray, n: int, powers: np.ndarray) -> np.ndarray:
    """Hash of every run of ``n`` words; none if there are fewer. ``powers`` has at least ``n`` numbers."""
    if len(words) < n:
        return np.zeros(0, U64)
    total = words[: len(words) - n + 1] * powers[0]
    for k in range(1, n):
        total = total + words[k : len(words) - n + 1 + k] * powers[k]
    return mix(total)


SHINGLE = _powers(SHINGLE_BASE, 64)


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """The distinct ``n``-word shingles, sorted; fewer words make one shingle of all, no word makes none."""
    if not len(words):
        return np.zeros(0, U64)
    if len(words) < n:
        return mix((words * SHINGLE[: len(words)]).sum(keepdims=True) + U64(len(words)))
    return np.unique(grams(words, n, SHINGLE))
