"""Maps of a number that are straight lines by pieces, such as what a block of samples does to a moving average.

A map is three arrays: ``lo`` with the lower ends of its pieces in order, from 0 (each piece reaches up to the next),
``slope`` and ``add``. Slopes are not negative. Maps of consecutive blocks combine into one map in any grouping, so a
recurrence whose rule depends on its own state is still a parallel scan.
"""

from __future__ import annotations

import numpy as np

Map = tuple[np.ndarray, np.ndarray, np.ndarray]

# Above every state, and far enough from the largest double.
TOP = 1e300


def value_at(line: Map, a: float) -> float:
    lo, slope, add = line
    k = int(np.searchsorted(lo, a, side="right")) - 1
    return float(slope[k] * a + add[k])


def _tidy(lo: np.ndarray, slope: np.ndarray, add: np.ndarray) -> Map:
    """Without empty pieces and without ends between pieces of the same line."""
    full = np.append(lo[1:] > lo[:-1], True)
    lo, slope, add = lo[full], slope[full], add[full]
    other = np.append(True, (slope[1:] != slope[:-1]) | (add[1:] != add[:-1]))
    return lo[other], slope[other], add[other]


def composed(first: Map, then: Map) -> Map:
    """The map that applies ``first`` and ``then`` to what comes out."""
    lo, slope, add = first
    hi = np.append(np.nextafter(lo[1:], -np.inf), TOP)
    ends, outer, shift = then
    from_piece = np.searchsorted(ends, slope * lo + add, side="right") - 1
    to_piece = np.searchsorted(ends, slope * hi + add, side="right") - 1
    crossed = to_piece - from_piece + 1
    own = np.repeat(np.arange(len(lo)), crossed)
    step = np.arange(len(own)) - np.repeat(np.cumsum(crossed) - crossed, crossed)
    piece = from_piece[own] + step
    inner = np.where(slope[own] > 0, slope[own], 1.0)
    cut = np.clip((ends[piece] - add[own]) / inner, lo[own], hi[own])
    start = np.maximum.accumulate(np.where(step == 0, lo[own], cut))
    return _tidy(start, outer[piece] * slope[own], outer[piece] * add[own] + shift[piece])


def average_of(x: np.ndarray, decay: float, warm_up: float, most: int | None = None) -> Map | None:
    """What the samples ``x`` do to an average that is added up below ``warm_up`` and decays above it.

    At ``warm_up`` exactly it is divided by ``warm_up``, and that sample is not used. A piece of states follows one rule
    until one of its ends gets to the other side; there it is cut. None if more than ``most`` pieces come about.
    """
    n, keep = len(x), 1.0 - decay
    weight = np.append(1.0, keep ** np.arange(1, n + 1))
    local = np.append(0.0, weight[1:] * np.cumsum(decay * x / weight[1:])) if keep > 0 else np.append(0.0, x)
    total = np.append(0.0, np.cumsum(x))
    done: list[tuple[float, float, float]] = []
    work = [(0.0, TOP, 1.0, 0.0, 0, None)]
    while work:
        if most is not None and len(done) + len(work) > most:
            return None
        lo, hi, slope, add, i, side = work.pop()
        while i < n:
            low, high = slope * lo + add, slope * hi + add
            if side is None:
                side = 1 if low > warm_up else -1 if high < warm_up else 0 if low == high else None
            if side is None:
                cut = (warm_up - add) / slope
                down, up = np.nextafter(cut, -np.inf), np.nextafter(cut, np.inf)
                parts = [(lo, min(hi, down), -1), (max(lo, cut), min(hi, cut), 0), (max(lo, up), hi, 1)]
                work.extend((a, b, slope, add, i, s) for a, b, s in parts if a <= b)
                break
            if side == 0:
                slope, add, i, side = 0.0, 1.0, i + 1, None
                continue
            if side > 0:
                ratio = weight[i + 1 :] / weight[i]
                gained = local[i + 1 :] - local[i] * ratio
                turned = gained + ratio * low <= warm_up
            else:
                ratio, gained = None, total[i + 1 :] - total[i]
                turned = gained + high >= warm_up
            j = int(turned.argmax())
            j = j if turned[j] else n - i - 1
            r = 1.0 if ratio is None else ratio[j]
            slope, add, i, side = r * slope, r * add + gained[j], i + j + 1, None
        else:
            done.append((lo, slope, add))
    return _tidy(*np.array(sorted(done), dtype="float64").T)
