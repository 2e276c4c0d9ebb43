"""The few scalars that no built-in expresses, as Arrow-batched functions on the standard library and numpy."""

from __future__ import annotations

import difflib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Cells of a table of runs: for so much text at a time, and at most for one window.
BLOCK, MOST = 1 << 24, 1 << 26


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(a: np.ndarray, b: np.ndarray, dtype: type) -> np.ndarray:
    """[place in a, place in b]: how many letters before and at both places are equal, one after the other."""
    same = {c: np.where(b == c, np.iinfo(dtype).max, 0).astype(dtype) for c in np.unique(a).tolist()}
    out = np.empty((len(a), len(b)), dtype)
    out[0] = same[int(a[0])] & 1
    for i, c in enumerate(a[1:].tolist(), 1):
        row = out[i]
        row[0] = same[c][0] & 1
        np.add(out[i - 1, :-1], 1, out=row[1:])
        np.bitwise_and(row, same[c], out=row)
    return out


@lru_cache(4)
def _corner(n: int, dtype: type) -> np.ndarray:
    """How long a run can be that begins within a rectangle."""
    return np.minimum(np.minimum.outer(np.arange(1, n + 1), np.arange(1, n + 1)), np.iinfo(dtype).max).astype(dtype)


def _longest(runs: np.ndarray, corner: np.ndarray, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """Letters and places in b and a of the longest piece that a and b share there, the first in b, then in a."""
    r = np.minimum(runs[alo:ahi, blo:bhi], corner[: ahi - alo, : bhi - blo])
    y = int(r.max(0).argmax())
    x = int(r[:, y].argmax())
    k = int(r[x, y])
    return k, blo + y - k + 1, alo + x - k + 1


def _rests(k: int, p: int, j: int, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple]:
    """What is left on both sides of a piece, with the letters at most that each side shares."""
    return [(-min(r[1] - r[0], r[3] - r[2]), *r) for r in ((alo, j, blo, p), (j + k, ahi, p + k, bhi)) if r[0] < r[1] and r[2] < r[3]]


def _matched(runs: np.ndarray, corner: np.ndarray, total: int, rests: list[tuple], need: int) -> int:
    """Letters in matching pieces; given up, with 0, as soon as they can't be more than ``need``."""
    todo, room = [], 0
    while True:
        for r in rests:
            heappush(todo, r)
            room -= r[0]
        if total + room <= need or not todo:
            return total if total > need else 0
        s, *r = heappop(todo)
        room += s
        k, p, j = _longest(runs, corner, *r)
        total, rests = total + k, _rests(k, p, j, *r) if k else []


def _enough(best: float, size: int) -> int:
    """The most matched letters whose ratio isn't above ``best``."""
    need = int(best * size / 2) + 1
    while need >= 0 and 2.0 * need / size > best:
        need -= 1
    return need


def best_ratio(a: str, b: str, least: float) -> float:
    """Best Ratcliff-Obershelp ratio, as difflib's without junk, of a title with the text's start and with windows of its
    length; 0 if none is above ``least``.

    Runs of equal letters are worked out once for all windows that overlap; windows whose largest piece leaves most room
    come first, and each ends when what is left can't reach the best.
    """
    if not a or not b:
        return 0.0
    n, best = len(a), least
    spans = sorted({(0, min(200, len(b))), *((at, min(at + n, len(b))) for at in range(0, max(1, len(b) - n + 1), max(1, n // 4)))})
    if n * max(n, 200) > MOST:  # a table of a very long title would be too large
        m = difflib.SequenceMatcher(None, "", a, autojunk=False)
        for lo, hi in spans:
            m.set_seq1(b[lo:hi])
            best = max(best, m.ratio())
        return best if best > least else 0.0
    ca, cb, at = _codes(a), _codes(b), 0
    while at < len(spans):
        first, end = spans[at][0], at + 1
        while end < len(spans) and n * (spans[end][1] - first) <= BLOCK:
            end += 1
        here = spans[at:end]
        piece = cb[first : max(hi for _, hi in here)]
        runs = _runs(ca, piece, np.uint8)
        if n >= 255 and runs.max() == 255:
            runs = _runs(ca, piece, np.uint16)
        corner, order = _corner(1 << (max(n, 200) - 1).bit_length(), runs.dtype.type), []
        for lo, hi in here:
            whole = (0, n, lo - first, hi - first)
            k, p, j = _longest(runs, corner, *whole)
            rests = _rests(k, p, j, *whole) if k else []
            order.append((k - sum(r[0] for r in rests), hi - lo, k, rests))
        for _, length, k, rests in sorted(order, key=lambda x: -x[0] / (n + x[1])):
            size = n + length
            best = max(best, 2.0 * _matched(runs, corner, k, rests, _enough(best, size)) / size)
        at = end
    return best if best > least else 0.0


@F.pandas_udf(DoubleType())
def title_ratio(title: pd.Series, text: pd.Series, least: pd.Series) -> pd.Series:
    """``best_ratio`` of each title and text; ratios up to ``least`` needn't be told and count as 0."""
    return pd.Series([best_ratio(a or "", b or "", x) for a, b, x in zip(title, text, least)], dtype="float64")
