"""Screens of single pictures: perceptual hash, correlation, and signs of spliced blots.

Pictures come as rows (key, width, height, pixels: array of grey values). Each row is screened on its own in
``mapInPandas``; a row that can't be screened gives its error, and the others go on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _resize(grey: np.ndarray, n: int) -> np.ndarray:
    """Nearest neighbours on an n by n grid."""
    h, w = grey.shape
    return grey[(np.arange(n) * h // n)[:, None], np.arange(n) * w // n]


def phash(grey: np.ndarray) -> int:
    """64 bits: which of the lowest cosine coefficients are above their median."""
    n = 32
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ _resize(grey.astype(float), n) @ basis.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    return int(np.packbits(bits).view(">u8")[0].astype("i8"))


def correlation(a: np.ndarray, b: np.ndarray, n: int = 32) -> float:
    """Normalised correlation on one grid, between -1 and 1."""
    x, y = (_resize(p.astype(float), n).ravel() for p in (a, b))
    x, y = x - x.mean(), y - y.mean()
    return float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-12))


def looks_like_blot(grey: np.ndarray) -> bool:
    """Wider than high, some contrast, neither empty nor full, and dark marks in most columns."""
    h, w = grey.shape
    if not 1.3 <= w / h <= 8 or not 12 <= grey.std() <= 110:
        return False
    dark = grey < (grey.max() + grey.min()) / 2
    return bool(0.05 <= dark.mean() <= 0.95 and dark.any(axis=0).mean() >= 0.5 and (dark.mean(axis=1) > 0.98).sum() < 2)


def seams(grey: np.ndarray, z_least: float = 9, span: float = 0.85, margin: float = 0.06) -> list[int]:
    """Columns where almost all rows step at once: robust z of the edge energy, local peaks at least three apart."""
    step = np.abs(np.diff(grey.astype(float), axis=1))
    energy = step.mean(axis=0)
    mid = np.median(energy)
    z = (energy - mid) / (1.4826 * np.median(np.abs(energy - mid)) + 1e-9)
    busy = (step > np.percentile(step, 50)).mean(axis=0)
    kept: list[int] = []
    for x in range(1, len(z) - 1):
        if z[x] > z_least and busy[x] >= span and z[x] >= z[x - 1] and z[x] >= z[x + 1] and margin <= x / len(z) <= 1 - margin and (not kept or x - kept[-1] > 3):
            kept.append(x)
    return kept


def steps(grey: np.ndarray, x: int, reach: int = 12) -> tuple[float, float]:
    """Background step and exposure step across a column, as shares of the range of grey values."""
    g = grey.astype(float)
    left, right = g[:, max(0, x - reach) : x], g[:, x + 1 : x + 1 + reach]
    range_ = max(1.0, g.max() - g.min())
    return abs(np.percentile(left, 90) - np.percentile(right, 90)) / range_, abs(np.median(left) - np.median(right)) / range_


def block_variation(grey: np.ndarray, size: int = 48) -> float:
    """Coefficient of variation of the Laplacian's variance over blocks; 0 with fewer than six blocks."""
    g = grey.astype(float)
    lap = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]
    v = [lap[a : a + size, b : b + size].var() for a in range(0, lap.shape[0] - size + 1, size) for b in range(0, lap.shape[1] - size + 1, size)]
    return float(np.std(v) / (np.mean(v) + 1e-9)) if len(v) >= 6 else 0.0


def screen(pictures: DataFrame, key: str) -> DataFrame:
    """(key, phash, is_blot, seams, suspect, error): suspect if a seam is borne out by a step on either side."""

    def each(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for k, w, h, pixels in zip(frame[key], frame.width, frame.height, frame.pixels):
                try:
                    grey = np.asarray(pixels, float).reshape(int(h), int(w))
                    blot = looks_like_blot(grey)
                    found = seams(grey) if blot else []
                    sure = [x for x in found if (s := steps(grey, x))[0] >= 0.18 or s[1] >= 0.20]
                    rows.append((k, phash(grey), blot, found, bool(sure), None))
                except (ValueError, TypeError, ZeroDivisionError) as e:
                    rows.append((k, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "phash", "is_blot", "seams", "suspect", "error"]).astype({"phash": "Int64", "is_blot": "boolean", "suspect": "boolean"})

    kind = dict(pictures.dtypes)[key]
    return pictures.select(key, "width", "height", "pixels").mapInPandas(each, f"{key} {kind}, phash long, is_blot boolean, seams array<int>, suspect boolean, error string")


def merged_peaks(peaks, apart: int = 3):
    """Column of an array of positions: each kept only if more than ``apart`` beyond the last one kept."""
    return F.aggregate(peaks, F.expr("cast(array() as array<int>)"), lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > apart), F.concat(kept, F.array(x))).otherwise(kept))
