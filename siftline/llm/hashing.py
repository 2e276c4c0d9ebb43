"""64-bit hashes of many stretches of a byte string at once, in numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once, about; longer texts are cut where a stretch may end.
SLICE = 1 << 19

_rng = np.random.default_rng(20)
BYTE = _rng.integers(0, 2**64, 256, "u8")
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(n + 1, SLICE + 1)
        both = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            p = np.full(size, base, "u8")
            p[0] = 1
            both.append(np.cumprod(p, dtype="u8"))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def stretches(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A hash of each stretch of ``flat``, from sums of powers; equal bytes have equal hashes wherever they stand."""
    power, inverse = _powers(len(flat))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(table[flat] * power[: len(flat)], dtype="u8")])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype("u8"))
