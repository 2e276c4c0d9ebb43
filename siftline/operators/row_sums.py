"""Sums of the columns of sheets whose rows come in order, and of each two columns, by numpy over Arrow batches.

Hundreds of running sums a row are dear as columns of a plan (49 µs a row of six columns); here a batch's sheets are
summed at once, and only the sheet that a batch leaves open is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

#: What is told of a column: ``bits`` has as many set as the column has values at most, of its whole ones.
LONGS, DOUBLES, FLAGS = ("n", "bits"), ("mean", "sd", "head", "step", "least_d", "most_d", "log_step", "least_l", "most_l", "_least"), ("counts", "monotone", "whole")
#: What is told of two columns, of the values of one row; ``fine`` is as in ``sheets.fine_matches``, 3 for more, null where it isn't known.
PAIR_LONGS, PAIR_DOUBLES = ("pair_n", "equal", "fine"), ("slope", "intercept", "r_squared", "sa", "sb")
_EIGHT = Decimal("1e-8")


def schema(keys: list[T.StructField]) -> T.StructType:
    """Keys, whether every row has all of the sheet's columns or none, and a list of each figure by column or pair."""
    kinds = {T.LongType(): LONGS + PAIR_LONGS, T.DoubleType(): DOUBLES + PAIR_DOUBLES, T.BooleanType(): FLAGS}
    return T.StructType([*keys, T.StructField("aligned", T.BooleanType()), *(T.StructField(x, T.ArrayType(kind)) for kind, names in kinds.items() for x in names)])


def _eighth(x: float) -> float:
    return float(Decimal(repr(x)).quantize(_EIGHT, ROUND_HALF_EVEN))


def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where two numbers are equal to eight decimals, halves to even; digits are written only where they decide."""
    same = a == b
    near = np.flatnonzero(~same & (np.abs(a - b) <= 2e-8))
    if near.size:
        x, y = a[near], b[near]
        s, t = x * 1e8, y * 1e8
        ok = np.rint(s) == np.rint(t)
        tie = lambda s: np.abs(s - np.floor(s) - 0.5) < 1e-6
        for k in np.flatnonzero((np.abs(s) >= 1e9) | (np.abs(t) >= 1e9) | tie(s) | tie(t)):
            ok[k] = _eighth(float(x[k])) == _eighth(float(y[k]))
        same[near] = ok
    return same


def finer(v: np.ndarray, decimals: int) -> np.ndarray:
    """Where numbers have more decimals than so many, up to five."""
    scale = 10.0**decimals
    out = v != np.rint(v * scale) / scale
    for k in np.flatnonzero(np.abs(v) >= 1e9):  # a product with the scale may not be exact
        out[k] = -Decimal(repr(float(v[k]))).normalize().as_tuple().exponent > decimals if np.isfinite(v[k]) else False
    return out


def bit(v: np.ndarray) -> np.ndarray:
    """One of 64 bits for a value: a column holds at least as many values as bits."""
    h = (v + 0.0).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.uint64(1) << (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(58))


class RowSums:
    """Batches (keys, measures), sorted by keys and place, as one row for each sheet; see ``schema``."""

    def __init__(self, keys: int, measures: int, pairs: list[tuple[int, int]], out: pa.Schema):
        self.keys, self.m, self.pairs, self.out = keys, measures, pairs, out

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the sheet that is open: its key as a slice of each column, and its sums
        with np.errstate(all="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = [batch.column(k) for k in range(self.keys)]
                new = np.zeros(batch.num_rows, bool)
                new[0] = True
                for c in columns:
                    codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                    new[1:] |= codes[1:] != codes[:-1]
                starts = np.flatnonzero(new)
                here = [c.take(pa.array(starts)) for c in columns]
                goes_on = held is not None and all(a.equals(b.slice(0, 1)) for a, b in zip(held[0], here))
                if held is not None and not goes_on:
                    yield self.rows(*held)
                sums = self.sums(batch, starts, held[1] if goes_on else None)
                last = len(starts) - 1
                if last:
                    yield self.rows([c.slice(0, last) for c in here], {x: s[:last] for x, s in sums.items()})
                held = [c.slice(last) for c in here], {x: s[last:] for x, s in sums.items()}
            if held is not None:
                yield self.rows(*held)

    def sums(self, batch: pa.RecordBatch, starts: np.ndarray, before: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
        """Sums by sheet and column of one batch; ``before`` are those of its first sheet so far."""
        size, sheets = batch.num_rows, len(starts)
        sheet = np.repeat(np.arange(sheets), np.diff(np.append(starts, size)))
        first, places = starts[sheet], np.arange(size)
        values, valid, deviations, bits, out = [], [], [], [], {}
        put = lambda x, part: out.setdefault(x, []).append(part)
        total = lambda x: np.add.reduceat(x, starts)
        for k in range(self.m):
            c = batch.column(self.keys + k)
            ok = c.is_valid().to_numpy(zero_copy_only=False)
            v = c.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
            n = total(ok.astype(np.int64))
            mean = np.where(n > 0, total(np.where(ok, v, 0.0)) / n, 0.0)
            mean = np.where(n > 0, mean + total(np.where(ok, v - mean[sheet], 0.0)) / n, 0.0)
            dev = np.where(ok, v - mean[sheet], 0.0)
            at = np.cumsum(ok) - np.concatenate(([0], np.cumsum(n)[:-1]))[sheet]  # place among the column's own, from 1
            seen = np.maximum.accumulate(np.where(ok, places, -1))
            prior = np.concatenate(([-1], seen[:-1]))
            has = prior >= first
            was = np.where(has, v[np.maximum(prior, 0)], 0.0)
            ends = seen[np.append(starts[1:], size) - 1]
            some = n > 0
            last = np.where(some, v[np.maximum(ends, 0)], 0.0)
            begin = np.minimum.reduceat(np.where(ok, places, size), starts)
            head = np.where(some, v[np.minimum(begin, size - 1)], 0.0)
            if before is not None and before["n"][0, k]:
                head[0] = before["head"][0, k]
                at = at + np.where(sheet == 0, before["n"][0, k], 0)
                on = (sheet == 0) & ~has
                was, has = np.where(on, before["last"][0, k], was), has | on
                last[0] = last[0] if n[0] else before["last"][0, k]
            step = ok & has
            d = v - was
            logs = step & (v > 0) & (was > 0)
            ln = np.log(np.where(v > 0, v, 1.0)) - np.log(np.where(was > 0, was, 1.0))
            whole = v == np.floor(v)
            put("n", n), put("mean", mean), put("m2", total(dev * dev)), put("head", head), put("last", last)
            put("not_counts", total((ok & (v != head[sheet] + at - 1)).astype(np.int64))), put("not_whole", total((ok & ~whole).astype(np.int64)))
            put("n_d", total(step.astype(np.int64))), put("ups", total((step & (d > 0)).astype(np.int64))), put("downs", total((step & (d < 0)).astype(np.int64)))
            put("sum_d", total(np.where(step, d, 0.0))), put("n_l", total(logs.astype(np.int64))), put("sum_l", total(np.where(logs, ln, 0.0)))
            low, high = (lambda x, some: np.minimum.reduceat(np.where(some, x, np.inf), starts)), (lambda x, some: np.maximum.reduceat(np.where(some, x, -np.inf), starts))
            put("least_d", low(d, step)), put("most_d", high(d, step)), put("least_l", low(ln, logs)), put("most_l", high(ln, logs)), put("_least", low(v, ok))
            own = bit(v)
            put("bits", np.bitwise_or.reduceat(np.where(ok & whole, own, np.uint64(0)), starts))
            if self.pairs:
                fine = ok & finer(v, 5)
                put("many_fine", total(fine.astype(np.int64)))
                bits.append(np.where(fine, own, np.uint64(0)))
            values.append(v), valid.append(ok), deviations.append(dev)
        sums = {x: np.stack(parts, 1) for x, parts in out.items()}
        every, none = np.logical_and.reduce(valid), ~np.logical_or.reduce(valid)
        sums["odd"] = total((~every & ~none).astype(np.int64))[:, None]
        if self.pairs:
            same = [equal(values[i], values[j]) & valid[i] & valid[j] for i, j in self.pairs]
            sums["equal"] = np.stack([total(s.astype(np.int64)) for s in same], 1)
            sums["cov"] = np.stack([total(deviations[i] * deviations[j]) for i, j in self.pairs], 1)
            sums["fine_bits"] = np.stack([np.bitwise_or.reduceat(np.where(s & (values[i] == values[j]), bits[i], np.uint64(0)), starts) for s, (i, j) in zip(same, self.pairs)], 1)
        return sums if before is None else self.together(before, sums)

    def together(self, old: dict[str, np.ndarray], new: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The first sheet of ``new`` goes on from ``old``."""
        a, b = {x: s[0] for x, s in old.items()}, {x: s[0].copy() for x, s in new.items()}
        n = a["n"] + b["n"]
        part = np.where(n > 0, b["n"] / np.maximum(n, 1), 0.0)
        gap = b["mean"] - a["mean"]
        gap = np.where((a["n"] > 0) & (b["n"] > 0), gap, 0.0)
        whole = {"m2": a["m2"] + b["m2"] + gap * gap * a["n"] * part, "mean": np.where(a["n"] > 0, a["mean"] + gap * part, b["mean"])}
        if self.pairs:
            i, j = (np.array(x) for x in zip(*self.pairs))
            whole["cov"] = a["cov"] + b["cov"] + gap[i] * gap[j] * a["n"][i] * part[i]
        for x in new:
            if x in whole:
                new[x][0] = whole[x]
            elif x in ("bits", "fine_bits"):
                new[x][0] = a[x] | b[x]
            elif x.startswith(("least", "_least")):
                new[x][0] = np.minimum(a[x], b[x])
            elif x.startswith("most"):
                new[x][0] = np.maximum(a[x], b[x])
            elif x not in ("head", "last"):
                new[x][0] = a[x] + b[x]
        new["head"][0] = np.where(a["n"] > 0, a["head"], b["head"])
        return new

    def rows(self, keys: list[pa.Array], s: dict[str, np.ndarray]) -> pa.RecordBatch:
        n, ratio = s["n"], (lambda a, b: np.where(b != 0, a / b, np.nan))
        out = {x: s[x] for x in ("n", "mean", "head", "_least")}
        out |= {"bits": s["bits"].view(np.int64), "sd": np.where(n > 1, np.sqrt(s["m2"] / (n - 1)), np.nan), "step": ratio(s["sum_d"], s["n_d"]), "log_step": ratio(s["sum_l"], s["n_l"])}
        out |= {x: np.where(s["n_" + x[-1]] > 0, s[x], np.nan) for x in ("least_d", "most_d", "least_l", "most_l")}
        out |= {"counts": s["not_counts"] == 0, "whole": s["not_whole"] == 0, "monotone": (s["n_d"] > 0) & ((s["ups"] == s["n_d"]) | (s["downs"] == s["n_d"]))}
        known = {}
        if self.pairs:
            i, j = (np.array(x) for x in zip(*self.pairs))
            ma, mb, cov = s["m2"][:, i], s["m2"][:, j], s["cov"]
            slope = ratio(cov, ma)
            out |= {"pair_n": n[:, i], "equal": s["equal"], "slope": slope, "intercept": s["mean"][:, j] - slope * s["mean"][:, i], "r_squared": ratio(cov / np.sqrt(ma) * cov, np.sqrt(ma) * mb)}
            out |= {"sa": np.sqrt(ma / np.maximum(n[:, i], 1)), "sb": np.sqrt(mb / np.maximum(n[:, j], 1))}
            held = np.bitwise_count(s["fine_bits"]).astype(np.int64)
            few = np.minimum(s["many_fine"][:, i], s["many_fine"][:, j]) < 3
            out["fine"], known["fine"] = np.where(held >= 3, 3, 0), (held >= 3) | few
        arrays = [*keys, pa.array(s["odd"][:, 0] == 0)]
        for field in list(self.out)[len(arrays) :]:
            x = out.get(field.name, np.empty((len(n), 0), np.float64))
            x = np.ascontiguousarray(x).ravel()
            mask = ~known[field.name].ravel() if field.name in known else None
            flat = pa.array(x, mask=mask, from_pandas=x.dtype.kind == "f").cast(field.type.value_type)
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (len(x) // max(len(n), 1)), pa.int32()), flat).cast(field.type))
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, self.out)], schema=self.out)


def summing(keys: int, measures: int, pairs: list[tuple[int, int]], out: pa.Schema) -> Callable:
    return lambda batches: RowSums(keys, measures, pairs, out).run(batches)


def cross_schema(file: T.StructField, sheet: T.StructField) -> T.StructType:
    text, long, double = T.StringType(), T.LongType(), T.DoubleType()
    kinds = {file.name: file.dataType, "sheet_a": sheet.dataType, "column_a": text, "sheet_b": sheet.dataType, "column_b": text, "n": long, "matched": long, "ratio": double, "severity": text}
    return T.StructType([T.StructField(x, kind) for x, kind in kinds.items()])


class Sheet:
    """A sheet's columns, one below the other, with their lengths, the place of the first value that differs from a column's
    first, and of the second with five decimals."""

    def __init__(self, columns: list[tuple[str, np.ndarray]]):
        self.names, self.lengths = [c for c, _ in columns], np.array([len(v) for _, v in columns], np.int64)
        self.values = np.full((len(columns), max(self.lengths, default=0)), np.nan)
        self.changes, self.fine = [], []
        for row, (_, v) in zip(self.values, columns):
            row[: len(v)] = v
            other, fine = np.flatnonzero(~equal(v, np.broadcast_to(v[:1], v.shape))), np.flatnonzero(finer(v, 4))
            self.changes.append(other[0] + 1 if other.size else np.inf), self.fine.append(fine[1] + 1 if fine.size > 1 else np.inf)


def alike(a: Sheet, b: Sheet, least: float) -> Iterator[tuple]:
    """(column_a, column_b, n, matched, ratio, severity) of columns that agree; equality is told exactly for those that are near."""
    for x, name in enumerate(a.names):
        size = min(a.lengths[x], b.values.shape[1])
        v, others, n = a.values[x, :size], b.values[:, :size], np.minimum(a.lengths[x], b.lengths)
        near = ((v == others) | (np.abs(v - others) <= 2e-8)).sum(1)
        for y in np.flatnonzero((n >= 3) & (a.changes[x] <= n) & (near >= least * n - 1e-6)).tolist():
            k = int(n[y])
            matched = int(equal(v[:k], others[y, :k]).sum())
            if matched / k >= least:
                yield name, b.names[y], k, matched, matched / k, "high" if a.fine[x] <= k else "medium"


def crossing(measures: list[str], least: float, out: pa.Schema) -> Callable:
    """Batches of sheets (file, sheet, partners, a list of values or null for each measure), files one after the other."""

    def found(file, sheets: dict, turns: list[tuple]) -> Iterator[tuple]:
        for a, b in turns:
            if a in sheets and b in sheets:
                yield from ((file, a, c, b, *rest) for c, *rest in alike(sheets[a], sheets[b], least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, sheets, turns = None, {}, []
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)
        with np.errstate(all="ignore"):
            for batch in batches:
                rows = []
                lists = [batch.column(3 + k) for k in range(len(measures))]
                for i, (here, sheet, partners) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                    if here != file:
                        rows += found(file, sheets, turns)
                        file, sheets, turns = here, {}, []
                    sheets[sheet] = Sheet([(m, c[i].values.to_numpy(zero_copy_only=False)) for m, c in zip(measures, lists) if c[i].is_valid])
                    turns += ((sheet, b) for b in partners or ())
                if rows:
                    yield batch_of(rows)
            if rows := list(found(file, sheets, turns)):
                yield batch_of(rows)

    return run
