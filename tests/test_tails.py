"""Tail probabilities against tabled values and closed forms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from siftline.functions import tails as T


def _p(spark, rows):
    number = lambda x: None if x is None else float(x)
    df = spark.createDataFrame([(k, kind, *map(number, r)) for k, (kind, *r) in enumerate(rows)], "i int, kind string, x double, a double, b double")
    return [r.p for r in sorted(df.select("i", T.recomputed_p(F.col("kind"), F.col("x"), F.col("a"), F.col("b")).alias("p")).collect())]


def test_tabled_values(spark):
    got = _p(spark, [("chi2", 15.5073, 8, None), ("x2", 21.666, 9, None), ("t", 2.228139, 10, None), ("F", 4.964603, 1, 10), ("t", -1.959964, 1e6, None), ("r", 0.576, 10, None), ("F", 1.0, 7, 7), ("f", 0.0, 3, 5), ("chisq", 0.0, 3, None)])
    want = [0.05, 0.01, 0.05, 0.05, 0.05, 0.05, 0.5, 1.0, 1.0]
    assert all(abs(a - b) < (2e-4 if k == 5 else 1e-5) for k, (a, b) in enumerate(zip(got, want))), got


def test_closed_forms(spark):
    chi2 = [("chi2", x, 2.0 * k, None) for x in (0.1, 1.0, 7.0, 40.0, 300.0) for k in (1, 2, 5, 30)]
    want = [math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(int(df / 2))) for _, x, df, _ in chi2]
    t1 = [("t", x, 1.0, None) for x in (0.01, 0.5, 3.0, 500.0)]
    want += [1 - 2 * math.atan(x) / math.pi for _, x, _, _ in t1]
    t2 = [("t", x, 2.0, None) for x in (0.01, 0.5, 3.0, 500.0)]
    want += [1 - x / math.sqrt(2 + x * x) for _, x, _, _ in t2]
    f2 = [("f", x, 2.0, d) for x in (0.2, 1.0, 9.0) for d in (1.0, 4.0, 50.0, 5000.0)]
    want += [(1 + 2 * x / d) ** (-d / 2) for _, x, _, d in f2]
    got = _p(spark, [*chi2, *t1, *t2, *f2])
    assert all(abs(a - b) <= 1e-9 * b + 1e-13 for a, b in zip(got, want))


def test_what_cannot_be_tested(spark):
    assert _p(spark, [("r", 1.0, 5, None), ("z", 1.0, 5, None), ("t", None, 5, None), ("t", 1.0, 0, None), ("f", 1.0, 5, None), (None, 1.0, 5, 5), ("t", float("nan"), 5, None)]) == [None] * 7
