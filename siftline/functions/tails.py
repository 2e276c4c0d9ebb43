"""Tail probabilities of test statistics as Column expressions: incomplete gamma and beta functions.

Each is a continued fraction or a series with a fixed number of steps, folded over a sequence; no Python runs. The steps
grow with the root of the degrees of freedom: 300 give twelve digits up to some ten thousand of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 300
_TINY = 1e-300


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _steps(n: int = STEPS) -> Column:
    return F.sequence(F.lit(1), F.lit(n)).cast("array<double>")


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series at z + 9, less the factors between."""
    w = z + 9
    series = (w - 0.5) * F.log(w) - w + 0.9189385332046727 + 1 / (12 * w) - 1 / (360 * w * w * w) + (1 / 1260 - 1 / (1680 * w * w)) / (w * w * w * w * w)
    factors = z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7) * (z + 8)
    return series - F.log(factors)


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, _TINY).otherwise(x)


def _fraction(first: Column, term: Callable[[Column], tuple[Column, Column]]) -> Column:
    """The continued fraction first + a1 / (b1 + a2 / (b2 + ...)), by the quotients of successive numerators and
    denominators; ``term`` gives (a, b) of a step."""
    start = F.struct(_away(first).alias("h"), _away(first).alias("c"), F.lit(0.0).alias("d"))

    def step(s: Column, n: Column) -> Column:
        a, b = term(n)
        ratios = F.struct(_away(b + a / s["c"]).alias("c"), (1 / _away(b + a * s["d"])).alias("d"))
        return _with(ratios, lambda r: F.struct((s["h"] * r["c"] * r["d"]).alias("h"), r["c"].alias("c"), r["d"].alias("d")))

    return F.aggregate(_steps(), start, step, lambda s: s["h"])


def gamma_upper(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function of positive ``a``; 1 from ``x`` of 0 or less."""

    def found(p: Column) -> Column:
        a_, x_ = p["a"], p["x"]
        front = F.exp(a_ * F.log(x_) - x_ - log_gamma(a_))
        start = F.struct((1 / a_).alias("term"), (1 / a_).alias("total"))

        def more(s: Column, n: Column) -> Column:
            return _with(s["term"] * x_ / (a_ + n), lambda t: F.struct(t.alias("term"), (s["total"] + t).alias("total")))

        series = F.aggregate(_steps(), start, more, lambda s: s["total"])
        fraction = _fraction(x_ + 1 - a_, lambda n: (-n * (n - a_), x_ + 1 - a_ + 2 * n))
        return F.when(x_ <= 0, 1.0).when(x_ < a_ + 1, 1 - front * series).otherwise(front / fraction)

    return _with(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x")), found)


def beta_lower(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function of positive ``a`` and ``b``, for ``x`` from 0 to 1."""

    def inner(a_: Column, b_: Column, x_: Column) -> Column:
        def term(n: Column) -> tuple[Column, Column]:
            m = F.floor(n / 2).cast("double")
            even = m * (b_ - m) * x_ / ((a_ + 2 * m - 1) * (a_ + 2 * m))
            odd = -(a_ + m) * (a_ + b_ + m) * x_ / ((a_ + 2 * m) * (a_ + 2 * m + 1))
            return F.when(n % 2 == 0, even).otherwise(odd), F.lit(1.0)

        front = F.exp(log_gamma(a_ + b_) - log_gamma(a_) - log_gamma(b_) + a_ * F.log(x_) + b_ * F.log1p(-x_)) / a_
        return front / _fraction(F.lit(1.0), term)

    def found(p: Column) -> Column:
        swap = p["x"] > (p["a"] + 1) / (p["a"] + p["b"] + 2)
        sides = F.struct(F.when(swap, p["b"]).otherwise(p["a"]).alias("a"), F.when(swap, p["a"]).otherwise(p["b"]).alias("b"), F.when(swap, 1 - p["x"]).otherwise(p["x"]).alias("x"), swap.alias("swap"))
        value = _with(sides, lambda s: _with(inner(s["a"], s["b"], s["x"]), lambda v: F.when(s["swap"], 1 - v).otherwise(v)))
        return F.when(p["x"] <= 0, 0.0).when(p["x"] >= 1, 1.0).otherwise(value)

    return _with(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), x.cast("double").alias("x")), found)


def p_of_t(t: Column, df: Column, two_sided: bool = True) -> Column:
    both = beta_lower(df / 2, F.lit(0.5), df / (df + t * t))
    return both if two_sided else both / 2


def p_of_f(f: Column, df1: Column, df2: Column) -> Column:
    return beta_lower(df2 / 2, df1 / 2, df2 / (df2 + df1 * F.greatest(f, F.lit(0.0))))


def p_of_chi2(x: Column, df: Column) -> Column:
    return gamma_upper(df / 2, x / 2)


def recomputed_p(kind: Column, value: Column, df1: Column, df2: Column, two_sided: bool = True) -> Column:
    """p of a reported statistic by its size: t and r two-sided or not, F and chi2 (chisq, x2) upper tails; null where
    it can't be tested: an unknown kind, a correlation of one or more, a missing number, or no degrees of freedom."""
    x, name = F.abs(value).cast("double"), F.lower(kind)
    p = (
        F.when(name == "t", p_of_t(x, df1, two_sided))
        .when((name == "r") & (x < 1), p_of_t(x * F.sqrt(df1 / (1 - x * x)), df1, two_sided))
        .when((name == "f") & (df2 > 0), p_of_f(x, df1, df2))
        .when(name.isin("chi2", "chisq", "x2"), p_of_chi2(x, df1))
    )
    return F.when((df1 > 0) & ~F.isnan(x), _with(p, lambda v: F.when(v > 1, 1.0).otherwise(v)))
