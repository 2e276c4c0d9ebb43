"""Number helpers as Column expressions; none needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Critical values of chi-square (8 degrees at .05 and .001; 9 degrees at .01 and .001).
CHI8_05, CHI8_001, CHI9_01, CHI9_001 = 15.5073, 26.1245, 21.6660, 27.8772


def known(v: Column) -> Column:
    """NaN becomes null, once, at ingest."""
    return F.when(~F.isnan(v), v)


def at_decimals(v: Column, n: int) -> Column:
    """Rounded half to even."""
    return F.bround(v, n)


def first_digit(v: Column) -> Column:
    """First significant digit of a non-zero number, as if written with ten decimals."""
    x = F.abs(v)
    lead = x / F.pow(F.lit(10.0), F.floor(F.log10(x))) + 5e-11
    return F.when(lead >= 10, 1).when(lead < 1, F.floor(lead * 10)).otherwise(F.floor(lead)).cast("int")


def decimals(v: Column) -> Column:
    """Digits after the point of the number written out, trailing zeros left out.

    Numbers printed with an exponent count as written out in full (1e-05 has five), not by the characters of that
    print.
    """
    text, x = v.cast("string"), v.cast("double")
    few = F.when(F.rint(x) == x, 0).when(F.rint(x * 10) / 10 == x, 1).when(F.rint(x * 100) / 100 == x, 2)  # told without a print
    fraction = F.length(F.rtrim(F.regexp_extract(text, r"\.([0-9]+)", 1), F.lit("0")))
    exponent = F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    plain = F.length(F.rtrim(F.substring_index(text, ".", -1), F.lit("0")))
    return F.when(F.coalesce((F.abs(x) < 1e7) & few.isNotNull(), F.lit(False)), few).when(F.contains(text, F.lit("E")), F.greatest(F.lit(0), fraction - exponent)).when(F.contains(text, F.lit(".")), plain).otherwise(F.when(v.isNotNull(), 0))


def last_digit(v: Column) -> Column:
    """Last significant digit of a number written with ten decimals; 0 for zero."""
    text = F.format_string("%.10f", F.abs(v))
    return F.substring(F.rtrim(F.replace(text, F.lit(".")), F.lit("0")), -1, 1).try_cast("int")


def chi2_p8(x: Column) -> Column:
    """Upper tail of chi-square with 8 degrees of freedom, in closed form."""
    h = x / 2
    return F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)


def grim(mean: Column, n: Column, decimals_: int) -> Column:
    """Whether some whole total over ``n`` items rounds to ``mean``."""
    total = F.bround(mean * n, 0)
    near = [F.bround((total + d) / n, decimals_) == F.bround(mean, decimals_) for d in (-1, 0, 1)]
    return near[0] | near[1] | near[2]


def grimmer(mean: Column, sd: Column, n: Column, decimals_: int) -> Column:
    """Whether a whole sum of squares with the parity of the sum fits the standard deviation's rounding."""
    total = F.bround(mean * n, 0)
    half = 0.5 / 10**decimals_
    base = total * total / n
    low = F.ceil((n - 1) * F.greatest(sd - half, F.lit(0.0)) * F.greatest(sd - half, F.lit(0.0)) + base)
    high = F.floor((n - 1) * (sd + half) * (sd + half) + base)
    odd = F.pmod(total.cast("long"), F.lit(2))
    return (high > low) | ((high == low) & (F.pmod(low, F.lit(2)) == odd))
