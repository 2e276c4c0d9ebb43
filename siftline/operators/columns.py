"""Tests on single columns of a long table ``vectors`` (keys, pos, v): one aggregate for each test.

Every function returns a row for each column with the figures, ``flagged`` and ``severity`` (null if not
flagged). Keys name the column; ``pos`` orders its values after nulls are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N


def _say(flagged: Column, severity: Column) -> Column:
    return F.when(flagged, severity)


def coefficient_of_variation(vectors: DataFrame, keys: list[str], threshold: float = 0.01) -> DataFrame:
    """Spread far too small for its mean: below ``threshold``, high below a tenth of it."""
    a = vectors.where("v is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    a = a.where((F.col("n") >= 3) & (F.abs("mean") >= 1e-12)).withColumn("cv", F.col("sd") / F.abs("mean"))
    return a.withColumn("flagged", F.col("cv") < threshold).withColumn("severity", _say(F.col("flagged"), F.when(F.col("cv") < threshold / 10, "high").otherwise("medium")))


def _differences(vectors: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return vectors.withColumn("d", value - F.lag(value).over(Window.partitionBy(*keys).orderBy("pos")))


def arithmetic_sequence(vectors: DataFrame, keys: list[str], tolerance: float = 0.005, log: bool = False) -> DataFrame:
    """Steps that stay within ``tolerance`` of their mean; ``log`` makes it a geometric sequence."""
    v = F.ln("v") if log else F.col("v")
    rows = vectors.where("v > 0") if log else vectors.where("v is not null")
    d = _differences(rows, keys, v).withColumn("step", F.avg("d").over(Window.partitionBy(*keys)))
    a = d.groupBy(*keys).agg(F.count("*").alias("n"), F.max("step").alias("step"), F.max(F.abs(F.col("d") - F.col("step"))).alias("off"))
    a = a.where("n >= 4").withColumn("constant", F.abs("step") < 1e-12).withColumn("deviation", F.when(F.abs("step") >= 1e-12, F.col("off") / F.abs("step")).otherwise(F.col("off")))
    return a.withColumn("flagged", F.col("deviation") < tolerance).withColumn("severity", _say(F.col("flagged"), F.when(F.col("constant") & F.lit(not log), "medium").when(F.col("deviation") < 0.001, "high").otherwise("medium")))


def axis_roles(vectors: DataFrame, keys: list[str], most_off: float = 0.02) -> DataFrame:
    """Whether a column counts rows, is an even axis, or holds few codes: such columns are no measurements."""
    w = Window.partitionBy(*keys)
    along, v = w.orderBy("pos"), F.col("v")
    d = vectors.where("v is not null").select(*keys, "v", (v - F.lag("v").over(along)).alias("d"), (v == F.first("v").over(along) + F.row_number().over(along) - 1).alias("counts"), F.first("v").over(along).alias("first"))
    # one sort gives the places of a monotone column's steps, whose values all differ, and other columns' different values
    d = d.withColumns({"steps": F.count("*").over(w) - 1, "step": F.when((F.min("d").over(w) > 0) | (F.max("d").over(w) < 0), F.col("d"))})
    d = d.withColumns({"place": F.row_number().over(w.orderBy("step", "v")) - 1, "kind": F.dense_rank().over(w.orderBy("step", "v"))})
    middle = F.col("place").isin(F.floor((F.col("steps") + 1) / 2), F.floor((F.col("steps") + 2) / 2))
    a = d.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.bool_and(v == F.floor(v)).alias("whole"),
        F.first("first").alias("first"),
        F.bool_and("counts").alias("counts"),
        (F.bool_and(F.col("d") > 0) | F.bool_and(F.col("d") < 0)).alias("monotone"),
        F.avg(F.when(middle, F.col("step"))).alias("mid"),
        F.min("d").alias("least"),
        F.max("d").alias("most"),
        F.max("kind").alias("distinct_values"),
    )
    a = a.withColumn("off", F.greatest(F.col("most") - F.col("mid"), F.col("mid") - F.col("least")) / F.abs(F.nullif("mid", F.lit(0.0))))
    return a.select(
        *keys,
        "n",
        ((F.col("n") >= 3) & F.col("whole") & F.col("first").isin(0.0, 1.0) & F.col("counts")).alias("is_row_index"),
        F.coalesce((F.col("n") >= 4) & F.col("monotone") & (F.col("off") <= most_off), F.lit(False)).alias("is_axis"),
        ((F.col("n") >= 10) & F.col("whole") & (F.col("distinct_values") <= F.least(F.lit(20), F.greatest(F.lit(3), F.floor(F.col("n") * 0.05))))).alias("is_category"),
    )


def value_recycling(vectors: DataFrame, keys: list[str], ratio: float = 0.3) -> DataFrame:
    """Too few distinct values, other than whole numbers of at most twenty kinds."""
    a = vectors.where("v is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("v").alias("distinct_values"), F.bool_and(F.col("v") == F.floor("v")).alias("whole"))
    a = a.where("n >= 10").withColumn("ratio", F.col("distinct_values") / F.col("n"))
    high = F.when(F.col("n") >= 500, F.col("ratio") < 0.05).otherwise(F.col("ratio") < 0.15) & ~((F.col("n") >= 500) & (F.col("distinct_values") >= 20))
    return a.withColumn("flagged", (F.col("ratio") < ratio) & ~(F.col("whole") & (F.col("distinct_values") <= 20))).withColumn("severity", _say(F.col("flagged"), F.when(high, "high").otherwise("medium")))


def benford(vectors: DataFrame, keys: list[str], least: int = 100) -> DataFrame:
    """Chi-square of first digits against Benford's law, flagged below p = .05."""
    d = vectors.where("v <> 0").withColumn("digit", N.first_digit(F.col("v")))
    counts = [F.count_if(F.col("digit") == k).alias(f"d{k}") for k in range(1, 10)]
    return benford_of(d.groupBy(*keys).agg(F.count("*").alias("n"), *counts), least)


def benford_of(counts: DataFrame, least: int = 100) -> DataFrame:
    """The same from counts: n, d1, ..., d9."""
    a = counts.where(F.col("n") >= least)
    chi = F.lit(0.0)
    for k in range(1, 10):
        want = F.col("n") * F.log10(F.lit(1 + 1 / k))
        chi = chi + (F.col(f"d{k}") - want) * (F.col(f"d{k}") - want) / want
    return a.withColumn("chi2", chi).withColumn("p_value", N.chi2_p8(F.col("chi2"))).withColumn("flagged", F.col("chi2") > N.CHI8_05).withColumn("severity", _say(F.col("flagged"), F.lit("medium")))


def terminal_digit(vectors: DataFrame, keys: list[str], least: int = 50) -> DataFrame:
    """Chi-square of the last digits of whole numbers against an even spread."""
    v = vectors.where("v is not null")
    counts = [F.count_if(F.pmod(F.abs("v").cast("long"), F.lit(10)) == k).alias(f"t{k}") for k in range(10)]
    a = v.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(F.col("v") == F.floor("v")).alias("whole"), F.median(F.abs("v")).alias("middle"), F.count_distinct("v").alias("distinct_values"), *counts)
    a = a.where((F.col("n") >= least) & F.col("whole") & (F.col("middle") >= 10) & (F.col("distinct_values") >= 10))
    chi = F.lit(0.0)
    for k in range(10):
        chi = chi + (F.col(f"t{k}") - F.col("n") / 10) * (F.col(f"t{k}") - F.col("n") / 10) / (F.col("n") / 10)
    a = a.withColumn("chi2", chi)
    return a.withColumn("flagged", F.col("chi2") > N.CHI9_01).withColumn("severity", _say(F.col("flagged"), F.when(F.col("chi2") > N.CHI9_001, "medium").otherwise("low")))


def decimal_uniformity(vectors: DataFrame, keys: list[str]) -> DataFrame:
    a = vectors.where("v is not null").withColumn("decimals", N.decimals(F.col("v"))).groupBy(*keys)
    a = a.agg(F.count("*").alias("n"), F.min("decimals").alias("fewest"), F.max("decimals").alias("most"), F.avg("decimals").alias("mean_decimals")).where("n >= 5")
    return a.withColumn("flagged", F.col("fewest") == F.col("most")).withColumn("severity", _say(F.col("flagged"), F.lit("low")))


def precision_gaps(precision: DataFrame, name: str, least_gap: float = 3) -> DataFrame:
    """Columns of one name whose mean decimals differ by ``least_gap`` between groups."""
    a = precision.groupBy(F.lower(F.trim(F.col(name))).alias("column")).agg(F.count("*").alias("groups"), F.min("mean_decimals").alias("low"), F.max("mean_decimals").alias("high"))
    return a.withColumn("flagged", (F.col("groups") >= 2) & (F.col("high") - F.col("low") >= least_gap))


def sd_regularity(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Standard deviations that are all whole, all halves, or all of one number of decimals."""
    v = vectors.where("v is not null").withColumn("decimals", N.decimals(F.col("v")))
    a = v.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.abs("v")).alias("largest"), F.bool_and(F.col("v") == F.floor("v")).alias("whole"), F.bool_and(F.col("v") * 2 == F.floor(F.col("v") * 2)).alias("halves"), F.min("decimals").alias("fewest"), F.max("decimals").alias("most"))
    a = a.where("n >= 4 and largest > 0")
    a = a.withColumn("pattern", F.when(F.col("whole"), "all_integer").when(F.col("halves"), "all_half_step").when(F.col("fewest") == F.col("most"), "uniform_decimals"))
    return a.withColumn("flagged", F.col("pattern").isNotNull()).withColumn("severity", _say(F.col("flagged"), F.lit("low")))
