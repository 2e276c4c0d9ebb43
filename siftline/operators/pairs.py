"""Tests on pairs of columns, rows and sheets. Pairs meet by an equi-join on sheet and position, never by all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(cells: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``pos`` counts the values of a column after nulls are dropped."""
    return cells.where("v is not null").withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def column_pairs(vectors: DataFrame, sheet: list[str], column: str) -> DataFrame:
    """(sheet, a, b, pos, va, vb) for each two columns of a sheet, aligned by position."""
    a = vectors.select(*sheet, F.col(column).alias("a"), "pos", F.col("v").alias("va"))
    b = vectors.select(*sheet, F.col(column).alias("b"), "pos", F.col("v").alias("vb"))
    return a.join(b, [*sheet, "pos"]).where("a < b")


def aligned_duplicates(vectors: DataFrame, sheet: list[str], column: str, most_columns: int = 200) -> DataFrame:
    """Columns that agree at the same positions to eight decimals. Sheets wider than ``most_columns`` are skipped,
    as the reference rules have it."""
    width = vectors.groupBy(*sheet).agg(F.count_distinct(column).alias("_width")).where(F.col("_width") <= most_columns).drop("_width")
    pairs = column_pairs(vectors.join(width, sheet, "left_semi"), sheet, column)
    same = F.bround("va", 8) == F.bround("vb", 8)
    a = pairs.groupBy(*sheet, "a", "b").agg(F.count("*").alias("n"), F.count_if(same).alias("equal"))
    a = a.where("n >= 3").withColumn("ratio", F.col("equal") / F.col("n"))
    return a.withColumn("severity", F.when(F.col("ratio") >= 0.95, "high").when(F.col("ratio") >= 0.8, "medium").when(F.col("ratio") > 0.5, "low"))


def value_overlap(vectors: DataFrame, sheet: list[str], column: str) -> DataFrame:
    """Share of the smaller column's distinct values that both columns hold."""
    values = vectors.select(*sheet, column, F.bround("v", 8).alias("v")).distinct()
    sizes = values.groupBy(*sheet, column).agg(F.count("*").alias("size"))
    a, b = (values.withColumnRenamed(column, x) for x in "ab")
    both = a.join(b, [*sheet, "v"]).where("a < b").groupBy(*sheet, "a", "b").agg(F.count("*").alias("common"))
    both = both.join(sizes.select(*sheet, F.col(column).alias("a"), F.col("size").alias("size_a")), [*sheet, "a"]).join(sizes.select(*sheet, F.col(column).alias("b"), F.col("size").alias("size_b")), [*sheet, "b"])
    return both.withColumn("share", F.col("common") / F.least("size_a", "size_b"))


def linear_dependency(pairs: DataFrame, keys: list[str], x: str, y: str, least: int = 50, r2: float = 0.9999) -> DataFrame:
    """Least squares of ``y`` on ``x``; severity by the rules of the scorer."""
    a = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys)
    a = a.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    a = a.where((F.col("n") >= least) & (F.col("sx") > 1e-10) & (F.col("sy") > 1e-10)).drop("sx", "sy")
    identity = (F.abs(F.col("slope") - 1) < 0.01) & (F.abs("intercept") < 0.01)
    return a.withColumn("flagged", F.col("r_squared") > r2).withColumn("severity", F.when(F.col("flagged"), F.when(F.col("r_squared") > 0.99999, F.when(identity, "high").otherwise("medium")).otherwise("low")))


def row_duplicates(rows: DataFrame, sheet: str, row: str, values: list[str], group: list[str]) -> DataFrame:
    """Rows of a later sheet whose values, to eight decimals, an earlier sheet of the group has too."""
    print_ = F.concat_ws("|", *(F.coalesce(F.bround(v, 8).cast("string"), F.lit("None")) for v in values))
    keyed = rows.where(F.coalesce(*values).isNotNull()).select(*group, F.col(sheet).alias("sheet"), F.col(row).alias("row"), print_.alias("print"))
    first = keyed.groupBy(*group, "sheet", "print").agg(F.min("row").alias("row_a")).withColumnRenamed("sheet", "sheet_a")
    hits = keyed.join(first, [*group, "print"]).where("sheet_a < sheet")
    a = hits.groupBy(*group, "sheet_a", F.col("sheet").alias("sheet_b")).agg(F.count("*").alias("matches"), F.min("row_a").alias("first_row"))
    return a.where("matches >= 3").withColumn("severity", F.when(F.col("matches") >= 5, "high").otherwise("medium"))


def column_duplicates(vectors: DataFrame, group: list[str], sheet: str, column: str, least: float = 0.9) -> DataFrame:
    """Columns of one name position in two sheets that agree in ``least`` of their rows and aren't constant."""
    v = vectors.select(*group, F.col(sheet).alias("sheet"), F.col(column).alias("column"), "pos", F.bround("v", 8).alias("v"))
    a, b = (v.select(*group, "pos", *(F.col(c).alias(f"{c}_{x}") for c in ("sheet", "column", "v"))) for x in "ab")
    pairs = a.join(b, [*group, "pos"]).where("sheet_a < sheet_b")
    out = pairs.groupBy(*group, "sheet_a", "column_a", "sheet_b", "column_b").agg(F.count("*").alias("n"), F.count_if(F.col("v_a") == F.col("v_b")).alias("equal"), F.count_distinct("v_a").alias("kinds"))
    return out.where("n >= 3 and kinds > 1").withColumn("ratio", F.col("equal") / F.col("n")).withColumn("flagged", F.col("ratio") >= least)
