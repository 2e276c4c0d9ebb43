"""Second looks at stored findings: which no longer stand, which reports they touch, and why a level was high."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import roles as R
from ..session import cut

#: Tests that mean nothing for an independent variable.
VARIABLE_TESTS = ("arithmetic_sequence", "geometric_sequence", "coefficient_of_variation")


def _with_measurement(findings: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``_is_<name>`` for columns of names: whether it may be a measurement's, null for a null. Names repeat far more
    often than they differ, so each is judged once."""
    judged = findings.select(F.explode(F.array(*names)).alias("_name")).where("_name is not null").distinct()
    judged = cut(judged.withColumn("_is", R.is_measurement_name(F.col("_name"))))
    size = judged.agg(F.sum(F.octet_length("_name") + 48)).first()[0] or 0
    judged = F.broadcast(judged) if size <= 8 << 20 else judged
    for name in names:
        findings = findings.join(judged.select(F.col("_name").alias(f"_of_{name}"), F.col("_is").alias(f"_is_{name}")), F.col(name) == F.col(f"_of_{name}"), "left").drop(f"_of_{name}")
    return findings


def standing(findings: DataFrame) -> DataFrame:
    """Findings (test, severity, column, other, deviation, constant, slope, intercept) that still stand by later rules.

    Spread and sequences of columns that are no measurements by name go, and so do exact sequences that aren't
    constant, and lines between a column and itself in other units of a role; a constant column counts as medium.
    """
    c = F.col
    sequence = c("test").isin("arithmetic_sequence", "geometric_sequence")
    constant = F.coalesce(c("constant"), F.lit(False))
    no_role = lambda name: F.coalesce(c(f"_is_{name}"), F.lit(True))
    variable = c("test").isin(*VARIABLE_TESTS) & ~no_role("column")
    exact = sequence & (c("deviation") == 0) & ~constant
    identity = (F.abs(c("slope") - 1) < 1e-9) & (F.abs("intercept") < 1e-9)
    line = (c("test") == "linear_dependency") & (F.coalesce(identity, F.lit(False)) | ~no_role("column") | ~no_role("other"))
    kept = _with_measurement(findings, ["column", "other"]).where(~(variable | F.coalesce(exact, F.lit(False)) | line))
    return kept.withColumn("severity", F.when(sequence & constant & (c("severity") == "high"), "medium").otherwise(c("severity"))).select(*findings.columns)


def about_itself(references: DataFrame, papers: DataFrame, key: str) -> DataFrame:
    """(key, n) of papers with findings on references that bear the paper's own DOI: a running head was read as one."""
    own = papers.select(key, F.lower(F.trim("doi")).alias("own")).where(F.col("own") != "")
    return references.join(own, key).where(F.lower(F.trim("doi")) == F.col("own")).groupBy(key).agg(F.count("*").alias("n"))


def mentions(findings: DataFrame, key: str) -> DataFrame:
    """Per paper: findings, those on columns whose name was lost, and high repeats that long curves explain."""
    curve = (F.col("test") == "value_recycling") & (F.col("severity") == "high") & (F.col("n") >= 500) & (F.col("kinds") >= 20)
    return findings.groupBy(key).agg(F.count("*").alias("findings"), F.count_if(F.contains("location", F.lit("col_"))).alias("unnamed"), F.count_if(curve).alias("curves"))


def bad_rows(rows: DataFrame, title: str, journal: str) -> DataFrame:
    """Rows whose title is missing, short or a file's name, or whose journal is missing."""
    t = F.col(title)
    return rows.where(t.isNull() | (F.length(F.trim(t)) < 10) | F.lower(t).like("%.pdf") | F.lower(t).like("%.doc%") | F.lower(t).like("untitled%") | F.col(journal).isNull() | (F.trim(F.col(journal)) == ""))


def skipped(papers: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(all columns, skip): why a paper has an empty report: a kind that isn't research, or a crawl that failed."""
    why = F.when(F.coalesce(F.lower("kind").isin(*kinds), F.lit(False)), F.lit("no research")).when(F.coalesce(F.col("crawl") == "failed", F.lit(False)), F.lit("crawl failed"))
    return papers.withColumn("skip", why)


def trigger(score: Column, most: Column, dims: Column) -> Column:
    """Why a level was high, in words."""
    return F.concat_ws(" + ", F.when(F.size(dims) > 0, F.array_join(dims, " + ")), F.when(F.size(dims) == 0, F.when(score > 60, F.lit("overall score")).when(most > 60, F.lit("largest dimension"))))
