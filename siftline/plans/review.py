"""Decision over the passes of a review: what the final result is, given the passes that ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .score import HIGH, LOW


def decide(first: Column, second: Column, judge: Column) -> Column:
    """first, second, judge: 'high', 'low', 'error' or null where the pass wasn't run.

    A first high stands. Two lows agree. Otherwise the judge decides; without a usable judge the one
    substantive pass stands, two that differ are high, and none at all is an error.
    """
    ok = lambda c: c.isin("high", "low")
    one = F.coalesce(F.when(ok(first), first), F.when(ok(second), second))
    return (
        F.when(first == "high", "high")
        .when((first == "low") & (second == "low"), "low")
        .when((first == "error") & (second == "high") & ~F.coalesce(ok(judge), F.lit(False)), "high")
        .when(ok(judge), judge)
        .when(ok(first) & ok(second), "high")
        .when(one.isNotNull(), one)
        .otherwise("error")
    )


def verdicts(passes: DataFrame, key: str) -> DataFrame:
    """``passes``: key, pass (first, second, judge), result, data_review. One row for each key with the decision
    and the longest data review of the passes that agree with it."""
    wide = passes.groupBy(key).agg(*(F.max(F.when(F.col("pass") == p, F.col("result"))).alias(p) for p in ("first", "second", "judge")))
    wide = wide.withColumn("final", decide(F.col("first"), F.col("second"), F.col("judge")))
    agree = passes.join(wide.select(key, "final"), key).where(F.col("result") == F.col("final"))
    text = agree.groupBy(key).agg(F.max_by("data_review", F.struct(F.length("data_review"), "data_review")).alias("data_review"))
    repaired = F.col("first").isin("high", "low").cast("int") + F.coalesce(F.col("second").isin("high", "low").cast("int"), F.lit(0))
    wide = wide.withColumn("warning", (F.coalesce(F.col("judge"), F.lit("error")) == "error") & (F.coalesce(repaired, F.lit(0)) == 1) & (F.col("first") != "high"))
    return wide.join(text, key, "left").withColumn("level", F.when(F.col("final") == "high", HIGH).when(F.col("final") == "low", LOW))


#: Tests that alone are strong evidence when high.
STRONG_TESTS = ("cross_sheet_row_duplicate", "cross_sheet_column_duplicate", "cross_group_duplicate", "pdb_duplicate_coordinates")


def evidence(findings: DataFrame, key: str) -> DataFrame:
    """Per paper the counts by kind, and whether the findings alone are strong: a high one of the strong tests, two
    high pictures, or five high ones of any kind."""
    high = F.col("severity") == "high"
    a = findings.groupBy(key).agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("data", "image", "reference")), F.count_if(high).alias("n_high"),
        F.coalesce(F.bool_or(high & F.col("test").isin(*STRONG_TESTS)), F.lit(False)).alias("has_strong"), F.count_if(high & (F.col("kind") == "image")).alias("n_pictures"),
    )
    return a.withColumn("strong", F.col("has_strong") | (F.col("n_pictures") >= 2) | (F.col("n_high") >= 5)).drop("has_strong", "n_pictures")


def coverage(results: DataFrame, listed: DataFrame, seen: DataFrame, key: str, item: str) -> DataFrame:
    """``results`` with how many of the listed items a review has seen and the names of those it hasn't, ten at most
    being shown; the result itself never changes."""
    all_ = listed.select(key, item).distinct().join(seen.select(key, item).distinct().withColumn("_seen", F.lit(True)), [key, item], "left")
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_seen").isNotNull(), item))
    a = all_.withColumn("_turn", turn).groupBy(key).agg(F.count("*").alias("listed"), F.count("_seen").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("_seen").isNull() & (F.col("_turn") <= 10), F.col(item)))).alias("missing"))
    out = results.join(a, key, "left").na.fill(0, ["listed", "covered"])
    return out.withColumn("missing", F.coalesce("missing", F.array().cast("array<string>"))).withColumn("complete", F.col("listed") == F.col("covered"))


def identity(version: str, *parts: Column) -> Column:
    """What a stored stage of a review is filed under: a digest of the version and of what it was made from."""
    return F.sha2(F.concat_ws("|", F.lit(version), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def resumable(wanted: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """``wanted`` (key, identity) with the stored result of the same identity, and ``state``: done, stale where only
    another identity is stored, or new."""
    last = stored.groupBy(*key).agg(F.max_by(F.struct("identity", "result"), "saved").alias("_s"))
    j = wanted.join(last, key, "left")
    same = F.coalesce(F.col("_s.identity") == F.col("identity"), F.lit(False))
    return j.withColumn("result", F.when(same, F.col("_s.result"))).withColumn("state", F.when(same, "done").when(F.col("_s").isNotNull(), "stale").otherwise("new")).drop("_s")


def progress(results: DataFrame, group: list[str], seconds: float) -> DataFrame:
    """How far a batch of reviews is: done, errors, seconds used and whether another fits the budget of ``seconds``,
    going by the mean of those done."""
    a = results.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(F.col("result").isin("high", "low")).alias("done"), F.count_if(F.col("result") == "error").alias("errors"), F.sum("took").alias("used"), F.avg("took").alias("mean"))
    return a.withColumn("may_start", F.coalesce(F.col("used") + F.col("mean") <= seconds, F.lit(True))).drop("mean")


def finding_blocks(findings: DataFrame, key: str, most: int = 10) -> DataFrame:
    """(key, test, block): the findings of each test as text, the worst first, ``most`` of them shown and the others
    counted."""
    level = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    turn = F.row_number().over(Window.partitionBy(key, "test").orderBy(level, "location"))
    shown = findings.withColumn("_turn", turn).groupBy(key, "test").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_turn") <= most, F.struct("_turn", "severity", "location")))).alias("shown"))
    lines = F.transform("shown", lambda x: F.concat(F.lit("- ["), x["severity"], F.lit("] "), x["location"]))
    more = F.when(F.col("n") > most, F.array(F.concat(F.lit("- and "), (F.col("n") - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return shown.select(key, "test", F.array_join(F.concat(F.array(F.concat("test", F.lit(": "), F.col("n").cast("string"))), lines, more), "\n").alias("block"))
