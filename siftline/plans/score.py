"""Scoring of findings: severities are reclassified, capped, summed by dimension, and combined to a level.

``findings``: bundle_id, kind (data, image, splice, reference), ord, test, severity, and what the rules read:
r_squared, slope, intercept, overlap_ratio, p_value, title_similarity, match_type, page_a, page_b, image_a,
image_b; where they are there also ref_text and resolved_doi of a reference, size_a and size_b of images.
``papers``: bundle_id, total_references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S

#: How many high findings of a test keep their severity.
HIGH_CAPS = {"arithmetic_sequence": 8, "coefficient_of_variation": 6}
#: Weights of the dimensions and of the largest of them.
WEIGHTS = {"image": 0.20, "data": 0.65, "reference": 0.05}
LARGEST = 0.10
#: Fixed value: image files with fewer bytes are no pictures.
LEAST_BYTES = 2000
HIGH, LOW = "高风险", "低风险"


def reclassified() -> Column:
    """The severity that scoring uses, from what the detector recorded."""
    identity = (F.abs(F.col("slope") - 1) < 0.01) & (F.abs("intercept") < 0.01)
    linear = F.when(F.col("r_squared") > 0.99999, F.when(identity, "high").otherwise("medium")).otherwise("low")
    overlap = F.when(F.col("overlap_ratio") >= 0.95, "high").when(F.col("overlap_ratio") >= 0.90, "medium").otherwise("low")
    title = F.when(F.col("title_similarity") < 0.5, "high").when(F.col("title_similarity") < 0.75, "medium").otherwise(F.col("severity"))
    return F.when(F.col("test") == "linear_dependency", linear).when(F.col("test") == "cross_group_duplicate", overlap).when(F.col("test").isin("title_mismatch", "low_match_score"), title).otherwise(F.col("severity"))


def capped(findings: DataFrame) -> DataFrame:
    """Adds ``level_of``: in order, high findings beyond a test's cap count as medium."""
    f = findings.withColumn("level_of", reclassified())
    rank = F.row_number().over(Window.partitionBy("bundle_id", "kind", "test", "level_of").orderBy("ord"))
    over = F.lit(False)
    for test, most in HIGH_CAPS.items():
        over = over | ((F.col("test") == test) & (F.col("rank") > most))
    return f.withColumn("rank", rank).withColumn("level_of", F.when((F.col("kind") == "data") & (F.col("level_of") == "high") & over, "medium").otherwise(F.col("level_of"))).drop("rank")


def dimension_score(high: Column, medium: Column, low: Column) -> Column:
    total = high + medium + low
    volume = F.when(total > 150, 20).when(total > 80, 12).when(total > 30, 6).otherwise(0)
    return F.least(F.lit(100), F.least(F.lit(80), high * 10) + F.least(F.lit(25), medium * 4) + F.least(F.lit(12), F.bround(low * 0.5, 0).cast("int")) + volume).cast("int")


def crosses_images() -> Column:
    """Duplicates between different images on different pages; echoes within a page are layout."""
    return (F.col("image_a") != F.col("image_b")) & ~((F.col("page_a") > 0) & (F.col("page_a") == F.col("page_b")))


def _counts() -> dict[str, Column]:
    """Counts of severities by dimension, over capped findings."""
    dim = F.when(F.col("kind") == "splice", "image").otherwise(F.col("kind"))
    counted = (F.col("kind") != "image") | crosses_images()
    counts = {f"{d}_{s}": F.count_if(counted & (dim == d) & (F.col("level_of") == s)) for d in WEIGHTS for s in ("high", "medium", "low")}
    return counts | {"splices": F.count_if(F.col("kind") == "splice")}


def _scored(a: DataFrame) -> DataFrame:
    for d in WEIGHTS:
        a = a.withColumn(f"{d}_score", dimension_score(*(F.col(f"{d}_{s}") for s in ("high", "medium", "low"))))
    return a.withColumn("image_score", F.when(F.col("splices") >= 2, F.greatest("image_score", F.lit(56))).otherwise(F.col("image_score")))


def dimensions(findings: DataFrame) -> DataFrame:
    """One row for each bundle: counts and scores of the data, image and reference dimensions."""
    return _scored(capped(findings).groupBy("bundle_id").agg(*(c.alias(k) for k, c in _counts().items())))


def is_filtered(findings: DataFrame) -> Column:
    """High findings on references that tell of bad reading: the work was found after all, or its text is noise."""
    resolved = F.col("resolved_doi").isNotNull() if "resolved_doi" in findings.columns else F.lit(False)
    noise = S.is_noise(F.col("ref_text")) if "ref_text" in findings.columns else F.lit(False)
    return (F.col("test").isin("title_mismatch", "low_match_score") & resolved) | noise


def _signs(findings: DataFrame) -> dict[str, Column]:
    """Indicators of fraud, and counts that burden, duplicates and broken references are told by."""
    data = F.col("kind") == "data"
    high = F.col("severity") == "high"
    has = {
        "cv": data & (F.col("test") == "coefficient_of_variation") & high,
        "arithmetic": data & (F.col("test") == "arithmetic_sequence") & high,
        "geometric": data & (F.col("test") == "geometric_sequence") & high,
        "overlap": data & (F.col("test") == "cross_group_duplicate") & (F.col("overlap_ratio") >= 0.8),
        "image": (F.col("kind") == "image") & high & crosses_images(),
        "identity": data & (F.col("test") == "linear_dependency") & (F.col("r_squared") > 0.99999) & (F.abs(F.col("slope") - 1) < 0.01) & (F.abs("intercept") < 0.01),
        "benford": data & (F.col("test") == "benfords_law") & (F.col("p_value") < 0.001),
    }
    strong = F.col("level_of").isin("high", "medium")
    broken = (F.col("kind") == "reference") & (F.col("level_of") == "high")
    filtered = F.coalesce(is_filtered(findings), F.lit(False))
    return {f"has_{k}": F.max(F.coalesce(c, F.lit(False))).cast("int") for k, c in has.items()} | {
        "n_data": F.count_if(data),
        "n_strong": F.count_if(data & strong),
        "n_recycling": F.count_if(data & strong & (F.col("test") == "value_recycling")),
        "n_benford": F.count_if(data & strong & (F.col("test") == "benfords_law")),
        "n_references": F.count_if((F.col("kind") == "reference") & strong),
        "n_cross": F.count_if((F.col("kind") == "image") & crosses_images()),
        "n_full": F.count_if((F.col("kind") == "image") & crosses_images() & high & (F.col("match_type") == "full_duplicate")),
        "n_fabricated": F.count_if(broken & ~filtered),
        "n_filtered": F.count_if(broken & filtered),
    }


def signs(findings: DataFrame) -> DataFrame:
    """Counts that the combined level reads: indicators of fraud, burden, duplicates and broken references."""
    return _weighed(capped(findings).groupBy("bundle_id").agg(*(c.alias(k) for k, c in _signs(findings).items())))


def _weighed(a: DataFrame) -> DataFrame:
    fraud = sum((F.col(c) for c in a.columns if c.startswith("has_")), (F.col("n_data") > 100).cast("int"))
    a = a.withColumn("fraud", fraud)
    return a.withColumn("burden", (F.col("n_data") >= 15) & (F.col("n_strong") >= 7) & (F.col("n_recycling") >= 3) & (F.col("n_benford") >= 2) & (F.col("n_references") >= 4))


def image_pages(findings: DataFrame) -> DataFrame:
    """Pairs of images across pages that count: few page pairs, no image in more than four pairs or of fewer than
    ``LEAST_BYTES`` bytes, at least ten."""
    f = findings.where((F.col("kind") == "image") & crosses_images())
    ends = f.select("bundle_id", F.explode(F.array("image_a", "image_b")).alias("image")).groupBy("bundle_id", "image").agg(F.count("*").alias("degree"))
    per = ends.groupBy("bundle_id").agg(F.count("*").alias("images"))
    pages = F.when((F.col("page_a") > 0) & (F.col("page_b") > 0), F.concat_ws("|", F.least("page_a", "page_b"), F.greatest("page_a", "page_b"))).otherwise(F.concat_ws("|", F.least("image_a", "image_b"), F.greatest("image_a", "image_b")))
    page_pairs = f.groupBy("bundle_id").agg(F.count_distinct(pages).alias("page_pairs"))
    pairs = f.select("bundle_id", F.least("image_a", "image_b").alias("a"), F.greatest("image_a", "image_b").alias("b")).distinct()
    busy = ends.where("degree > 4").select("bundle_id", "image")
    for x in "ab":
        if f"size_{x}" in findings.columns:
            busy = busy.unionByName(f.where(F.col(f"size_{x}") < LEAST_BYTES).select("bundle_id", F.col(f"image_{x}").alias("image")))
    calm = pairs.join(busy.select("bundle_id", F.col("image").alias("a")), ["bundle_id", "a"], "left_anti").join(busy.select("bundle_id", F.col("image").alias("b")), ["bundle_id", "b"], "left_anti")
    n = calm.groupBy("bundle_id").agg(F.count("*").alias("pairs"))
    a = page_pairs.join(per, "bundle_id").join(n, "bundle_id", "left")
    ok = (F.col("page_pairs") <= 8) & (F.col("images") <= 10) & (F.col("pairs") >= 10) & (F.col("images") / F.greatest("page_pairs", F.lit(1)) <= 3)
    return a.select("bundle_id", F.when(ok, F.col("pairs")).otherwise(0).alias("cross_page"))


def overall(findings: DataFrame, papers: DataFrame) -> DataFrame:
    """score, level and the dimensions that make it high, a row for each paper."""
    found = capped(findings).groupBy("bundle_id").agg(*(c.alias(k) for k, c in (_counts() | _signs(findings)).items()))
    a = papers.join(_weighed(_scored(found)), "bundle_id", "left").join(image_pages(findings), "bundle_id", "left")
    a = a.na.fill(0).na.fill(False)
    i, d, r = (F.col(f"{k}_score") for k in ("image", "data", "reference"))
    most = F.greatest(i, d, r)
    base = F.least(F.lit(100), F.bround(F.greatest(WEIGHTS["image"] * i + WEIGHTS["data"] * d + WEIGHTS["reference"] * r + LARGEST * most, 0.95 * d, 0.85 * i, 0.85 * r), 0).cast("int"))
    a = a.withColumn("score", F.least(F.lit(100), base + F.when((F.col("fraud") >= 4) & ((F.col("data_high") > 0) | (F.col("image_high") > 0)), 5).otherwise(0)))
    a = a.withColumn("score", F.when((most > 60) & (F.col("score") <= 60), 61).otherwise(F.col("score")))
    floor = (((F.col("n_cross") > 0) & (F.col("n_data") >= 5)) | (F.col("cross_page") >= 10) | (F.col("splices") >= 2)) & (F.col("score") < 56)
    a = a.withColumn("score", F.when(floor, 56).otherwise(F.col("score")))
    a = a.withColumn("score", F.when(F.col("burden") & (F.col("score") < 61), 61).otherwise(F.col("score")))
    references = F.when(F.col("total_references") > 0, F.col("total_references")).otherwise(F.col("reference_high") + F.col("reference_medium") + F.col("reference_low"))
    all_high = F.col("n_fabricated") + F.col("n_filtered")
    noise = F.when(all_high > 0, F.col("n_filtered") / all_high).otherwise(0.0)
    least = F.when(noise > 0.5, 10).when(noise > 0.3, 8).otherwise(5)
    ratio = F.when(references > 0, F.col("n_fabricated") / references).otherwise(0.0)
    broken = (F.col("n_fabricated") >= least) & (ratio > 0.08) & (ratio < 0.5)
    # fixed values: from where on each sign makes the level high
    full = F.col("n_full").between(4, 30)
    fraud = (F.col("fraud") >= 4) & (i > 0) & (i < 80)
    both = (F.col("score") >= 60) & (d >= 60)
    pictures = (i >= 40) & (d >= 10)
    is_high = (d > 60) | F.col("burden") | (F.col("cross_page") >= 10) | full | broken | fraud | both | pictures | (F.col("splices") >= 2)
    dims = {"data": (d > 60) | F.col("burden") | fraud | both, "image": (F.col("cross_page") >= 10) | full | pictures | (F.col("splices") >= 2), "reference": F.col("burden") | broken}
    named = F.concat_ws(",", *(F.when(is_high & c, F.lit(k)) for k, c in dims.items()))
    return a.select("bundle_id", "score", F.when(is_high, HIGH).otherwise(LOW).alias("level"), named.alias("high_dimensions"), *(F.col(f"{k}_score") for k in WEIGHTS))


def summary(findings: DataFrame) -> DataFrame:
    """Counts by kind and severity with subtotals."""
    return findings.rollup("test", "severity").agg(F.count("*").alias("n"))


def level_flips(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many bundles have each pair of old and new level."""
    return old.select("bundle_id", F.col("level").alias("old_level")).join(new.select("bundle_id", F.col("level").alias("new_level")), "bundle_id").groupBy("old_level", "new_level").agg(F.count("*").alias("n"))


def recall(labels: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Share of expected highs found for each source of labels; a missing prediction counts as missed."""
    j = labels.join(predicted, key, "left")
    return j.groupBy("label_source").agg(F.count("*").alias("n"), F.count_if("expected").alias("expected_high"), F.count_if(F.col("expected") & F.coalesce("found", F.lit(False))).alias("found_high"), F.avg((F.col("expected") == F.coalesce("found", F.lit(False))).cast("double")).alias("agreement"))


def constraints(labels: DataFrame, predicted: DataFrame, key: str, levels: DataFrame) -> DataFrame:
    """What a release of the rules has to meet, a row each: recall on retracted papers over 70 %, agreement with users'
    labels of 100 %, and 15 to 20 % high levels (``levels``: is_high) among all papers."""
    by = recall(labels, predicted, key)
    percent = lambda a, b: F.coalesce(100 * F.try_divide(a, b), F.lit(0.0))
    retracted = by.where("label_source = 'retracted'").agg(F.sum("found_high").alias("a"), F.sum("n").alias("b")).select(F.lit("retracted recall").alias("name"), percent(F.col("a"), F.col("b")).alias("percent"))
    users = by.where("label_source = 'user_labeled'").agg(F.sum(F.col("agreement") * F.col("n")).alias("a"), F.sum("n").alias("b")).select(F.lit("user agreement").alias("name"), percent(F.col("a"), F.col("b")).alias("percent"))
    high = levels.agg(F.count_if("is_high").alias("a"), F.count("*").alias("b")).select(F.lit("high rate").alias("name"), percent(F.col("a"), F.col("b")).alias("percent"))
    met = F.when(F.col("name") == "retracted recall", F.col("percent") > 70).when(F.col("name") == "user agreement", F.col("percent") == 100).otherwise(F.col("percent").between(15, 20))
    return retracted.unionByName(users).unionByName(high).withColumn("met", met)
