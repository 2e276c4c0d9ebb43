"""Document bundles: listing files, choosing the main file, leaving out copies and crawler records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Files that a crawler writes beside the data.
RECORD_NAMES = ("resources.csv", "figures.csv", "manifest.csv", "resources.tsv")
#: What names of the article's own file say, and those of other files.
ARTICLE_WORDS = ("manuscript", "article", "paper", "main", "fulltext", "full_text", "maintext", "main_text", "ms", "论文", "正文")
OTHER_WORDS = (
    "peer_review", "peer-review", "peerreview", "reviewer", "review", "response", "rebuttal", "reply", "cover_letter", "coverletter",
    "supplement", "supplementary", "supporting", "appendix", "附录", "补充", "审稿", "回复",
)
DATA_ENDS = ("xlsx", "xls", "csv", "docx", "fcs", "sav", "pdb")


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """bundle_id, path, name, ext, length of every file below ``root``; a bundle is a folder of the first level."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split(F.regexp_replace("path", r"^.*?" + root.rstrip("/").rpartition("/")[2].replace(".", r"\.") + "/", ""), "/")
    out = df.select(F.get(parts, F.lit(0)).alias("bundle_id"), "path", F.element_at(parts, -1).alias("name"), "length", *(["content"] if content else []))
    return out.withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))


def bundles(listing: DataFrame) -> DataFrame:
    """Folders that hold an article: a manifest with a page, or a PDF."""
    a = listing.groupBy("bundle_id").agg(F.bool_or(F.lower("name") == "manifest.json").alias("has_manifest"), F.bool_or(F.col("ext").isin("html", "htm")).alias("has_html"), F.bool_or(F.col("ext") == "pdf").alias("has_pdf"), F.bool_or(is_data(F.col("name"), F.col("ext"))).alias("has_data"))
    return a.where((F.col("has_manifest") & F.col("has_html")) | F.col("has_pdf")).withColumn("route", F.when(F.col("has_manifest") & F.col("has_html"), "crawl").otherwise("pdf"))


def is_data(name: Column, ext: Column) -> Column:
    return ext.isin(*DATA_ENDS) & ~F.lower(name).isin(*RECORD_NAMES)


def main_file(listing: DataFrame) -> DataFrame:
    """The likeliest main PDF of each bundle: by what its name says, then size, then name."""
    stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    plain, folder = F.regexp_replace(stem, "[^a-z0-9]+", ""), F.regexp_replace(F.lower("bundle_id"), "[^a-z0-9]+", "")
    partly = (folder != "") & (F.contains(plain, folder) | F.contains(folder, plain))
    score = (
        F.when(plain == folder, 80).when(partly, 35).otherwise(0)
        + F.when(stem.rlike("|".join(ARTICLE_WORDS)), 50).otherwise(0)
        - F.when(stem.rlike("|".join(OTHER_WORDS)), 120).otherwise(0)
        + F.when(F.col("length").between(200_000, 80_000_000), 2).otherwise(0)
    )
    best = Window.partitionBy("bundle_id").orderBy(F.desc("score"), F.desc("length"), F.desc(F.lower("name")))
    return listing.where("ext = 'pdf'").withColumn("score", score).withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def ready(listing: DataFrame, names: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """Bundles (bundle_id) with a PDF and source data, of ``names`` and not of ``blocked`` where they are given."""
    a = listing.groupBy("bundle_id").agg(F.bool_or((F.col("ext") == "pdf") & (F.col("length") > 0)).alias("pdf"), F.bool_or(is_data(F.col("name"), F.col("ext"))).alias("data"))
    out = a.where("pdf and data").select("bundle_id")
    out = out if names is None else out.join(names.select("bundle_id"), "bundle_id", "left_semi")
    return out if blocked is None else out.join(blocked.select("bundle_id"), "bundle_id", "left_anti")


def crawled(listing: DataFrame) -> DataFrame:
    """Data files and supplement PDFs of crawled bundles, by the folders they lie in; reporting forms are left out."""
    inside = F.lower(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    kind = F.when(inside.rlike("source_?data|supp") & is_data(F.col("name"), F.col("ext")), "data").when(inside.rlike("supp") & (F.col("ext") == "pdf") & ~F.contains(F.lower("name"), F.lit("reporting")), "supplement")
    return listing.withColumn("kind", kind).where("kind is not null")


def without_standalone_figures(images: DataFrame) -> DataFrame:
    """Images (bundle_id, path, from_pdf) without those in a folder of figures, where the bundle has any from a PDF."""
    has = images.where("from_pdf").select("bundle_id").distinct().withColumn("_has", F.lit(True))
    j = images.join(has, "bundle_id", "left")
    return j.where(~(F.coalesce("_has", F.lit(False)) & ~F.col("from_pdf") & F.contains("path", F.lit("/figures/")))).drop("_has")


def distinct_files(listing: DataFrame) -> DataFrame:
    """Of files equal in size and content in a bundle the first by path. Needs ``content``."""
    w = Window.partitionBy("bundle_id", "length", "sha").orderBy("path")
    return listing.withColumn("sha", F.sha2("content", 256)).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
