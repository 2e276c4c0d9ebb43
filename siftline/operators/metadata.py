"""Metadata of an article: identifiers by precedence, reading order, title lines, authors and their institutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from .upkeep import filled


def doi_by_precedence(override: Column, found: Column, noted: Column, folder: Column) -> Column:
    """A given DOI, else the one in the file, else a noted one, else the folder's name read as one."""
    name = F.replace(F.regexp_replace(folder, r"^[^_.]*_(?=10\.)", ""), F.lit("__"), F.lit("/"))
    return F.coalesce(filled(override), filled(found), filled(noted), F.when(name.rlike(r"^10\.\d{4,}/"), name))


def reading_order(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Numbers text blocks (x0, y0, x1, y1) as they are read: by column where a page has two, else down the page.

    A page has two columns when most blocks end before its middle or begin after it, on both sides.
    """
    w = Window.partitionBy(*page)
    middle = (F.min("x0").over(w) + F.max("x1").over(w)) / 2
    b = blocks.withColumn("_left", (F.col("x1") <= middle * 1.05).cast("int")).withColumn("_right", (F.col("x0") >= middle * 0.95).cast("int"))
    n, left, right = F.count("*").over(w), F.sum("_left").over(w), F.sum("_right").over(w)
    b = b.withColumn("columns", F.when((left > 0) & (right > 0) & (left + right >= 0.7 * n), 2).otherwise(1))
    b = b.withColumn("column", F.when((F.col("columns") == 2) & (F.col("_right") == 1), 1).otherwise(0))
    order = Window.partitionBy(*page).orderBy("column", "y0", "x0")
    return b.withColumn("ord", F.row_number().over(order)).drop("_left", "_right")


def title_lines(lines: DataFrame, key: str, most: int = 300) -> DataFrame:
    """The first unbroken run of lines set at nine tenths or more of the largest size, as one title of ``most`` characters
    at most, which is the screen's own rule."""
    w = Window.partitionBy(key)
    big = (F.col("size") >= 0.9 * F.max("size").over(w)) & ~F.lower("text").rlike(r"©|^doi|^vol|issn|^issue")
    run = lines.withColumn("_big", big).withColumn("_island", F.col("ord") - F.row_number().over(Window.partitionBy(key, "_big").orderBy("ord")))
    first = run.where("_big").withColumn("_first", F.min_by("_island", "ord").over(w)).where("_island = _first")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    return first.groupBy(key).agg(F.left(F.trim(F.regexp_replace(joined, r"\s+", " ")), F.lit(most)).alias("title"))


def is_bad_title(title: Column) -> Column:
    """Too short, a file name, an identifier, or all signs."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return (F.length(t) < 10) | t.rlike(r"(?i)\.(pdf|docx?|indd|tex)$|^doi|^10\.\d{4}|^microsoft word|^untitled") | ~t.rlike("[A-Za-z]{3}")


def authors_at(authors: DataFrame, institutions: DataFrame, key: str, pattern: str) -> DataFrame:
    """Names of authors whose superscripts point to an institution that matches; the first author where none does.

    ``authors``: key, ord, author (name with its numbers); ``institutions``: key, idx, institution.
    """
    marks = F.transform(F.regexp_extract_all("author", F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    name = F.trim(F.regexp_replace("author", r"[\d*†‡§,]+\s*$|\d+", ""))
    a = authors.select(key, "ord", name.alias("name"), marks.alias("marks"))
    fit = institutions.where(F.lower("institution").rlike(pattern)).groupBy(key).agg(F.collect_set("idx").alias("idx"))
    j = a.join(fit, key, "left").withColumn("hit", F.coalesce(F.arrays_overlap("marks", "idx"), F.lit(False)))
    out = j.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("ord", "name")))).alias("hits"), F.min_by("name", "ord").alias("first"), F.max(F.col("idx").isNotNull()).alias("any"))
    names = F.transform("hits", lambda x: x["name"])
    return out.select(key, F.when(F.size("hits") > 0, F.array_join(names, "; ")).when(F.col("any"), F.col("first")).alias("names"))


def author_place(names: Column, pattern: str) -> Column:
    """first, last, second last or inner: where a name that matches stands in the list; null if nowhere."""
    is_it = lambda k: F.coalesce(F.lower(F.element_at(names, k)).rlike(pattern), F.lit(False))
    n = F.size(names)
    return F.when(n == 0, None).when(is_it(-1), "last").when(is_it(1), "first").when((n > 1) & F.lower(F.try_element_at(names, F.lit(-2))).rlike(pattern), "second last").when(F.exists(names, lambda x: F.lower(x).rlike(pattern)), "inner")


def doi_year(doi: Column) -> Column:
    """A year between 1990 and 2035 written in a DOI."""
    year = F.regexp_extract(doi, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1).try_cast("int")
    return F.when(year.between(1990, 2035), year)


def upsert_key(doi: Column, title: Column) -> Column:
    """The key of a merge: the DOI, or the title where there is none."""
    return F.coalesce(F.lower(filled(doi)), F.concat(F.lit("t:"), S.key(title)))


def archive_kind(names: DataFrame, archive: str, path: str) -> DataFrame:
    """single or batch, and what is wrong, for each archive from its list of paths."""
    parts = F.split(path, "/")
    top = F.when(F.size(parts) > 1, parts[0])
    n = names.withColumn("_top", top).withColumn("_ext", F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
    a = n.groupBy(archive).agg(
        F.count_distinct("_top").alias("folders"),
        F.bool_or(F.col("_ext") == "pdf").alias("has_pdf"),
        F.bool_or(F.col(path).startswith("/") | F.array_contains(parts, "..")).alias("unsafe"),
        F.array_sort(F.collect_set(F.when(F.col("_ext").isin("exe", "bat", "sh", "js", "dll"), F.col("_ext")))).alias("forbidden"),
    )
    wrong = F.array_compact(F.array(F.when(F.col("unsafe"), F.lit("unsafe path")), F.when(F.size("forbidden") > 0, F.concat(F.lit("forbidden: "), F.array_join("forbidden", ", "))), F.when(~F.col("has_pdf"), F.lit("no PDF"))))
    return a.select(archive, F.when(F.col("folders") > 1, "batch").otherwise("single").alias("kind"), wrong.alias("errors"))
