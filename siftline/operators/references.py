"""Reference lists: parsing, title matching and the verification table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions.answers import _with
from ..session import importable

HEADING = r"(?im)^\s*(?:references|bibliography|literature cited)\s*:?\s*$"


def reference_section(text: Column, most: int = 20_000) -> Column:
    """The part after the last heading, at most ``most`` characters, as the screen's rule has it; null without a heading."""
    parts = F.split(text, HEADING)
    return F.when(F.size(parts) > 1, F.left(F.element_at(parts, -1), F.lit(most)))


def references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, text, doi) of numbered references. Numbering that falls back by three or more ends the list."""
    pattern = r"(?ms)^\s*\[?(\d{1,3})\]?[.)\s]\s*(.+?)(?=^\s*\[?\d{1,3}\]?[.)\s]|\z)"
    section = docs.select(key, reference_section(F.col(text)).alias("section")).where("section is not null")
    both = section.select(key, F.posexplode(F.arrays_zip(F.regexp_extract_all("section", F.lit(pattern), 1).alias("number"), F.regexp_extract_all("section", F.lit(pattern), 2).alias("body"))).alias("ord", "r"))
    rows = both.select(key, "ord", F.col("r.number").try_cast("int").alias("number"), F.trim(F.regexp_replace("r.body", r"\s+", " ")).alias("text"))
    before = F.max("number").over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("falls", F.col("number") <= before - 3)
    stop = F.min(F.when(F.col("falls"), F.col("ord"))).over(Window.partitionBy(key))
    return rows.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("ord") < F.col("stop"))).select(key, "number", "text", S.doi(F.col("text")).alias("doi"))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"<[^>]+>", " "), r"[^a-z0-9]+", " "))


def title_coverage(title: Column, text: Column) -> Column:
    """1 if the normalised text holds the title, else the share of the title's longer words, each as often as it stands
    there, that the text has; 0 for a title without letters and digits."""

    def share(p: Column) -> Column:
        long_words = F.filter(F.split(p["t"], " "), lambda w: F.length(w) > 2)
        found = F.size(F.filter(long_words, lambda w: F.array_contains(p["words"], w)))
        return F.when(p["t"] == "", 0.0).when(F.contains(p["x"], p["t"]), 1.0).otherwise(F.coalesce(F.try_divide(found, F.size(long_words)), F.lit(0.0)))

    # a text is normalised and split once, not for each word of the title
    split = lambda p: F.struct(p["t"].alias("t"), p["x"].alias("x"), F.split(p["x"], " ").alias("words"))
    return _with(_with(F.struct(normal(title).alias("t"), normal(text).alias("x")), split), share)


def best_works(refs: DataFrame, works: DataFrame, ref: str, work: str, top: int = 1) -> DataFrame:
    """The works that share the rarest words with a reference: an equi-join on words, never on all pairs.

    Words that more than a tenth of the works bear tell nothing and are left out, as the search's own rule; else most
    works would share some word with each reference.
    """
    words = lambda df, key, text: df.select(key, F.explode(F.array_distinct(F.filter(F.split(normal(F.col(text)), " "), lambda w: F.length(w) > 3))).alias("word"))
    w = words(works, work, "title")
    n = works.count()
    weight = w.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") <= max(1, n // 10)).select("word", F.log(F.lit(n + 1) / F.col("df")).alias("idf"))
    rare = w.join(weight, "word")
    size = rare.agg(F.sum(F.length("word") + 48)).first()[0] or 0
    rare = F.broadcast(rare) if size <= 8 << 20 else rare  # else words shuffle; either way only rare ones go on
    hits = words(refs, ref, "text").join(rare, "word").groupBy(ref, work).agg(F.sum("idf").alias("score"))
    return hits.groupBy(ref).agg(F.max_by(work, F.struct("score", F.negative(F.col(work)))).alias(work), F.max("score").alias("score"))


def verify() -> tuple[Column, Column]:
    """(issue, severity) from: doi, doi_valid, transient, title_similarity, match_score, matched, garbled, titleless,
    truncated, unindexed. Both null where nothing is wrong."""
    c = F.col
    has_doi, near = c("doi").isNotNull(), c("title_similarity") >= 0.85
    weak = c("match_score") < 50
    issue = (
        F.when(has_doi & c("doi_valid") & (near | c("titleless")), None)
        .when(has_doi & c("doi_valid"), "title_mismatch")
        .when(has_doi & c("truncated"), "doi_truncated")
        .when(has_doi & (c("transient") | c("unindexed")), "doi_unverified")
        .when(has_doi, "doi_not_found")
        .when(~c("matched"), "not_found")
        .when(weak, "low_match_score")
    )
    severity = (
        F.when(issue.isin("doi_truncated", "doi_unverified"), "low")
        .when(issue == "doi_not_found", "high")
        .when(issue == "not_found", "medium")
        .when(issue.isNotNull() & c("garbled"), "low")
        .when((issue == "title_mismatch") & (c("title_similarity") < 0.5), "high")
        .when((issue == "low_match_score") & c("titleless"), "medium")
        .when((issue == "low_match_score") & (c("title_similarity") < 0.5) & (c("match_score") < 45), "high")
        .when(issue.isNotNull(), "medium")
    )
    return issue, severity


def crawled_issues(refs: DataFrame, key: list[str], order: str, most_failures: int = 10) -> DataFrame:
    """Issues of references from crawled pages, with the severities of that path, as columns issue, severity and status.

    ``refs`` has number, text, doi, doi_valid, lookup_failed, title_similarity, matched and match_score. References
    are looked up in ``order``; the look-ups of a key stop at the tenth failed one in a row among those with a DOI (what
    has none, or an answer between, doesn't count as a failure, and only an answer to a DOI ends a row of them). From that
    one on nothing is verified: no issues, status ``unverified``. References with neither DOI nor text have status
    ``skipped``, the others ``checked``.
    """
    c = F.col
    has_doi, has_text = F.coalesce(c("doi"), F.lit("")) != "", F.coalesce(c("text"), F.lit("")) != ""
    upto = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    failed = has_doi & F.coalesce(c("lookup_failed"), F.lit(False))
    d = refs.withColumn("_failed", failed).withColumn("_answers", F.count_if(has_doi & ~c("_failed")).over(upto))
    streak = F.count_if("_failed").over(Window.partitionBy(*key, "_answers").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_streak", streak).withColumn("_over", F.coalesce(F.bool_or(c("_failed") & (c("_streak") >= most_failures)).over(upto), F.lit(False)))
    status = F.when(c("_over"), "unverified").when(has_doi | has_text, "checked").otherwise("skipped")
    valid = F.coalesce(c("doi_valid"), F.lit(False)) & ~c("_failed")
    issue = (
        F.when(c("_over"), None)
        .when(has_doi & valid, F.when(has_text & (c("title_similarity") < 0.85), "title_mismatch"))
        .when(has_doi, "doi_not_found")
        .when(has_text & ~F.coalesce(c("matched"), F.lit(False)), "not_found")
        .when(has_text & (F.coalesce(c("match_score"), F.lit(0.0)) < 50), "low_match_score")
    )
    severity = F.when(issue == "doi_not_found", "high").when(issue.isin("title_mismatch", "not_found"), "medium").when(issue == "low_match_score", "low")
    return d.withColumn("issue", issue).withColumn("severity", severity).withColumn("status", status).drop("_failed", "_answers", "_streak", "_over")


#: How a line begins a citation of an author-first list, and what a whole one has: a DOI, or a year in
#: brackets and pages at the end.
STARTS = (r"^[A-Z][A-Za-z'`-]+,?\s+[A-Z]", r"^(?:van|von|de|del|della|di|da|le|la)\s+[A-Z]")
WHOLE_DOI = r"(?i)(?:doi[:\s]|https?://doi\.org/)\s*10\.\d{4,}/"
WHOLE_YEAR, WHOLE_PAGES = r"\(\d{4}\)", r"\d+\s*[-–]\s*\d+\.?\s*$"


class CitationGroups:
    """The lines of one author-first list, in order, as citations (key, number, lines, text). It holds the lines of one
    citation at a time. ``of_batches`` goes over batches of lines (key, place, line) that are sorted by key and place.

    A line that begins like a citation ends the one before it, if that looks whole. Blank lines count for nothing.
    """

    _starts = re.compile("|".join(STARTS), re.ASCII)
    _doi, _year, _pages = (re.compile(x, re.ASCII) for x in (WHOLE_DOI, WHOLE_YEAR, WHOLE_PAGES))

    def __init__(self):
        self.key, self.number, self.held, self.has_doi, self.has_year = None, 0, [], False, False

    def add(self, key, line: str | None) -> Iterator[tuple]:
        self.key, line = key, (line or "").strip()
        if not line:
            return
        if self.held and (self.has_doi or self.has_year) and self._starts.match(line) and self.whole():
            yield self.citation()
        self.held.append(line)
        if not self.has_doi:
            near = " ".join(self.held[-2:])  # a DOI may be cut at a line's end
            self.has_doi = "10." in near and bool(self._doi.search(near))
        self.has_year = self.has_year or "(" in line and bool(self._year.search(line))

    def whole(self) -> bool:
        return self.has_doi or self.has_year and bool(self._pages.search(" ".join(self.held[-3:])))

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield self.citation()

    def citation(self) -> tuple:
        self.number += 1
        out = self.key, self.number, len(self.held), " ".join(self.held)
        self.held, self.has_doi, self.has_year = [], False, False
        return out


    @classmethod
    def of_batches(cls, schema) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group = None
            for batch in batches:
                out = []
                for key, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    if group is None or group.key != key:
                        out += group.end() if group else ()
                        group = cls()
                    out += group.add(key, line)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            if group and (out := list(group.end())):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        return run


def citations(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Citations of the lines (key, place, line) of each key in order of place; see CitationGroups. Lines go to Python in
    batches, keys one after the other, in several tasks for each core."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StringType, StructType

    key, place, _ = lines.columns
    schema = StructType().add(key, lines.schema[0].dataType).add("number", IntegerType()).add("lines", IntegerType()).add("text", StringType())
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    importable(spark)
    return lines.repartition(tasks, key).sortWithinPartitions(key, place).mapInArrow(CitationGroups.of_batches(to_arrow_schema(schema)), schema)


def grouped_lines(lines: Column) -> Column:
    """Lines of an author-first list as citations: a line opens a new one if it looks like a start and what is
    held looks complete. The fold carries (done, held) over the ordered lines."""
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("held"))

    def step(a: Column, line: Column) -> Column:
        starts = line.rlike("|".join(STARTS))
        complete = a["held"].rlike(WHOLE_DOI) | (a["held"].rlike(WHOLE_YEAR) & a["held"].rlike(WHOLE_PAGES))
        close = starts & complete
        return F.struct(F.when(close, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]).alias("done"), F.when(close | (a["held"] == ""), line).otherwise(F.concat_ws(" ", a["held"], line)).alias("held"))

    return F.aggregate(lines, empty, step, lambda a: F.filter(F.concat(a["done"], F.array(a["held"])), lambda x: x != ""))
