"""Records of papers: reading lists, filling and updating columns, matching names, counting outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import numbered
from .upkeep import filled

_PAPER = "title string, doi string, year string, venue string"


def papers_of_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, title, doi, year, venue) of the papers in JSON lists; a venue is a text or an object with a name.

    A text that is no list, or no JSON, gives no row.
    """
    parsed = rows.select(key, F.posexplode(F.from_json(text, f"array<struct<{_PAPER.replace(' ', ':')}>>".replace(",:", ","))).alias("ord", "p"))
    venue = F.coalesce(F.get_json_object("p.venue", "$.name"), F.when(~F.trim("p.venue").startswith("{"), F.col("p.venue")))
    return parsed.select(key, "ord", F.trim("p.title").alias("title"), F.lower(F.trim("p.doi")).alias("doi"), F.col("p.year").try_cast("int").alias("year"), F.trim(venue).alias("venue"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(bundle_id, doi, title, page, error) of the manifest.json files below ``root``, each read as one document."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").text(root, wholetext=True)
    bundle = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    m = files.select(bundle.alias("bundle_id"), F.from_json("value", "doi string, title string, html string").alias("m"))
    return m.select("bundle_id", F.lower(F.trim("m.doi")).alias("doi"), F.trim("m.title").alias("title"), F.col("m.html").alias("page"), F.when(F.col("m").isNull(), F.lit("no JSON")).alias("error"))


def reports(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """(doi, finding fields) of stored JSON reports: one row for each of their ``findings``."""
    r = spark.read.schema(f"doi string, findings array<struct<{schema}>>").option("multiLine", "true").option("recursiveFileLookup", "true").json(root)
    return r.select(F.lower(F.trim("doi")).alias("doi"), F.inline("findings"))


def columns_by_header(cells: DataFrame, sheet: list[str], wanted: dict[str, list[str]]) -> DataFrame:
    """Rows of a workbook (cells: sheet, row_idx, col_idx, raw) with the columns in ``wanted``: for each, the names
    that its header may have, the first that is there wins. The header is the sheet's first row; case and blanks
    don't matter. ``row_idx`` stays."""
    first = F.min("row_idx").over(Window.partitionBy(*sheet))
    c = cells.where("raw is not null").withColumn("head", first)
    heads = c.where("row_idx = head").select(*sheet, "col_idx", F.lower(F.trim("raw")).alias("name"))
    tries = [(k, n.lower(), turn) for k, names in wanted.items() for turn, n in enumerate(names)]
    known = cells.sparkSession.createDataFrame(tries, "field string, name string, turn int")
    places = heads.join(F.broadcast(known), "name").groupBy(*sheet, "field").agg(F.min_by("col_idx", F.struct("turn", "col_idx")).alias("col_idx"))
    body = c.where("row_idx > head").join(places, [*sheet, "col_idx"])
    return body.groupBy(*sheet, "row_idx").agg(*(F.max(F.when(F.col("field") == k, F.trim("raw"))).alias(k) for k in wanted))


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row for each filled key, compared without case."""
    keyed = rows.withColumn("_key", F.lower(filled(F.col(key)))).where(F.col("_key").isNotNull())
    return keyed.groupBy("_key").agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def fill_blanks(table: DataFrame, better: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``table`` with blank values taken from ``better``; what is filled stays. ``key`` tells rows of ``better`` apart."""
    right = better.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    j = table.join(right, table[key] == right["_key"], "left")
    return j.select(*(F.coalesce(filled(F.col(c)), F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def differences(table: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, old, new) of every value that ``other`` has filled and different, null counting as different."""
    right = other.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    j = table.join(right, table[key] == right["_key"])
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("old"), F.col(f"_{c}").cast("string").alias("new")) for c in columns))
    return j.select(key, F.inline(cells)).where(filled(F.col("new")).isNotNull() & ~F.col("old").eqNullSafe(F.col("new")))


def update_only(table: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the columns that ``updates`` has, where it has the key (null keys too), and ``matched``; no row
    is added. Columns that ``updates`` lacks stay."""
    right = updates.select(*(F.col(k).alias(f"_{k}") for k in key), *(F.col(c).alias(f"_{c}") for c in updates.columns if c not in key), F.lit(True).alias("_hit"))
    same = None
    for k in key:
        on = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = on if same is None else same & on
    j = table.join(right, same, "left")
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in updates.columns and c not in key else F.col(c)
    return j.select(*map(pick, table.columns), F.coalesce("_hit", F.lit(False)).alias("matched"))


def suffix_matches(folders: DataFrame, targets: DataFrame, folder: str, target: str) -> DataFrame:
    """(folder, target) by name, or else by the name without what stands before its first underscore; null target
    where there is none. The smallest target wins."""
    names = F.array_distinct(F.array(F.col(folder), F.regexp_replace(folder, "^[^_]*_", "")))
    tries = folders.select(folder, F.posexplode(names).alias("turn", "name"))
    t = targets.select(F.col(target).alias("target"), F.explode(F.array_distinct(F.array(F.col(target), F.regexp_replace(target, "^[^_]*_", "")))).alias("name"))
    best = tries.join(t, "name").groupBy(folder).agg(F.min_by("target", F.struct("turn", "target")).alias(target))
    return folders.join(best, folder, "left")


def below(paths: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """Paths that lie in one of the folders ``root``: each path's own parents are its keys, so nothing is compared by prefix."""
    parts = F.split(path, "/")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = paths.select(path, F.explode(F.when(F.size(parts) > 1, parents)).alias("_up")).join(roots.select(F.rtrim(F.col(root), F.lit("/")).alias("_up")), "_up", "left_semi").select(path).distinct()
    return paths.join(hit, path, "left_semi")


def not_paired(pairs: DataFrame, done: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that ``done`` doesn't hold, whichever of the two stands first."""
    ends = lambda df: df.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"))
    return pairs.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b)).join(ends(done), ["_a", "_b"], "left_anti").drop("_a", "_b")


def address_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, names, address) of address lists that put the authors of each address in brackets before it."""
    pattern = F.lit(r"\[([^\]]*)\]\s*([^\[]*)")
    both = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("n"), F.regexp_extract_all(text, pattern, 2).alias("a"))
    names = F.filter(F.transform(F.split("g.n", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(key, F.posexplode(both).alias("ord", "g")).select(key, "ord", names.alias("names"), F.rtrim(F.trim("g.a"), F.lit("; ")).alias("address"))


def union_of_keys(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each key of either side, compared without case, with the left's filled values before the right's.
    Each side has a key once."""
    side = lambda df, x: df.select(F.lower(F.trim(key)).alias(key), *(F.col(c).alias(f"{x}_{c}") for c in columns), F.lit(True).alias(f"in_{x}"))
    j = side(left, "l").join(side(right, "r"), key, "full_outer")
    pick = lambda c: F.coalesce(filled(F.col(f"l_{c}")), filled(F.col(f"r_{c}"))).alias(c)
    return j.select(key, *map(pick, columns), F.coalesce("in_l", F.lit(False)).alias("in_left"), F.coalesce("in_r", F.lit(False)).alias("in_right"))


def paper_records(detected: DataFrame, reviews: DataFrame, failures: DataFrame, key: list[str]) -> DataFrame:
    """A record for each detected paper with its review and its failure, by a key that may hold nulls: success where
    nothing failed and a review is there, else failed or unreviewed."""
    out = detected
    for name, df in (("review", reviews), ("failure", failures)):
        right = df.select(*(F.col(k).alias(f"_{name}_{k}") for k in key), *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in key), F.lit(True).alias(f"has_{name}"))
        same = None
        for k in key:
            on = out[k].eqNullSafe(right[f"_{name}_{k}"])
            same = on if same is None else same & on
        out = out.join(right, same, "left").drop(*(f"_{name}_{k}" for k in key)).withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return out.withColumn("outcome", F.when(F.col("has_failure"), "failed").when(F.col("has_review"), "reviewed").otherwise("unreviewed"))


def frequencies(rows: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """(column, n, rank) of each value, null included, most frequent first and ties by value; the first ``most`` of
    them where it is given."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.col(column).asc_nulls_last())))  # a row for each value
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def batch_summary(results: DataFrame, group: list[str], status: str, seconds: str) -> DataFrame:
    """What came of each batch: how many, done, failed, other, and the time of all and of each done one."""
    done, failed = F.col(status) == "done", F.col(status) == "failed"
    return results.groupBy(*group).agg(
        F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(failed).alias("failed"), (F.count("*") - F.count_if(done) - F.count_if(failed)).alias("other"),
        F.sum(seconds).alias("seconds"), F.avg(F.when(done, F.col(seconds))).alias("seconds_each"),
    )


def url_references(tables: dict[str, DataFrame], urls: DataFrame, url: str) -> DataFrame:
    """(url, table, column, n): where each URL still stands, in the columns of ``tables`` whose names say that they
    hold URLs or paths."""
    found = None
    for name, df in tables.items():
        for c, kind in df.dtypes:
            if kind == "string" and any(w in c.lower() for w in ("url", "path")):
                here = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(url)).agg(F.count("*").alias("n")).select(url, F.lit(name).alias("table"), F.lit(c).alias("column"), "n")
                found = here if found is None else found.unionByName(here)
    if found is None:
        found = urls.select(url, F.lit("").alias("table"), F.lit("").alias("column"), F.lit(0).cast("long").alias("n")).limit(0)
    return found.join(urls.select(url).distinct(), url, "left_semi")


def unique_names(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``unique_name``: names that repeat, without case, get _2, _3, ... in order of ``key``."""
    turn = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(key))
    return rows.withColumn("unique_name", F.when(turn == 1, F.col(name)).otherwise(F.concat_ws("_", F.col(name), turn.cast("string"))))


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(ord, line): a table of ``rows`` in Markdown, head first; numbers of lines come from a sort in ranges."""
    cell = lambda c: F.coalesce(F.replace(F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|")), F.lit(""))
    body = rows.select(*order, F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))
    turn = F.row_number().over(Window.orderBy(*order, "line")) + 1  # a report's rows
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "-|" * len(columns))], "ord int, line string")
    return head.unionByName(body.select(turn.cast("int").alias("ord"), "line"))


def level_rows(results: DataFrame, level: str) -> DataFrame:
    return results.groupBy(level).agg(F.count("*").alias("n"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def columns_by_place(cells: DataFrame, sheet: list[str], places: dict[str, int], first_row: int = 1) -> DataFrame:
    """Rows of a workbook from ``first_row`` on with the columns that stand at fixed places."""
    body = cells.where(F.col("row_idx") >= first_row).where(F.col("col_idx").isin(*places.values()))
    return body.groupBy(*sheet, "row_idx").agg(*(F.max(F.when(F.col("col_idx") == n, F.trim("raw"))).alias(k) for k, n in places.items()))


def found_works(refs: DataFrame, works: DataFrame, ref: str, work: str) -> DataFrame:
    """(ref, work, how) of references (ref, doi, text): the work with the same DOI, else the one that shares the rarest
    words. References that match neither way have no row."""
    from .references import best_works

    doi = lambda c: F.lower(filled(F.col(c)))
    by_doi = refs.select(ref, doi("doi").alias("_doi")).join(works.select(F.col(work), doi("doi").alias("_doi")), "_doi").groupBy(ref).agg(F.min(work).alias(work)).withColumn("how", F.lit("doi"))
    rest = refs.select(ref, "text").join(by_doi, ref, "left_anti")
    return by_doi.select(ref, work, "how").unionByName(best_works(rest, works, ref, work).select(ref, work, F.lit("text").alias("how")))
