"""Relational upkeep of result tables: joins, merges, plans and monitors. Nothing here writes or deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_done(papers: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return papers.join(done.select(key), key, "left_anti")


def allowed(papers: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return papers.join(names.select(key), key, "left_semi")


def filled(column: Column) -> Column:
    """Null where the text is null or blank."""
    return F.when(F.trim(column) != "", column)


def override(papers: DataFrame, better: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-blank values of ``better`` win."""
    right = better.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = papers.join(right, key, "left")
    return joined.select(*(F.coalesce(filled(F.col(f"_{c}")), F.col(c)).alias(c) if c in columns else F.col(c) for c in papers.columns))


def upsert(table: DataFrame, updates: DataFrame, key: list[str], protected: DataFrame | None = None, reset: list[str] | None = None) -> DataFrame:
    """The table after a merge: updates win on equal keys, null keys included, unless protected; updated rows have
    the columns in ``reset`` emptied."""
    if protected is not None:
        updates = updates.join(protected, key, "left_anti")
    values = [c for c in table.columns if c not in key]
    old, new = table.alias("o"), updates.withColumn("_new", F.lit(True)).alias("n")
    same = None
    for k in key:
        on = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        same = on if same is None else same & on
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(new, same, "full_outer")
    pick = lambda c: F.when(F.col("n._new"), F.col(f"n.{c}") if c in updates.columns else F.when(F.lit(c not in (reset or [])), F.col(f"o.{c}"))).otherwise(F.col(f"o.{c}"))
    return joined.select(*(F.when(F.col("n._new"), F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in key), *(pick(c).alias(c) for c in values), F.when(F.col("o._old") & F.col("n._new"), "updated").when(F.col("n._new"), "inserted").otherwise("kept").alias("action"))


def longest_prefix(keys: DataFrame, prefixes: DataFrame, key: str, prefix: str, value: str) -> DataFrame:
    """The value of the longest prefix that a key begins with, by an equi-join on the key's own beginnings, as long as
    prefixes are."""
    lengths = sorted(r[0] for r in prefixes.select(F.length(prefix)).distinct().collect() if r[0] is not None)
    begins = keys.select("*", F.explode(F.array_distinct(F.array(*(F.left(F.col(key), F.lit(n)) for n in lengths or [0])))).alias("_begin"))
    hits = begins.join(prefixes.select(F.col(prefix).alias("_begin"), value), "_begin")
    best = hits.groupBy(*keys.columns).agg(F.max_by(value, F.length("_begin")).alias(value)).select(*(F.col(c).alias(f"_{c}") for c in keys.columns), value)
    same = None
    for c in keys.columns:
        on = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = on if same is None else same & on
    return keys.join(best, same, "left").select(*keys.columns, value)


def best_candidate(wanted: DataFrame, there: DataFrame, key: str, name: str, candidates: list[Column]) -> DataFrame:
    """For each key the first of its candidate names that exists."""
    tries = wanted.select(key, F.posexplode(F.array(*candidates)).alias("priority", name))
    return tries.join(there.select(name), name).groupBy(key).agg(F.min_by(name, "priority").alias(name), F.min("priority").alias("priority"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def batches(rows: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Groups of ``size`` in order of arrival; only full ones are launched."""
    w = Window.partitionBy(*group)
    numbered = rows.withColumn("batch", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / size))
    return numbered.groupBy(*group, "batch").agg(F.count("*").alias("n")).withColumn("launched", F.col("n") == size)


def failure_runs(rows: DataFrame, group: list[str], order: list[str], failed: Column, least: int) -> DataFrame:
    """Runs of ``least`` or more failures in a row."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = rows.withColumn("_bad", failed).withColumn("_run", F.sum((~F.col("_bad")).cast("int")).over(w))
    return marked.where("_bad").groupBy(*group, "_run").agg(F.count("*").alias("length"), F.min(order[0]).alias("first")).where(F.col("length") >= least).drop("_run")


def stale(claims: DataFrame, now: Column, seconds: int, attempts: int) -> DataFrame:
    """Claims that may be taken again: not done, not touched for a while, and not tried too often."""
    return claims.where((F.col("status") != "done") & (F.unix_timestamp(now) - F.unix_timestamp("claimed") > seconds) & (F.col("attempts") < attempts))


def rate(counts: DataFrame, group: list[str], at: str, total: str) -> DataFrame:
    """Items an hour between the first and the last count."""
    a = counts.groupBy(*group).agg(F.min_by(total, at).alias("first"), F.max_by(total, at).alias("last"), (F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))).alias("seconds"))
    return a.withColumn("per_hour", F.try_divide((F.col("last") - F.col("first")) * 3600.0, F.col("seconds")))


def remaining_time(counts: DataFrame, group: list[str], at: str, total: str, target: Column) -> DataFrame:
    """Of each feed of counts: how many since its first count, how many an hour, how many remain to ``target`` (a column of
    the group or a number) and the hours that takes at this speed; null without a target or any progress."""
    a = counts.groupBy(*group).agg(F.min_by(total, at).alias("first"), F.max_by(total, at).alias("last"), (F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))).alias("seconds"))
    since = F.greatest(F.lit(0), F.col("last") - F.col("first"))
    per_hour = since / F.greatest(F.lit(1), F.col("seconds")) * 3600.0
    left = F.when(target > 0, F.greatest(F.lit(0), target - F.col("last")))
    return a.select(*group, since.alias("since"), F.bround(per_hour, 2).alias("per_hour"), left.alias("remaining"), F.bround(F.when(per_hour > 0, left / per_hour), 2).alias("hours_left"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int, keep: Column | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ``order`` of those that ``keep`` holds for, with ``total``, the number of all of
    them. Only the rows of the page, and those before it, are sorted; the total is a count of its own."""
    kept = rows if keep is None else rows.where(keep)
    return kept.orderBy(*order).offset(offset).limit(limit).withColumn("total", F.lit(kept.count()).cast("long"))


def merge_plan(source: DataFrame, target: DataFrame, key: list[str], size: str) -> DataFrame:
    """What a merge of two file listings would do: copy, keep, skip equal sizes, or replace by the larger."""
    s = source.select(*key, F.col(size).alias("source_size"))
    t = target.select(*key, F.col(size).alias("target_size"))
    action = F.when(F.col("target_size").isNull(), "copy").when(F.col("source_size").isNull(), "keep").when(F.col("source_size") == F.col("target_size"), "skip").when(F.col("source_size") > F.col("target_size"), "replace").otherwise("keep")
    return s.join(t, key, "full_outer").withColumn("action", action)


def migration_plan(rows: DataFrame, url: str, old_prefix: str, new_prefix: str) -> DataFrame:
    """Where each URL would move, and why it can't."""
    relative = F.expr(f"substring({url}, {len(old_prefix) + 1})")
    blocked = F.array_compact(F.array(F.when(~F.col(url).startswith(old_prefix), F.lit("other prefix")), F.when(relative.contains(".."), F.lit("unsafe path")), F.when(F.length(relative) == 0, F.lit("no file"))))
    return rows.withColumn("blocked", blocked).withColumn("new_url", F.when(F.size("blocked") == 0, F.concat(F.lit(new_prefix), relative)))


def migration_manifest(plan: DataFrame, files: DataFrame) -> DataFrame:
    """A plan (kind, src, dst) with ``src_exists`` and ``dst_exists`` by a listing of files (path): what a migration writes
    down before it copies anything."""
    there = files.select("path").distinct()
    of = lambda c: there.select(F.col("path").alias(c), F.lit(True).alias(f"{c}_exists"))
    m = plan.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    return m.select(*plan.columns, *(F.coalesce(f"{c}_exists", F.lit(False)).alias(f"{c}_exists") for c in ("src", "dst")))


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Of each kind how many are planned, have their source, have neither, and are there already."""
    src, dst = F.col("src_exists"), F.col("dst_exists")
    return manifest.groupBy("kind").agg(F.count("*").alias("planned"), F.count_if(src).alias("src_exists"), F.count_if(~src & ~dst).alias("missing_src"), F.count_if(dst).alias("dst_exists"))


def cleanup_plan(manifest: DataFrame, files: DataFrame, references: DataFrame) -> DataFrame:
    """(src, size, deletable, reasons) of each migrated source: it may go only if it is there, none of its old URLs is
    referenced any more, and each of its copies is there with the same size and digest.

    ``manifest``: src, dst, old_url; ``files``: path, size, digest; ``references``: url, n. Reasons are in order of the
    alphabet; a copy that is missing or differs is named.
    """
    old = files.select(F.col("path").alias("src"), F.col("size").alias("src_size"), F.col("digest").alias("src_digest"))
    new = files.select(F.col("path").alias("dst"), F.col("size").alias("dst_size"), F.col("digest").alias("dst_digest"))
    used = references.where("n > 0").select(F.col("url").alias("old_url")).distinct().withColumn("used", F.lit(True))
    m = manifest.select("src", "dst", "old_url").distinct().join(old, "src", "left").join(new, "dst", "left").join(used, "old_url", "left")
    same = F.col("src_size").eqNullSafe(F.col("dst_size")) & F.col("src_digest").eqNullSafe(F.col("dst_digest"))
    why = F.array(
        F.when(F.col("src_size").isNull(), "source_missing"),
        F.when(F.col("used"), "old_url_still_referenced"),
        F.when(F.col("dst_size").isNull(), F.concat(F.lit("dest_missing:"), "dst")).when(F.col("src_size").isNotNull() & ~same, F.concat(F.lit("dest_differs:"), "dst")),
    )
    a = m.groupBy("src").agg(F.coalesce(F.max("src_size"), F.lit(0)).alias("size"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(why))))).alias("reasons"))
    return a.select("src", "size", (F.size("reasons") == 0).alias("deletable"), "reasons")


def fuzzy_names(files: DataFrame, papers: DataFrame, file: str, title: str, paper: str, prefix: int = 30, least: int = 12) -> DataFrame:
    """Files whose plain name begins with the start of a paper's plain title, or the other way round; the first
    ``prefix`` characters of both tell, as the screen's rule has it. The first
    ``least`` characters are the join key, so names meet only titles that begin alike; the lowest paper wins."""
    plain = lambda c: F.left(F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]+", ""), F.lit(prefix))
    f = files.select(file, plain(file).alias("_name")).where(F.length("_name") >= least).withColumn("_key", F.left("_name", F.lit(least)))
    p = papers.select(paper, plain(title).alias("_title")).where(F.length("_title") >= least).withColumn("_key", F.left("_title", F.lit(least)))
    hits = f.join(p, "_key").where(F.startswith("_name", "_title") | F.startswith("_title", "_name"))
    return hits.groupBy(file).agg(F.min(paper).alias(paper))


def filtered_findings(findings: DataFrame, columns: list[str], tests: tuple[str, ...]) -> DataFrame:
    """Findings without those of ``tests`` whose location names one of ``columns``."""
    name = F.regexp_extract("location", "column '([^']+)'", 1)
    return findings.where(~(F.col("test").isin(*tests) & F.lower(name).isin(*[c.lower() for c in columns])))
