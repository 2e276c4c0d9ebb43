"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source fall into blocks by a hash of their id: the blocks are a random partition of the
source. A source's quota is a number of words; it is met by whole blocks in a permuted order, pass after
pass, and in the last block by single documents. The exact block quotas of all sources are then divided
among the output shards: the root holds all draws, and each node gives its left half a multivariate
hypergeometric sample of them, down to one shard. Each shard takes the next blocks of each source, so the
blocks of different shards are disjoint, and orders its documents by a hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose draws one task splits among the shards.
GROUP = 1024


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_level(total: float, stand: Callable[[float], tuple[float, float, int]]) -> float:
    """What a weight of one gets when ``total`` is shared by weight and no source gets more than its limit.

    ``stand`` tells of a level what the sources below it take (those whose limit the level passes), the weight of
    the others, and how many are below. Each round shares anew what those leave; the level only rises.
    """
    level, below = 0.0, -1
    while True:
        taken, weight, n = stand(level)
        if n == below or not weight:
            return level
        level, below = (total - taken) / weight, n


def water_fill(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size; the excess is shared again."""

    def stand(level: float) -> tuple[float, float, int]:
        low = [k for k in range(len(sizes)) if level * weights[k] > most * sizes[k]]
        return sum(most * sizes[k] for k in low), sum(weights) - sum(weights[k] for k in low), len(low)

    level = fill_level(float(sum(sizes)), stand)
    return [float(min(level * w, most * s)) for s, w in zip(sizes, weights)]


def source_plan(sources: DataFrame, weights: tuple[int, ...], most: int, block_words: int) -> DataFrame:
    """source, source_no, source_size, target, n_blocks and quota of each of ``sources`` (source, size).

    Sources are numbered by code point, null last. The driver holds a few sums in each round, whatever their number.
    """
    numbered = common.numbered(sources, [F.col("source").asc_nulls_last()], "source_no").withColumnRenamed("size", "source_size")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights)).cast("int") + 1)
    numbered = common.cut(numbered.withColumn("weight", weight.cast("double")))
    total = float(numbered.agg(F.sum("source_size")).first()[0] or 0)
    limit = F.col("source_size") * float(most)

    def stand(level: float) -> tuple[float, float, int]:
        low = level * F.col("weight") > limit
        r = numbered.agg(F.sum(F.when(low, limit)), F.sum(F.when(~low, F.col("weight"))), F.count_if(low)).first()
        return r[0] or 0.0, r[1] or 0.0, r[2]

    target = F.least(F.lit(fill_level(total, stand)) * F.col("weight"), limit)
    planned = numbered.withColumn("target", target).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("int"))
    return planned.select("source", "source_no", "source_size", "target", "n_blocks", F.round("target").cast("long").alias("quota"))


def split_quotas(quotas: list[int], shards: int, seed: int | list[int], totals: list[int] | None = None) -> np.ndarray:
    """Block draws of each source for each shard: rows are shards, columns sources. Shards get even shares of all
    draws, or ``totals``."""
    out = np.zeros((shards, len(quotas)), "i8")

    def split(quota: np.ndarray, low: int, high: int, path: int) -> None:
        if high - low == 1:
            out[low] = quota
            return
        middle, total = (low + high) // 2, int(quota.sum())
        left = np.zeros_like(quota)
        if total:
            take = total * (middle - low) // (high - low) if totals is None else sum(totals[low:middle])
            left = np.random.default_rng([*np.atleast_1d(seed), path]).multivariate_hypergeometric(quota, take, method="marginals")
        split(left, low, middle, 2 * path)
        split(quota - left, middle, high, 2 * path + 1)

    split(np.asarray(quotas, "i8"), 0, shards, 1)
    return out


def shard_ends(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, ends): after which of its draws each shard ends, for each source of ``draws``.

    The tree splits the draws of ``GROUP`` sources together, then each group's part of a shard among its sources;
    that is the same distribution, and no task or driver holds a number for each source and shard.
    """
    counts = common.cut(draws.groupBy("source_no").agg(F.count("*").alias("n")).withColumn("team", F.floor(F.col("source_no") / GROUP)))
    teams = sorted((r.team, r.n) for r in counts.groupBy("team").agg(F.sum("n").alias("n")).collect())
    upper = split_quotas([n for _, n in teams], shards, seed)
    totals = draws.sparkSession.createDataFrame([(t, upper[:, k].tolist()) for k, (t, _) in enumerate(teams)], "team long, totals array<long>")

    def split(table: pa.Table) -> pa.Table:
        table = table.sort_by("source_no")
        found = split_quotas(table.column("n").to_pylist(), shards, [seed, table.column("team")[0].as_py()], table.column("totals")[0].as_py())
        return pa.table({"source_no": table.column("source_no"), "ends": pa.array(np.cumsum(found, axis=0).T.tolist(), pa.list_(pa.int64()))})

    return counts.join(totals, "team").groupBy("team").applyInArrow(split, "source_no long, ends array<long>")


def _permuted(*cols: Column | str) -> Column:
    return F.xxhash64(*cols)


def fill(weights: list[int], goal: int) -> list[int]:
    """Places of the documents that fill ``goal``: in order each that still fits; one of the rest is then added, or put
    for some of the last, where that comes nearer."""
    out, left, all_ = [], goal, np.asarray(weights, "i8")
    for k, n in enumerate(weights):
        if n <= left:
            out.append(k)
            left -= n
    best, off, free = out, left, np.ones(len(all_), bool)
    free[out] = False
    for last in range(min(len(out), 20) + 1):
        if last:
            free[out[-last]] = True
            left += weights[out[-last]]
        rest = np.flatnonzero(free)
        if off and len(rest):
            miss = np.abs(all_[rest] - left)
            k = int(miss.argmin())
            if miss[k] < off:
                best, off = [*out[: len(out) - last], int(rest[k])], int(miss[k])
    return best


def _picked(table: pa.Table) -> pa.Table:
    """The documents of a cut block that fill its goal; a block has at most as many as it has words."""
    table = table.sort_by([(c, "ascending") for c in ("at", "key", "doc_id")])
    places = fill(table.column("weight").to_pylist(), table.column("goal")[0].as_py())
    return table.select(["source_no", "block", "pass", "key", "doc_id"]).take(pa.array(places, pa.int64()))


def _key(seed: int, source: Column) -> Column:
    """Tells rows apart that differ in id, text or source."""
    return F.xxhash64(F.lit(seed), "doc_id", "text", source, *(F.isnull(c) for c in (F.col("doc_id"), F.col("text"), source)))


def _running(draws: DataFrame) -> DataFrame:
    """Adds to each block of a pass the words (``before``) and the number of blocks (``rank``) that stand before it.

    Blocks stand in order of ``at``; runs of them by its upper bits are summed first, so that a hot source's blocks
    needn't meet in one task.
    """
    runs = draws.withColumn("run", F.shiftrightunsigned("at", 56))
    sums = runs.groupBy("source_no", "pass", "run").agg(F.sum("words").alias("run_words"), F.count("*").alias("run_blocks"))
    ahead = Window.partitionBy("source_no", "pass").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "pass", "run", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("run_words", "run_blocks")))
    within = Window.partitionBy("source_no", "pass", "run").orderBy("at", "block")
    before = F.coalesce(F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("before", before).withColumn("rank", F.row_number().over(within) - 1).join(sums, ["source_no", "pass", "run"])
    return runs.withColumn("before", F.col("before") + F.col("run_words")).withColumn("rank", F.col("rank") + F.col("run_blocks")).drop("run", "run_words", "run_blocks")


def mix(docs: DataFrame, shards: int = 16, block_words: int = 200_000, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, broadcast_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """``(sized, drawn)``. ``sized``: a row for each row of docs with row key, doc_id, source, size, source_size
    and target. ``drawn``: the row keys that the mix takes, once for each time, with shard and place.

    Null text has no words; null source is a source of its own, the last; a document without words weighs
    nothing and is drawn as often as its block. Rows that repeat an id, a text and a source share their key and are
    drawn alike. Statistics are exact sums over all rows; the plan of sources is broadcast while it has at most
    ``broadcast_bytes``, else joined by source.
    """
    source = F.col("source").cast("string")
    sized = common.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), word_count("text").alias("size"), _key(seed, source).alias("key")))
    sources = common.cut(sized.groupBy("source").agg(F.sum("size").alias("size")))
    plan = source_plan(sources, weights, most, block_words)
    room = sources.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    plan_ = F.broadcast(plan) if room <= broadcast_bytes else plan
    sized = sized.join(plan_, sized.source.eqNullSafe(plan.source)).drop(plan.source)
    sized = sized.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.col("n_blocks")).cast("int"))
    blocks = sized.groupBy("source_no", "block").agg(F.sum("size").alias("words"), *(F.max(c).alias(c) for c in ("source_size", "quota", "n_blocks")))
    passes = blocks.where("quota > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("before_pass", F.col("pass") * F.col("source_size")).where("before_pass < quota")
    draws = _running(passes.withColumn("at", _permuted(F.lit(seed + 2), "source_no", "pass", "block"))).withColumn("before", F.col("before") + F.col("before_pass"))
    draws = draws.where("before < quota").withColumn("room", F.col("quota") - F.col("before")).withColumn("draw", F.col("pass").cast("long") * F.col("n_blocks") + F.col("rank"))
    draws = common.cut(draws.select("source_no", "block", "pass", "words", "room", "draw"))
    draws = draws.join(shard_ends(draws, shards, seed), "source_no").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("draw")))).drop("ends")
    drawn = sized.select("key", "doc_id", "size", "source_no", "block").join(draws, ["source_no", "block"])
    whole = drawn.where("words <= room")
    # One block of each source is cut. Rows that repeat an id and text are drawn alike, so they weigh together. What is
    # picked is taken, or left out where less than half of the block has to go; rows without words go by their hash.
    taken_out = F.col("room") * 2 > F.col("words")
    unit = ["source_no", "block", "pass", "key", "doc_id"]
    units = drawn.where("words > room").groupBy(*unit).agg(F.first("size").alias("size"), F.sum("size").alias("weight"), *(F.first(c).alias(c) for c in ("shard", "words", "room")))
    units = common.cut(units.withColumn("at", _permuted(F.lit(seed + 3), "key")))
    goal = F.when(taken_out, F.col("words") - F.col("room")).otherwise(F.col("room"))
    picked = units.where("weight > 0").select(*unit, "weight", "at", goal.alias("goal")).groupBy("source_no", "block", "pass").applyInArrow(_picked, "source_no long, block int, pass int, key long, doc_id long")
    same = [units[c].eqNullSafe(picked[c]) if c == "doc_id" else units[c] == picked[c] for c in unit]
    part = units.where("weight > 0 and room * 2 <= words").join(picked, same, "left_semi").unionByName(units.where("weight > 0 and room * 2 > words").join(picked, same, "left_anti"))
    part = part.unionByName(units.where((F.col("weight") == 0) & (F.pmod("at", "words") < F.col("room"))))
    whole, part = (d.select("key", "doc_id", "size", "source_no", "pass", "shard") for d in (whole, part))
    drawn = whole.unionByName(part).select("key", "doc_id", "size", "source_no", "pass", "shard", _permuted(F.lit(seed + 4), "key", "pass").alias("place"))
    return sized.select("key", "doc_id", "source", "size", "source_size", "target"), drawn


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of each row of ``docs``."""
    sized, drawn = mix(docs, **options)
    times = drawn.groupBy("key", "doc_id", "pass").agg(F.first("size").alias("size"), F.first("shard").alias("shard")).groupBy("key", "doc_id").agg(F.sum("size").alias("taken"), F.array_sort(F.collect_list("shard")).alias("shards"))
    joined = sized.join(times.withColumnRenamed("doc_id", "times_id"), (sized.key == times.key) & sized.doc_id.eqNullSafe(F.col("times_id")), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "shards")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: one row for each time, in shard order, shuffled within a shard.

    All columns of ``docs`` stay, whatever their names; null ids, texts and sources are taken as ``mix`` says.
    """
    _, drawn = mix(docs, **options)
    row, key, id_, shard, place = common.unused(docs.columns, "row", "key", "id", "shard", "place")
    times = drawn.groupBy("key", "doc_id", "pass").agg(F.first("shard").alias(shard), F.first("place").alias(place)).select(F.col("key").alias(key), F.col("doc_id").alias(id_), shard, place)
    keyed = docs.withColumn(row, _key(options.get("seed", 7), F.col("source").cast("string")))
    joined = keyed.join(times, (F.col(row) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    return joined.repartition(common.partitions(docs), shard, F.pmod(F.col(place), F.lit(64))).sortWithinPartitions(shard, place).select(*docs.columns)
