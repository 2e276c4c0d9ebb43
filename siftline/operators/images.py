"""Matching of image descriptors: Hamming neighbours by chunks, and nearest neighbours with a ratio test."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sign_bits(vector: Column, bits: int = 64) -> Column:
    """A number whose bit k is set where component k is positive."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda a, k: F.when(F.get(vector, k) > 0, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))).otherwise(a))


def hamming_matches(queries: DataFrame, base: DataFrame, key: str, bits: str, most: int = 8, chunk_bits: int = 16) -> DataFrame:
    """(query, match, distance, similarity) of rows at most ``most`` bits apart, other than themselves.

    Of the chunks of a hash one differs in at most ``most / chunks`` bits. Each query asks for every value so near its
    own chunks, and rows meet by an equi-join on chunk and value; nothing within reach is missed. A bucket holds one
    row in 2 ** ``chunk_bits``; a query asks some hundred times at 8 bits.
    """
    n = 64 // chunk_bits
    reach = most // n
    masks = sorted(sum(1 << k for k in some) for r in range(reach + 1) for some in itertools.combinations(range(chunk_bits), r))
    chunk = F.array(*(F.struct(F.lit(k).alias("no"), F.expr(f"shiftrightunsigned({bits}, {chunk_bits * k}) & {(1 << chunk_bits) - 1}L").alias("value")) for k in range(n)))
    b = base.select(F.col(key).alias("match"), F.col(bits).alias("bits_b"), F.explode(chunk).alias("c")).select("match", "bits_b", "c.no", "c.value")
    q = queries.select(F.col(key).alias("query"), F.col(bits).alias("bits_a"), F.explode(chunk).alias("c"))
    q = q.select("query", "bits_a", "c.no", F.explode(F.transform(F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>"), lambda m: m.bitwiseXOR(F.col("c.value")))).alias("value"))
    pairs = q.join(b, ["no", "value"]).where("query <> match").withColumn("distance", F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))))
    return pairs.where(F.col("distance") <= most).select("query", "match", "distance").distinct().withColumn("similarity", 1 - F.col("distance") / 64)


#: Rows of a cell, and as many queries, that meet at once.
BLOCK = 2048


def _dense(lists: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, zero where there is no component, and where there is one."""
    lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    flat = lists.flatten()
    known = np.arange(width) < pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)[:, None]
    x = np.zeros(known.shape)
    x[known] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    known[known] = flat.is_valid().to_numpy(zero_copy_only=False)
    return x, known


def _two_nearest(q: pa.Table, b: pa.Table) -> pa.Table:
    """(query, match, distance) of each query's two nearest rows of ``b``: products of matrices rule out what is further than
    rounding can tell, and distances of the rest are summed in order of the components that both have."""
    out = []
    width = max((pc.max(pc.list_value_length(x)).as_py() or 0 for x in (q["qv"], b["bv"]) if len(x)), default=0)
    if width and len(q) and len(b):
        (x, xs), (y, ys) = _dense(q["qv"], width), _dense(b["bv"], width)
        codes = pc.rank(pa.concat_arrays([*q["query"].chunks, *b["match"].chunks]), sort_keys="ascending", tiebreaker="dense").to_numpy()
        own, other = codes[: len(q)], codes[len(q) :]
        plain_x, plain_y = ((v.all(1) & (np.abs(np.nan_to_num(u, nan=np.inf)).max(1) < 1e100)) for u, v in ((x, xs), (y, ys)))
        xx, yy = ((np.where(p[:, None], u, 0) ** 2).sum(1) for u, p in ((x, plain_x), (y, plain_y)))
        for at in range(0, len(q), 256):
            part = slice(at, at + 256)
            sums = xx[part, None] + yy
            about = sums - 2 * (np.where(plain_x[part, None], x[part], 0) @ np.where(plain_y[:, None], y, 0).T)
            sure, differ = plain_x[part, None] & plain_y, own[part, None] != other
            most = np.where(sure & differ, about + 1e-12 * sums, np.inf)
            second = np.partition(most, 1, axis=1)[:, 1] if len(b) > 1 else np.full(len(most), np.inf)
            i, j = np.nonzero(differ & (~sure | (about - 1e-12 * sums <= second[:, None])))
            square, common = np.zeros(len(i)), np.zeros(len(i), bool)
            with np.errstate(all="ignore"):
                for k in range(width):
                    both = xs[at + i, k] & ys[j, k]
                    square += np.where(both, (x[at + i, k] - y[j, k]) ** 2, 0)
                    common |= both
            i, j, distance = at + i[common], j[common], np.sqrt(square[common])
            order = np.lexsort((other[j], distance, i))
            i, j, distance = i[order], j[order], distance[order]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else i
            keep = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < 2
            out.append(pa.table([q["query"].take(i[keep]), b["match"].take(j[keep]), pa.array(distance[keep])], ["query", "match", "distance"]))
    return pa.concat_tables(out) if out else pa.table([q["query"].slice(0, 0), b["match"].slice(0, 0), pa.array([], pa.float64())], ["query", "match", "distance"])


def ratio_matches(queries: DataFrame, base: DataFrame, key: str, vector: str, cell: str, ratio: float = 0.7, block: int = BLOCK) -> DataFrame:
    """For each query its nearest neighbour within its cell, if clearly nearer than the second; ties go to the smaller key.

    Queries and rows of a cell meet in blocks of about ``block``, every block of queries every block of rows, and a task holds
    two blocks; of each meeting the two nearest are kept. Components that one of two vectors lacks don't count.
    """
    queries, base = (x.where(F.col(key).isNotNull()) for x in (queries, base))
    number = lambda df, name: df.groupBy(cell).agg(F.ceil(F.count("*") / block).alias(name))
    sizes = number(base, "_blocks").join(number(queries, "_turns"), cell)
    part = lambda n: F.pmod(F.xxhash64(key), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = queries.join(sizes, cell).select(F.col(cell).alias("_cell"), part(F.col("_turns")).alias("_turn"), every("_blocks").alias("_block"), F.col(key).alias("query"), F.col(vector).alias("qv"))
    b = base.join(sizes, cell).select(F.col(cell).alias("_cell"), every("_turns").alias("_turn"), part(F.col("_blocks")).alias("_block"), F.col(key).alias("match"), F.col(vector).alias("bv"))
    kind = base.schema[key].dataType.simpleString()
    pairs = q.groupBy("_cell", "_turn", "_block").cogroup(b.groupBy("_cell", "_turn", "_block")).applyInArrow(_two_nearest, f"query {kind}, match {kind}, distance double")
    turn = F.row_number().over(Window.partitionBy("query").orderBy("distance", "match"))
    near = pairs.withColumn("turn", turn).where("turn <= 2").groupBy("query").agg(F.min_by("match", "turn").alias("match"), F.min("distance").alias("distance"), F.max("distance").alias("next"), F.count("*").alias("n"))
    return near.where((F.col("n") == 2) & (F.col("distance") < ratio * F.col("next"))).select("query", "match", "distance")
