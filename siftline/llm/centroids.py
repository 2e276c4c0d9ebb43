"""Centroid clustering: PCA-rotated filtering.

Vectors become integers and are rotated once along the axes of most variance. What is stored with each is its leading
rotated coordinates and the norm of the rest. The squared distance of the leading coordinates and the squared
difference of the norms bound the true distance from below, so only centroids whose bound doesn't exceed the best
distance found are worked out, in integers. Floating-point numbers decide nothing: their slack is part of the bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Components may be as large as this after scaling, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
#: Relative slack of a bound in float64, far above its rounding errors, and absolute slack.
SLACK, LEAST_SLACK = 1e-9, 1e-6


@dataclass
class Rotation:
    centre: np.ndarray
    axes: np.ndarray  # one row for each leading coordinate

    def split(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and norm of the rest."""
        x = vectors - self.centre
        lead = x @ self.axes.T
        rest = x - lead @ self.axes
        return lead, np.sqrt(np.einsum("ij,ij->i", rest, rest))


def integer_vectors(embeddings: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, v): ``floor(scale * x)`` of the vectors of ``dims`` components without nulls, NaNs and infinities.

    Others, null vectors too, are left out; repeated rows stay. A scaled component beyond 2^27 either way raises an
    error, as distances wouldn't fit a long.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    x64 = F.col("embedding").cast("array<double>")
    whole = lambda x: F.when(F.abs(x) <= LARGEST // scale, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for distances in longs")).cast("int"))
    kept = embeddings.select("vec_id", x64.alias("x")).where((F.size("x") == dims) & F.forall("x", finite))
    return kept.select("vec_id", F.transform("x", whole).alias("v"))


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width).astype(kind)


def rotation(vectors: DataFrame, dims: int, share: float) -> Rotation:
    """The axes of most variance that carry ``share`` of it, from sums over all vectors; of none, the first axis."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            v = _matrix(batch.column("v"), dims, "f8")
            x = np.concatenate([np.ones((len(v), 1)), v], axis=1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["place", "total"])

    parts = vectors.select("v").mapInArrow(moments, "place long, total double")
    total = np.zeros((dims + 1) ** 2)
    for r in parts.groupBy("place").agg(F.sum("total").alias("total")).collect():  # as many rows as places
        total[r.place] = r.total
    total = total.reshape(dims + 1, dims + 1)
    n = max(total[0, 0], 1)
    centre = total[0, 1:] / n
    spread, axes = np.linalg.eigh(total[1:, 1:] / n - np.outer(centre, centre))
    spread, axes = np.maximum(spread[::-1], 0), axes[:, ::-1].T
    leading = int(np.searchsorted(np.cumsum(spread), share * spread.sum())) + 1
    return Rotation(centre, np.ascontiguousarray(axes[: min(leading, dims)]))


def rotated(vectors: DataFrame, turn: Rotation, dims: int) -> DataFrame:
    """Adds ``lead`` (leading rotated coordinates) and ``rest`` (norm of the others) to vectors (vec_id, v)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = turn.split(_matrix(batch.column("v"), dims, "f8"))
            offsets = np.arange(0, lead.size + 1, lead.shape[1], dtype="i4")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, lead.reshape(-1)), pa.array(rest)], names=[*batch.schema.names, "lead", "rest"])

    ident = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(split, f"vec_id {ident}, v array<int>, lead array<double>, rest double")


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, distances worked out): ties go to the smaller number."""
    n, k = len(v), len(centroids)
    c_lead, c_rest = turn.split(centroids.astype("f8"))
    norms = np.einsum("ij,ij->i", lead, lead)[:, None] + rest[:, None] ** 2 + (c_lead**2).sum(axis=1) + c_rest**2
    bound = np.zeros((n, k))
    for j in range(k):
        d = lead - c_lead[j]
        bound[:, j] = np.einsum("ij,ij->i", d, d) + (rest - c_rest[j]) ** 2
    bound -= SLACK * norms + LEAST_SLACK

    def exact(rows: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = v[rows] - centroids[j]
        return np.einsum("ij,ij->i", d, d)

    best = bound.argmin(axis=1)
    distance = exact(np.arange(n), best)
    tried, guess = n, best.copy()
    for j in range(k):
        rows = np.flatnonzero((bound[:, j] <= distance) & (guess != j))
        found = exact(rows, np.full(len(rows), j))
        better = (found < distance[rows]) | ((found == distance[rows]) & (j < best[rows]))
        best[rows[better]], distance[rows[better]] = j, found[better]
        tried += len(rows)
    return best, distance, tried


def _batch(batch: pa.RecordBatch, dims: int, turn: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _matrix(batch.column("v"), dims, "i8"), _matrix(batch.column("lead"), len(turn.axes), "f8"), np.asarray(batch.column("rest"))


def _moved(table: DataFrame, centroids: np.ndarray, turn: Rotation) -> np.ndarray:
    """Each centroid as the floor of the mean of its vectors; one without vectors stays."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), "i8")
        for batch in batches:
            v, lead, rest = _batch(batch, dims, turn)
            own = nearest(v, lead, rest, centroids, turn)[0]
            order = np.argsort(own, kind="stable")
            there, first = np.unique(own[order], return_index=True)
            total[there, 1:] += np.add.reduceat(v[order], first, axis=0) if len(v) else 0
            total[there, 0] += np.diff(np.append(first, len(v)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["place", "total"])

    parts = table.select("v", "lead", "rest").mapInArrow(sums, "place long, total long")
    found = {r.place: int(r.total) for r in parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    moved = centroids.copy()
    for j in range(k):
        count = found.get(j * (dims + 1), 0)
        if count:
            moved[j] = [found[j * (dims + 1) + 1 + i] // count for i in range(dims)]
    return moved


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, share: float = 0.8) -> tuple[DataFrame, np.ndarray]:
    """``(assigned, centroids)``: vec_id, cluster, distance and tried (distances worked out for its batch) of each kept
    vector, and the final centroids.

    Centroids start as the ``k`` kept vectors of smallest SHA-256 of ``1:<vec_id>``; null ids come after all others,
    repeated ids are ordered by their components, and fewer vectors than ``k`` make fewer centroids. An empty table
    has no rows. The table of rotated vectors is written once and read in each round; each round sends back one sum
    for each centroid and component.
    """
    vectors = integer_vectors(embeddings, dims, scale)
    rank = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.withColumn("rank", rank).orderBy(F.col("rank").asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return embeddings.sparkSession.createDataFrame([], f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, tried long"), np.zeros((0, dims), "i8")
    centroids = np.array([r.v for r in first], "i8")
    turn = rotation(vectors, dims, share)
    table = common.cut(rotated(vectors, turn, dims))
    for _ in range(rounds):
        centroids = _moved(table, centroids, turn)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, distance, tried = nearest(*_batch(batch, dims, turn), centroids, turn)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own.astype("i4")), pa.array(distance), pa.array(np.full(len(own), tried))], names=["vec_id", "cluster", "distance", "tried"])

    ident = table.schema["vec_id"].dataType.simpleString()
    return common.cut(table.mapInArrow(assign, f"vec_id {ident}, cluster int, distance long, tried long")), centroids


def cluster_report(embeddings: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector; see cluster."""
    assigned, centroids = cluster(embeddings, **options)
    sums = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row for each centroid
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.array(*(F.lit(x) for x in values)).cast(f"array<{kind}>"), F.col("cluster"))
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        of([sums.get(j, 0) for j in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        of(hashes, "string").alias("centroid_sha256"),
    )
