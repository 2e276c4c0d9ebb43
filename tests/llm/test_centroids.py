"""Centroid clustering against plain Lloyd rounds in whole numbers, and its promises on odd vectors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from siftline.llm import centroids, common

from ..conftest import SF


def _plain(rows, k=16, rounds=3, dims=64):
    """vec_id -> rows (cluster, distance) in order of vectors, and the centroids, by comparing with every centroid."""
    kept = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in hashed[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), c


def _same(got, rows, **options):
    want, c = _plain(rows, **options)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    total = sum(d for _, _, d in want)
    for r in got:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_given_vectors(spark):
    df = common.read(spark, SF, "embeddings")
    _same(centroids.cluster_report(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = [[float(x) for x in rng.normal(0, 0.3, 64)] for _ in range(6)]
    rows = [(k, base[k % 6], k) for k in range(40)]  # copies and ties
    rows += [(7, base[0], 1), (7, base[3], 1), (None, base[1], 2), (None, None, 2), (101, None, 3), (102, [], 3), (103, base[0][:63], 3), (104, [*base[0][:63], None], 3)]
    rows += [(105, [*base[0][:63], float("nan")], 3), (106, [*base[0][:63], float("-inf")], 3), (107, [1e6] * 32 + [-1e6] * 32, 4), (108, [0.0] * 64, 4), (109, [-1e-9] * 64, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").repartition(5)
    got = centroids.cluster_report(df).collect()
    _same(got, [(i, e) for i, e, _ in rows])
    assert len(got) == 46


def test_fewer_vectors_than_centroids_and_none(spark):
    df = spark.createDataFrame([(k, [k / 10] * 64) for k in range(5)], "vec_id long, embedding array<float>")
    got = centroids.cluster_report(df).collect()
    assert {r.distance for r in got} == {0} and len({r.cluster for r in got}) == 5
    none = centroids.cluster_report(df.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_too_large_a_component_is_told(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_report(df).collect()


def test_bounds_leave_few_distances(spark):
    rng = np.random.default_rng(8)
    middles = rng.integers(-400, 400, (12, 64))
    v = (middles[rng.integers(0, 12, 4000)] + rng.integers(-20, 20, (4000, 64))).astype("i8")
    centre = v.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((v - centre).T))
    turn = centroids.Rotation(centre, np.ascontiguousarray(axes.T[::-1][:8]))
    lead, rest = turn.split(v.astype("f8"))
    own, distance, tried = centroids.nearest(v, lead, rest, middles.astype("i8"), turn)
    every = ((v[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert tried < 1.1 * len(v)  # of 12 for each
    ties = np.concatenate([middles, middles]).astype("i8")
    assert (centroids.nearest(v, lead, rest, ties, turn)[0] == own).all()
