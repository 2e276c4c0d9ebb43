"""Near dedup: links in proportion to the nodes, recall just above the threshold, and its parts against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from siftline.llm import near_dedup

from .test_operators import brute_components, docs_of, shingles


def near_copies(n, words=150, most=5, seed=3):
    """Different copies of one text, each with up to ``most`` words replaced."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(1, most)):
            w[rng.randrange(words)] = f"n{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(w)))
    return rows


def test_links_grow_in_proportion(spark, monkeypatch):
    """Of n near copies, all different, every step hands on a few links for each node, however many share a bucket."""
    monkeypatch.setattr(near_dedup, "TILE", 25)
    plain, seen = near_dedup.components, []

    def counted(edges, *rest):
        seen.append(edges.count())
        return plain(edges, *rest)

    monkeypatch.setattr(near_dedup, "components", counted)
    totals = []
    for n in (100, 200, 400):
        seen.clear()
        rows = near_copies(n)
        got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs_of(spark, rows, parts=6)).collect()}
        comp = brute_components(rows)
        least = {}
        for (i, _), c in zip(rows, comp):
            least[c] = min(least.get(c, i), i)
        assert got == {i: least[c] for (i, _), c in zip(rows, comp)}
        totals.append(list(seen))
    assert all(sum(x) <= 6 * n for n, x in zip((100, 200, 400), totals)), totals


def test_recall_just_above_the_threshold(spark):
    rng, rows, want = random.Random(8), [], 0
    while want < 600:
        n = rng.randint(90, 200)
        a = [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
        b = list(a)
        b[rng.randrange(5, n - 5)] = "x"
        if rng.random() < 0.7:
            b[rng.randrange(5, n - 5)] = "y"
        if 0.85 <= len(shingles(" ".join(a)) & shingles(" ".join(b))) / len(shingles(" ".join(a)) | shingles(" ".join(b))) < 0.9:
            rows += [(2 * want, " ".join(a)), (2 * want + 1, " ".join(b))]
            want += 1
    kept = near_dedup.near_kept(docs_of(spark, rows, parts=4)).count()
    assert 2 * want - kept >= 0.99 * want


def test_bloom_that_does_not_fit_gives_the_same(spark, monkeypatch):
    rows = near_copies(30) + [(100 + k, f"other text number {k} with a few words more") for k in range(20)]
    docs = docs_of(spark, rows)
    plain = lambda: sorted((r.doc_id, r.component_id) for r in near_dedup.near_groups(docs).collect())
    want = plain()
    monkeypatch.setattr(near_dedup, "_bloom", lambda ids: None)
    assert plain() == want


@pytest.mark.parametrize("seed", range(4))
def test_intersections(seed):
    rng = np.random.default_rng(seed)
    sets = [rng.choice(5000, rng.integers(0, 900), replace=False).astype("u8") for _ in range(30)]
    a, b = sets[:13], sets[13:]
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert np.array_equal(near_dedup.intersections(a, b), want)
    assert near_dedup.intersections([np.empty(0, "u8")], [np.empty(0, "u8")]).tolist() == [[0]]


def test_smallest_reached():
    links = np.zeros((6, 6), bool)
    for a, b in ((5, 4), (4, 3), (1, 5)):
        links[a, b] = links[b, a] = True
    assert near_dedup.smallest_reached(links).tolist() == [0, 1, 2, 1, 1, 1]


def test_supported_keeps_all_that_can_be_linked(spark):
    rng = np.random.default_rng(1)
    base = rng.choice(10**6, 100, replace=False)
    sets = {1: base, 2: np.concatenate([base[:95], [10**7 + 1]]), 3: np.concatenate([base[:50], 2 * 10**7 + np.arange(50)])}
    df = spark.createDataFrame([(k, len(v), bytearray(near_dedup._pack(np.sort(v).astype("u8")))) for k, v in sets.items()], "node long, size long, grams binary")
    assert sorted(r.node for r in near_dedup.supported(df, 85).collect()) == [1, 2]


def templated(n, blocks=20, words=15, variants=3, seed=9):
    """Texts of blocks that each have a few variants: much in common, hardly ever linked."""
    rng = random.Random(seed)
    block = [[" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(words)) for _ in range(variants)] for _ in range(blocks)]
    return [(k, " ".join(rng.choice(b) for b in block)) for k in range(n)]


def test_texts_that_are_alike_meet_in_proportion(spark, monkeypatch):
    """Of n templated texts in one cluster, few of them linked, the sets that the last comparison moves grow with n."""
    monkeypatch.setattr(near_dedup, "TILE", 25)
    plain, moved = near_dedup.outer_links, []

    def counted(named, large, group, *rest):
        moved[-1] += large.agg({"moved": "sum"}).first()[0] or 0
        return plain(named, large, group, *rest)

    monkeypatch.setattr(near_dedup, "outer_links", counted)
    for n in (250, 500, 1000):
        rows = templated(n)
        rows += [(10_000 + k, " ".join([*rows[k][1].split()[:-2], "other", "end"])) for k in range(10)]  # linked ones
        moved.append(0)
        got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs_of(spark, rows, parts=4)).collect()}
        comp = brute_components(rows)
        least = {}
        for (i, _), c in zip(rows, comp):
            least[c] = min(least.get(c, i), i)
        assert got == {i: least[c] for (i, _), c in zip(rows, comp)}
    assert moved[2] < 3 * moved[1] and moved[2] < 4 * 1010, moved


@pytest.mark.parametrize("percent", [80, 85])
def test_longer_keys_meet_at_the_threshold(percent):
    """Sets just above the threshold share a bucket of the longer keys."""
    rng, banding, met = np.random.default_rng(percent), near_dedup.Banding(percent, near_dedup.STEEP), 0
    for _ in range(300):
        common_ = rng.choice(2**40, 400, replace=False).astype("u8")
        own = (400 - 400 * percent // 100) * 100 // (2 * 100)
        a, b = common_[: 400 - own], common_[own:]
        assert 100 * (400 - 2 * own) >= percent * 400
        keys = near_dedup.side_keys(near_dedup.minhashes([a, b], banding.hashes), banding.side)
        met += any(t[0] == t[1] for t in near_dedup.tables(keys, banding.side))
    assert met >= 298
