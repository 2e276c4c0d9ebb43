"""The training-data operators against plain versions, and their promises on names, repeats, bounds and sources."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import common, exact_dedup, fingerprint, mixing, near_dedup, quality, secrets, toxicity, url_filter

from ..conftest import SF

# names, repeats, bounds


def test_columns_of_any_name_pass_through(spark):
    names = ["_key", "_id", "_shard", "_place", "_row", "_row_key", "_part", "_score", "_good", "_quality", "__key", "score", "block", "pass", "size", "key", "target"]
    rows = [(k, f"text number {k % 9} of some words and more that follow here", "s" if k % 2 else None, *(f"{n}{k}" for n in names)) for k in range(40)]
    docs = common.prepare(spark) and spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    for kept in (exact_dedup.exact_kept(docs), near_dedup.near_kept(docs), mixing.mixed_documents(docs), corpus_pipeline.good(spark, docs, SF)):
        assert kept.columns == docs.columns
        for r in kept.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names)
    assert exact_dedup.exact_kept(docs).count() == 9


def test_a_sample_is_bounded_whatever_repeats(spark):
    docs = common.prepare(spark) and spark.createDataFrame([(k, f"{'x' * 100} {j}") for k in range(30) for j in range(50)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] * 3 + [(None, 1)], "doc_id long, quality int")
    texts, counts = common.labelled_texts(docs, labels, "quality", 4, 1 << 20)
    got = texts.collect()
    assert len(got) == 8 and len({r.doc_id for r in got}) == 8 and sum(counts.values()) < 30
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in common.labelled_texts(docs.repartition(7), labels, "quality", 4, 1 << 20)[0].collect())
    few = common.labelled_texts(docs, labels, "quality", 4, 250)[0].groupBy("label").agg(F.count("*").alias("n")).collect()
    assert sorted(r.n for r in few) == [2, 2]
    assert common.labelled_texts(docs, labels, "quality", 4, 1)[0].count() == 2  # one of each at least


def test_numbered_in_order(spark):
    rows = spark.createDataFrame([(f"s{k % 50:02}",) for k in range(50)] + [(None,)], "source string").repartition(5)
    got = common.numbered(rows, [F.col("source").asc_nulls_last()], "no").collect()
    assert sorted((r.no, r.source) for r in got) == [(k, f"s{k:02}") for k in range(50)] + [(50, None)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        common.shared_dir(Session())


# quality


def test_network_means_are_those_of_its_chunks():
    rng = np.random.default_rng(2)
    net = quality.Net(rng.normal(size=(256, quality.EMBED)).astype("f4"), rng.normal(size=(64, quality.FILTERS)).astype("f4"), rng.normal(size=quality.FILTERS).astype("f4"), np.ones(2 * quality.FILTERS), 0.0)
    for n in (1, 9, 511, 512, 1500, quality.SEGMENT - 3, quality.SEGMENT + 513):
        text = rng.integers(97, 123, n, "u1").tobytes()
        padded = np.frombuffer(text + bytes(600), "u1")
        means, maxima = [], []
        for a in range(0, n, quality.HALF):
            if a and a + quality.HALF >= n:
                break
            at = range(a, min(a + quality.CHUNK, n + n % 2), quality.STRIDE)
            best = np.max([net.embed[padded[k : k + 8]].reshape(-1) @ net.filters for k in at], axis=0)
            means.append(np.maximum(best + net.bias, 0))
        got = quality.features(net, [text, b"other"])[0]
        assert np.allclose(got[: quality.FILTERS], np.mean(means, axis=0), atol=1e-3) and np.allclose(got[quality.FILTERS :], np.max(means, axis=0), atol=1e-3), maxima


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    net = quality.Net(rng.normal(0, 0.5, (256, quality.EMBED)), rng.normal(0, 0.2, (64, quality.FILTERS)), rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 0.3, 2 * quality.FILTERS), 0.2)
    texts = [rng.integers(97, 107, n, "u1").tobytes() for n in (40, 700, 1300)]
    labels, weights = np.array([1, 0, 1]), np.array([1.0, 0.5, 2.0])

    def loss():
        z = quality.features(net, texts).astype("f8") @ net.weight + net.offset
        p = 1 / (1 + np.exp(-z))
        return float(np.mean(weights * -(labels * np.log(p) + (1 - labels) * np.log(1 - p))) + 0.5e-4 * (net.weight**2).sum())

    grads = quality._gradient(net, texts, labels, weights)
    for name in ("weight", "bias", "filters", "embed"):
        array = getattr(net, name)
        some = np.argsort(-np.abs(grads[name]).ravel())[:4]
        for k in some:
            spot, eps = np.unravel_index(k, array.shape), 2e-3
            was = array[spot]
            array[spot] = was + eps
            up = loss()
            array[spot] = was - eps
            down = loss()
            array[spot] = was
            assert abs((up - down) / (2 * eps) - grads[name][spot]) < 0.05 * abs(grads[name][spot]) + 2e-4, (name, spot)


# toxicity


@pytest.mark.parametrize("word", ["1d10t", "st0o", "@$$", "aa4", "m*n", "s-t.a", "b00bb"])
@pytest.mark.parametrize("border", [None, -0.4])
def test_viterbi_finds_the_best_of_all_paths(word, border):
    model = toxicity.log_model(np.random.default_rng(5).integers(0, 50, (28, 28, 28)).astype("f8"))
    best = {}
    for path in itertools.product(*toxicity.lattice(word, border)):
        said, score, before = "".join(x for x, _ in path), sum(c for _, c in path), (0, 0)
        for x in said:
            c = toxicity._symbol(x)
            score, before = score + float(model[before[0], before[1], c]), (before[1], c)
        score += float(model[before[0], before[1], 0])
        best[said] = max(best.get(said, -1e9), score)
    got = toxicity.viterbi(word, model, border)
    assert abs(best[got] - max(best.values())) < 1e-9


# secrets


def plain_linked(spans, text, scope):
    part = lambda s: secrets.KINDS[s[0]][1]
    inside, path = set(), set()
    for s in spans:
        if s[0] == 5:
            for t in spans:
                if t[0] != 5 and s[1] <= t[1] < s[2]:
                    if t[0] == 4:
                        path.add(t)
                    if any(s[1] + a <= t[1] < s[1] + b and t[2] <= s[1] + b for a, b in secrets._own(text[s[1] : s[2]])):
                        inside.update([s, t])
    path -= inside
    beside = lambda s, t: part(s) != part(t) and (t[2] <= s[1] and s[1] - t[2] <= scope or t[1] >= s[2] and t[1] - s[2] <= scope) and not (s[0] == 5 and t in path) and not (t[0] == 5 and s in path)
    return [s for s in spans if s[0] < 3 or s in inside or any(beside(s, t) for t in spans)]


@pytest.mark.parametrize("seed", range(40))
def test_links_equal_the_pairwise_join(seed):
    rng = random.Random(seed)
    mixed = lambda: "".join(rng.choice("abcdefghijklmnop0123456789ABCDEF") for _ in range(26))
    pool = [lambda: f"login=bob{rng.randint(0, 99)}x", mixed, lambda: f"https://h.example.net/v1/{mixed()}", lambda: f"https://h.example.net/v1?key={mixed()}", lambda: "https://u:" + mixed() + "@x.net/", lambda: "password = abcdef12", lambda: "AKIA" + "Q2" * 9, lambda: "host: db.example.org", lambda: "0123456789abcdef" * 2]
    text = "".join(rng.choice(pool)() + " " + "z " * rng.randint(0, 140) for _ in range(rng.randint(1, 14)))
    raw = text.encode()
    spans = secrets.scan(text, raw.lower(), 0 in secrets._long_runs([raw], 20))
    assert sorted(secrets.linked(spans, text, 200)) == sorted(plain_linked(spans, text, 200))


# mixing


def test_one_id_and_text_in_two_sources(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (2, "d e f g", "y"), (3, "h i", "x"), (1, "a b c", None)]
    docs = common.prepare(spark) and spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(docs).collect()
    by = {}
    for r in got:
        t = by.setdefault((r.source_size, r.target), [0, r.target])
        t[0] += r.taken
    assert len(got) == 5 and len(by) == 3 and all(abs(taken - target) <= 2 for taken, target in by.values())
    assert mixing.mixed_documents(docs).count() == sum(r.taken // r["size"] for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_plan_equals_water_fill(spark, seed, monkeypatch):
    rng = random.Random(seed)
    sizes = {f"s{k:03}": rng.choice((0, 1, 10, rng.randint(1, 10**6))) for k in range(120)} | {None: 77}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(6)
    got = sorted(mixing.source_plan(rows, (1, 2, 3), 3, 1000).collect(), key=lambda r: r.source_no)
    assert [r.source for r in got] == [*sorted(x for x in sizes if x), None]
    want = mixing.water_fill([sizes[r.source] for r in got], [(1, 2, 3)[k % 3] for k in range(len(got))], 3)
    assert np.allclose([r.target for r in got], want) and abs(sum(want) - sum(sizes.values())) < 1e-3 * sum(sizes.values()) + 1


def test_shards_split_the_draws_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    rng = random.Random(1)
    counts = {k: rng.randint(0, 30) for k in range(30)}
    draws = spark.createDataFrame([(k, j) for k, n in counts.items() for j in range(n)], "source_no long, draw long")
    ends = {r.source_no: r.ends for r in mixing.shard_ends(draws, 5, 7).collect()}
    assert {k: e[-1] for k, e in ends.items()} == {k: n for k, n in counts.items() if n}
    parts = np.array([np.diff(e, prepend=0) for e in ends.values()])
    assert (parts >= 0).all() and np.ptp(parts.sum(axis=0)) <= 5


def test_mix_equals_a_plain_simulation(spark):
    """Whole blocks in hashed order, pass after pass, then the documents of the cut block that fill it best."""
    rng = random.Random(6)
    rows = [(k, " ".join("w" * rng.randint(1, 40)), ["a", "b", "c"][min(2, k % 7)]) for k in range(900)]
    docs = common.prepare(spark) and spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    seed, block_words, most = 7, 600, 3
    got = {r.doc_id: r for r in mixing.mix_report(docs, block_words=block_words).collect()}
    sized = docs.select("doc_id", "source", mixing.word_count("text").alias("size"), mixing._key(seed, F.col("source")).alias("key"))
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    targets = dict(zip("abc", mixing.water_fill([sizes[s] for s in "abc"], [1, 2, 3], most)))
    sized = sized.withColumn("h", F.xxhash64(F.lit(seed + 1), "key")).withColumn("at", F.xxhash64(F.lit(seed + 3), "key")).collect()
    numbers = spark.createDataFrame([(k, p, b) for k in range(3) for p in range(most) for b in range(60)], "k long, p int, b int").select("k", "p", "b", F.xxhash64(F.lit(seed + 2), "k", "p", "b").alias("at")).collect()
    order = {(r.k, r.p, r.b): r.at for r in numbers}
    for k, s in enumerate("abc"):
        n_blocks, quota, blocks = max(1, -(-sizes[s] // block_words)), round(targets[s]), {}
        for r in sized:
            if r.source == s:
                blocks.setdefault(r.h % n_blocks, []).append(r)
        times, done = dict.fromkeys((r.doc_id for r in sized if r.source == s), 0), 0
        for p in range(most):
            # runs of the upper eight bits as unsigned, within them as signed
            for b in sorted(blocks, key=lambda b: (order[k, p, b] % 2**64 >> 56, order[k, p, b])):
                words = sum(r["size"] for r in blocks[b])
                room = quota - done
                if room <= 0:
                    break
                if words <= room:
                    taken = blocks[b]
                else:
                    docs_ = sorted((r for r in blocks[b] if r["size"]), key=lambda r: (r.at, r.key, r.doc_id))
                    out = room * 2 > words
                    picked = {docs_[x].doc_id for x in mixing.fill([r["size"] for r in docs_], words - room if out else room)}
                    taken = [r for r in docs_ if (r.doc_id in picked) != out]
                for r in taken:
                    times[r.doc_id] += 1
                done += min(words, room) if words <= room else room
        assert {i: got[i].taken for i in times} == {i: n * got[i]["size"] for i, n in times.items()}
        assert abs(sum(got[i].taken for i in times) - targets[s]) <= 0.01 * targets[s] + 1


# fingerprints and urls


def test_missing_and_hot_ids_are_parted(spark):
    rows = [(None, f"no id {k}") for k in range(300)] + [(7, f"again {k}") for k in range(900)] + [(k, f"text {k}") for k in range(100, 400)]
    docs = common.prepare(spark) and spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("h", F.xxhash64("text"))
    parts = docs.withColumn("part", fingerprint._ranges(docs, 6, 1 << 20)).groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h")).alias("low"), F.max(F.struct("doc_id", "h")).alias("high")).orderBy("part").collect()
    assert max(r.n for r in parts) <= 250
    key = lambda x: (x.doc_id is not None, x.doc_id or 0, x.h)
    assert all(key(a.high) <= key(b.low) for a, b in zip(parts, parts[1:]))


def test_bounds_in_two_steps(spark):
    bounds = sorted(random.Random(3).sample(range(1000), 77))
    got = spark.range(1000).select("id", fingerprint._below(bounds, F.col("id")).alias("n")).collect()
    assert all(r.n == sum(b <= r.id for b in bounds) for r in got)


def test_listing_comes_from_content(spark):
    pages = common.prepare(spark) and spark.createDataFrame([(1, "http://a.net/x?utm_source=1", "%%% ### *** $$$"), (2, "https://www.a.net/x/", "clean"), (3, "http://a.net/y", None), (4, None, "%%% ### ***")], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, url_filter.content_listing(pages, 3), []).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}
