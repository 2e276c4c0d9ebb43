"""The training-data operators against brute force, on odd inputs and on the small tables."""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import common, exact_dedup, fingerprint, mixing, near_dedup, packing, quality, queries, secrets, token_files, toxicity, url_filter
from siftline.llm.tokens import default_vocabulary, encoder

from ..conftest import SF

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, key string, node int, part int, tag long, size string"


def docs_of(spark, rows, sources=("a", "b", None), parts=3):
    data = [(i, t, "en", sources[k % len(sources)], None if t is None else len(t), 0.5, False, "k", 1, 2, 3, "s") for k, (i, t) in enumerate(rows)]
    return common.prepare(spark) and spark.createDataFrame(data, SCHEMA).repartition(parts)


def odd_rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    base = " ".join(rng.choice(words) for _ in range(120))
    near = base.split()
    near[60] = "changed"
    long_ = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(1, "Hello World ÄÖ one"), (2, "hello world ÄÖ one"), (3, None), (4, ""), (5, " \n\t"), (6, long_), (7, base), (8, " ".join(near)), (9, base.upper()), (10, "İstanbul ſecret: abcdefgh"), (None, "no id at all"), (None, None), (7, base), (11, "x"), (12, "a b"), (13, "a  b\n"), (14, base + " " + " ".join(rng.choice(words) for _ in range(90)))]
    return rows + [(100 + k, "the same text for many rows of this table") for k in range(40)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, odd_rows())


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


# exact dedup


def test_exact_groups(odd):
    got = exact_dedup.exact_groups(odd, keep="largest").collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest(), []).append(i)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    for ids, rs in ((groups[k], list(v)) for k, v in itertools.groupby(sorted(got, key=lambda r: r.text_sha256), lambda r: r.text_sha256)):
        assert sum(r.kept for r in rs) == 1
    assert exact_dedup.exact_kept(odd, keep="largest").count() == len(groups)
    assert exact_dedup.exact_kept(odd).columns == odd.columns


def test_merge_tells_texts_with_one_prefix_apart():
    e = np.zeros(4, exact_dedup.ENTRY)
    e["sha"][:, 0] = 7
    e["sha"][:, 3] = [2, 1, 2, 1]
    e["rank"], e["tag"], e["n"] = [5, 4, 3, 2], range(4), 1
    got = exact_dedup.merge_runs(e)
    assert sorted(zip(got["sha"][:, 3].tolist(), got["rank"].tolist(), got["n"].tolist())) == [(1, 2, 2), (2, 3, 2)]


def test_exact_many_partitions(spark):
    rows = [(k, f"text {k % 37}") for k in range(500)]
    got = exact_dedup.exact_groups(docs_of(spark, rows, parts=21)).collect()
    assert {r.doc_id: r.keep_id for r in got} == {k: k % 37 for k, _ in rows}


# quality and toxicity


@pytest.mark.parametrize("module, target, report", [(quality, "quality", quality.quality_report), (toxicity, "toxic", toxicity.toxicity_report)])
def test_classifiers_on_held_out_rows(spark, module, target, report):
    sf = SF.replace("0.001", "0.1")
    docs, labels = common.read(spark, sf, "documents"), common.read(spark, sf, "labels")
    got = {r.doc_id: r for r in report(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    held = [(getattr(r, target), got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    right = sum((y == 1) == (r.predicted == 1) for y, r in held)
    assert right >= 0.95 * len(held)
    ones, zeros = ([r.score for y, r in held if y == v] for v in (1, 0))
    assert np.mean([a > b for a in ones for b in zeros]) > 0.9


@pytest.mark.parametrize("report", [quality.quality_report, toxicity.toxicity_report])
def test_classifiers_on_odd_inputs(spark, odd, none, report):
    labels = spark.createDataFrame([(k, (k or 0) % 2, (k or 0) % 2) for k in [1, 2, 3, 4, 6, 7, 8, 9, None]], "doc_id long, quality int, toxic int")
    empty = labels.limit(0)
    for some in (labels, empty):
        got = report(odd, some).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
        assert report(none, some).count() == 0


def test_network_covers_the_whole_text():
    """A pattern counts wherever it stands, also across the bounds of chunks and segments."""
    rng = np.random.default_rng(1)
    net = quality.Net(rng.normal(size=(256, quality.EMBED)).astype("f4"), rng.normal(size=(64, quality.FILTERS)).astype("f4"), np.zeros(quality.FILTERS, "f4"), np.ones(2 * quality.FILTERS), 0.0)
    for n in (0, 1, 7, 8, 511, 513, quality.SEGMENT - 1, quality.SEGMENT + 5, 2 * quality.SEGMENT + 77):
        text = rng.integers(97, 123, n, "u1").tobytes()
        padded = np.frombuffer(text + bytes(16 + n % 2), "u1")
        brute = np.zeros(quality.FILTERS)
        for at in range(0, max(n, 1), quality.STRIDE):
            brute = np.maximum(brute, net.embed[padded[at : at + 8]].reshape(-1) @ net.filters)
        assert np.allclose(quality.features(net, [b"other text", text])[1, quality.FILTERS :], brute, atol=1e-3)


def test_deobfuscation():
    text = ["you are stupid and an idiot with trash talk", "the loser said stupid things", "a moron and a clown"] * 50
    counts = np.zeros(toxicity.SYMBOLS**3)
    for t in text:
        flat = toxicity._CODE[np.frombuffer(t.encode(), "u1")]
        counts += np.bincount((flat[:-2] * 28 + flat[1:-1]) * 28 + flat[2:], minlength=len(counts))
    r = toxicity.Restorer(toxicity.log_model(counts.reshape((28,) * 3)))
    for written, meant in (("1d10t", "idiot"), ("$tup1d", "stupid"), ("stuuupid", "stupid"), ("m0r0n!!!", "moron"), ("tr@sh", "trash"), ("hello", "hello"), ("ered***", "ered")):
        assert r.word(written) == meant
    assert {"stupid", "idiot"} <= r.words("such S T U P I D words, 1.d.1.0.t indeed")


def test_deobfuscation_has_no_length_limits():
    text = ["you are such a stupid idiot and your talk is trash", "the loser said stupid things", "what an ass you are", "a moron and a clown"] * 50
    counts = np.zeros(toxicity.SYMBOLS**3)
    for t in text:
        flat = toxicity._CODE[np.frombuffer(t.encode(), "u1")]
        counts += np.bincount((flat[:-2] * 28 + flat[1:-1]) * 28 + flat[2:], minlength=len(counts))
    r = toxicity.Restorer(toxicity.log_model(counts.reshape((28,) * 3)))
    sentence = "you are such a stupid idiot and your talk is trash and you are a moron"
    letters = " ".join(sentence.replace(" ", "")).replace("o", "0")
    assert len(letters) > 80 and {"stupid", "idiot", "trash", "moron"} <= r.words(letters)
    assert {"stupid", "idiot", "trash"} <= r.words(sentence.replace(" ", "-").replace("i", "1"))
    assert r.words("st" + "u" * 70 + "pid") == {"stupid"} and "stupid" in r.words("s t " + "u " * 50 + "p i d")
    assert "ass" in r.words("what an @$$ you are") and "ass" in r.words("what an a s s !") and "ass" in r.words("@ $ $")
    assert r.words("2024 500") == {"2024", "500"}
    assert r.words("x" + "ab1" * 50_000) and r.words("ab" * 200_000)


def test_words_that_signs_join_are_words():
    text = ["you are such a stupid idiot and your talk is trash", "the loser said stupid things of a person", "a moron and a clown"] * 50
    counts = np.zeros(toxicity.SYMBOLS**3)
    for t in text:
        flat = toxicity._CODE[np.frombuffer(t.encode(), "u1")]
        counts += np.bincount((flat[:-2] * 28 + flat[1:-1]) * 28 + flat[2:], minlength=len(counts))
    r = toxicity.Restorer(toxicity.log_model(counts.reshape((28,) * 3)))
    known = frozenset({"stupid", "idiot"})
    for joint in (".", "-", "_", "...", "/", ","):
        for words in (["you", "are", "stup1d"], ["such", "a", "stup1d", "person"], ["such", "a", "stupid", "person", *["and", "so", "on"] * 30]):
            assert "stupid" in r.words(joint.join(words)), (joint, words)  # of any length
    assert "stupid" in r.words("such.a.s.t.u.p.1.d.person", known) and "stupid" in r.words("a-s-t-u-p-1-d", known)
    assert {"stupid", "idiot"} <= r.words("y o u a r e s t u p 1 d a n d a n i d 1 0 t", known)
    assert "stupid" not in r.words("astupidity is.no.word s o m e", known)
    assert r.words("1.5 2024-05-01") == {"1.5", "2024-05-01"}


def test_texts_with_one_common_word_are_different_texts(spark):
    """Whatever word hashes lowest: 40 texts of each label that share 60 words; near copies count once."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    low = min((word() for _ in range(50_000)), key=lambda w: (zlib.crc32(w.encode()) * 0x9E3779B1 + zlib.adler32(w.encode())) & 0x7FFFFFFF)
    common_words = [low, *(word() for _ in range(59))]
    rows = [(k, " ".join([*common_words, *(["badword"] if k % 2 else []), *(word() for _ in range(60))])) for k in range(100)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    assert set(toxicity.fit(docs_of(spark, rows), labels).weights) == {"badword"}
    base = rows[1][1].split()
    rows = [(k, " ".join([*base[:-1], word()])) if k % 2 else (k, t) for k, t in rows]
    assert not toxicity.fit(docs_of(spark, rows), labels).weights
    a, b, c = (toxicity.minima(sorted(set(x.split()))) for x in (rows[1][1], rows[3][1], rows[2][1]))
    assert toxicity.like_sets(np.array([c, a, b])) == [0, 1, 1]


# fingerprints


def brute_winnow(text):
    b, k, w = text.encode(), fingerprint.K, fingerprint.WINDOW
    if not b:
        return []
    turned = lambda x, n: ((x << n) | (x >> (64 - n))) & (2**64 - 1) if n else x
    hs = [functools.reduce(operator.xor, (turned(xxhash.xxh64_intdigest(b[i + j : i + min(j + 4, k)], seed=42), k // 4 - 1 - j // 4) for j in range(0, k, 4))) for i in range(max(1, len(b) - k + 1))]
    signed = [(h - (1 << 64) if h >> 63 else h) >> 8 for h in hs]
    out = {}
    for i in range(max(1, len(hs) - w + 1)):
        pos = min(range(i, min(i + w, len(hs))), key=lambda j: (signed[j], -j))
        out[pos] = hs[pos] >> 32
    return sorted(out.items())


def test_fingerprints(spark, odd, none):
    rows = sorted([r for r in odd_rows() if r[0] not in (7, 6, None)], key=lambda r: r[0])
    got = {r.doc_id: r for r in fingerprint.winnowing_report(docs_of(spark, rows), ranges=4).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        own, other, nxt = ({v for _, v in brute_winnow(x)} for x in (t, edited, after))
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == " ".join(f"{a:x}:{b:x}" for a, b in brute_winnow(t))
        assert r.edited_fingerprint == " ".join(f"{a:x}:{b:x}" for a, b in brute_winnow(edited))
        assert abs(r.near_edited - like(own, other)) < 1e-12 and abs(r.near_next - like(own, nxt)) < 1e-12
    assert fingerprint.winnowing_report(odd).count() == len(odd_rows())
    assert fingerprint.winnowing_report(none).count() == 0
    assert fingerprint.winnowing_report(odd.where("doc_id = 11")).first().near_next == 1.0
    plan = fingerprint.winnowing_report(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_match_guarantee(spark):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = noise(fingerprint.K + fingerprint.WINDOW - 1)
    rows = [(k, noise(rng.randint(50, 400)) + shared + noise(rng.randint(50, 400))) for k in range(6)]
    prints = [set(brute_winnow_values(r.fingerprint)) for r in fingerprint.winnowing_report(docs_of(spark, rows)).collect()]
    assert all(a & b for a, b in itertools.combinations(prints, 2))


def brute_winnow_values(written):
    return [x.split(":")[1] for x in written.split()]


# near dedup


def brute_components(rows, percent=85):
    reps, root = {}, {}
    for k, (_, t) in enumerate(rows):
        reps.setdefault(shingles(t), k)
        root[k] = k

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (_, t) in enumerate(rows):
        if shingles(t):
            root[find(k)] = find(reps[shingles(t)])
    for (s, a), (t, b) in itertools.combinations(reps.items(), 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            root[find(a)] = find(b)
    return [find(k) for k in range(len(rows))]


def test_near_groups(odd, none):
    rows = odd_rows()
    comp = brute_components(rows)
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min(least.get(c, np.inf), np.inf if i is None else i)
    want = sorted((repr(i), len(shingles(t)), repr(None if least[c] == np.inf else least[c])) for (i, t), c in zip(rows, comp))
    got = near_dedup.near_groups(odd).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == want
    texts = {t for (_, t), c in zip(rows, comp) if not shingles(t)}
    full = {c for (_, t), c in zip(rows, comp) if shingles(t)}
    assert sum(r.kept for r in got if r.n_shingles) == len(full)
    assert near_dedup.near_kept(odd).where("length(trim(text)) > 0").count() >= len(full) and texts
    assert near_dedup.near_groups(none).count() == 0


def test_near_groups_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 20)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            at, n = rng.randrange(len(w)), rng.randint(1, 6)
            w[at : at + n] = [f"n{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 6))]
        rows.append((k, " ".join(w)))
    comp = brute_components(rows)
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min(least.get(c, i), i)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs_of(spark, rows, parts=5)).collect()}
    assert got == {i: least[c] for (i, _), c in zip(rows, comp)}


def test_near_kept_links_from_the_percent_given(spark):
    """Pairs of similarity 0.8 to 0.84 lose one document at 80 percent, none below 0.8; at 85 both stay."""
    rng, rows, near = random.Random(12), [], 0
    for k in range(200):
        n = rng.choice((33, 36, 40, 45))
        a = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        b = a[: 200 - n // 2] + [f"v{rng.randint(0, 10**6)}" for _ in range(n // 2)]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        s, t = shingles(rows[-2][1]), shingles(rows[-1][1])
        assert 100 * len(s & t) < 85 * len(s | t)
        near += 100 * len(s & t) >= 80 * len(s | t)
    docs = docs_of(spark, rows, parts=4)
    assert 0 < near < 200 and near_dedup.near_kept(docs, percent=80).count() == 400 - near
    assert near_dedup.near_kept(docs).count() == 400
    assert (near_dedup.Banding(85).side, near_dedup.Banding(85).hashes, near_dedup.Banding(80).side) == (9, 54, 11)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.label for r in near_dedup.components(edges).collect()} == {k: 0 for k in range(41)} | {100: 100, 101: 100}


# urls


def test_urls(spark):
    urls = ["http://A.Example.org/es/1", "http://example.org/en/12", "https://x.com/fr/a?b", "https://x.com/de/", "http://bad.net/a/", "https://www.bad.net/a?utm_source=1#f", "http://bad.net:80/a?x=1", None, "", "no scheme", "http://org", "http://éx.NET?q", "a://b://c/d", "http://good.net/" + "p" * 70_000, "http://bad.net/a/"]
    pages = common.prepare(spark) and spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, canonical string")
    listed = spark.createDataFrame([("https://bad.net/a",), (None,), ("junk",)], "url string")
    for most in (8 << 20, 0):
        got = {r.page_id: r for r in url_filter.judge_urls(pages, listed, queries.URL_RULES, broadcast_bytes=most).collect()}
        assert len(got) == len(urls)
        assert [got[k].rule for k in range(4)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/"]
        assert [got[k].verdict for k in range(4, 15)] == ["block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "block"]
        assert (got[7].host, got[9].path, got[10].host, got[10].path, got[11].host, got[12].host) == ("", "", "org", "", "éx.net", "b:")
    assert url_filter.judge_urls(pages.limit(0), listed.limit(0), queries.URL_RULES).count() == 0


# packing and token files


def test_packing(spark, odd, none):
    got = packing.best_fit_packing(odd).collect()
    rows = odd_rows()
    ids = encoder(default_vocabulary()).tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want = []
    for (i, _), e in zip(rows, ids):
        a = [*e.ids, 0]
        first = len(a) % 2048 or 2048 if len(a) > 2048 else len(a)
        cuts = [0, *range(first, len(a) + 1, 2048)] if len(a) > 2048 else [0, len(a)]
        want += [(repr(i), k, s, t - s, zlib.crc32(np.array(a[s:t], "<u4").tobytes())) for k, (s, t) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    for _, rs in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in rs:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.best_fit_packing(none).count() == 0


def test_packing_merges_what_is_left(spark):
    sizes = [random.Random(k).randint(1, 60) for k in range(4000)]
    pieces = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(70)
    got = packing.pack_pieces(pieces, 100, slack=0).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in got) <= 100 and len(got) <= 1.02 * sum(sizes) / 100 + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60_000), st.integers(0, 2**32 - 1)), min_size=1, max_size=400))
def test_blocks_round_trip(ids):
    a = np.array(ids, "<u4")
    assert np.array_equal(token_files.unpack_block(token_files.pack_block(a)), a)


def test_token_files(spark, odd, none):
    got = token_files.token_file_digest(odd, files=4).collect()
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [i for i, _ in rows]
    ids = encoder(default_vocabulary()).tokenizer
    want = {repr((i, (e := ids.encode(t or "", add_special_tokens=False).ids + [2])[:3], len(e), zlib.crc32(np.array(e, "<u4").tobytes()))[0:1] + (len(e), zlib.crc32(np.array(e, "<u4").tobytes()))) for i, t in rows}
    assert {repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got} == want
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert token_files.token_file_digest(none).count() == 0


def test_word_encoder_equals_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é'sdt1\n\t .,!ł") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a <|endoftext|> b", "it's  we'll\u00a0x"]
    e = encoder(default_vocabulary())
    assert e.encode(texts) == e._ids(texts)


# secrets


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate([("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]):
        for m in re.compile(pattern, re.A).finditer(text):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_secrets(spark, odd, none):
    hexes, far = "0123456789abcdef" * 2, " filler" * 100
    texts = ["é Password = 'abc123x' and token: short", "AKIA" + "Z9" * 10 + " AKIA1 " + hexes, "login = bob7 at https://db.example.net/x " + far, "login=bob7 https://db.example.net token=Ab3dEf9hIjKlMnOpQr", "api-key: no, API_KEY:\"longenough\" apikey==x", hexes[:23], "9f" * 12 + "g", "Zx9Kq2Lm4Np6Rs8Tv0Wy1 alone" + far, "", None, "secret:" + "a" * 100_000]
    got = {r.doc_id: r for r in secrets.scan_secrets(docs_of(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        want = brute_base(t or "")
        assert got[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(x.startswith(p) for x in want) for p in ("assign", "access", "hex")]
        assert set(want) <= set(got[k].spans.split(",")) | {""}
    assert "weak_access" in got[2].spans and "endpoint" in got[2].spans  # a login beside an endpoint
    assert got[7].spans == ""  # a mixed token alone
    assert secrets.scan_secrets(odd).count() == len(odd_rows()) and secrets.scan_secrets(none).count() == 0


def test_parts_of_one_url_do_not_confirm_each_other(spark):
    url, far, mixed = "https://example.com/news/2024/05/some-long-article-title", " filler" * 100, "Zx9Kq2Lm4Np6Rs8Tv0Wy1"
    texts = [f"see {url} for more", f"{url}{far}{url}", f"login=bob7 {url}", f"https://x.example.net/v1?key={mixed}", f"https://bob:{mixed}@x.example.net/v1", f"account={mixed}", f"{url} {mixed}", f"{url} {url}/two"]
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(docs_of(spark, list(enumerate(texts)))).collect()}
    assert got[0] == got[1] == got[5] == got[7] == ""
    assert "weak_access" in got[2] and "endpoint" in got[2]
    assert all("weak_secret" in got[k] and "endpoint" in got[k] for k in (3, 4, 6))


# mixing


def test_mixing(spark, none):
    rng = random.Random(8)
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 60)))) for k in range(3000)]
    sources = tuple(["hot"] * 5 + ["b", "c", None])
    docs = docs_of(spark, rows, sources)
    got = mixing.mix_report(docs, block_words=500).collect()
    again = mixing.mix_report(docs.repartition(7), block_words=500).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    by = {}
    for r in got:
        assert r["size"] == len(rows[r.doc_id][1].split()) and r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        s = by.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r.taken
        s[1] += r["size"]
    assert len(by) == 4
    for (size, target), (taken, total) in by.items():
        assert size == total and abs(taken - target) <= 30 and target <= 3 * size + 1e-6
    mixed = mixing.mixed_documents(docs, block_words=500)
    assert mixed.columns == docs.columns
    times = {r.doc_id: r.n for r in mixed.where("text <> ''").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert times == {r.doc_id: r.taken // r["size"] for r in got if r.taken}
    assert mixing.mix_report(none).count() == 0 and mixing.mixed_documents(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_mixing_meets_targets_beside_a_very_long_document(spark, seed):
    """A small source of 300 short documents, a very long one and a repeated row; the miss is less than a short document."""
    rows = [(k, "w " * 400) for k in range(300)] + [(300, "v " * 60_000)] + [(301, "u " * 40)] * 9
    rows += [(1000 + k, "x " * 400) for k in range(450)] + [(5000, "y " * 9_000)]
    docs = common.prepare(spark) and spark.createDataFrame([(i, t, "a" if i < 1000 else "b") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    by = {}
    for r in mixing.mix_report(docs, seed=seed).collect():
        by[r.target] = by.get(r.target, 0) + r.taken
    assert len(by) == 2 and all(abs(taken - target) <= 400 for target, taken in by.items())
    assert sum(r.n * r.size for r in mixing.mixed_documents(docs, seed=seed).groupBy("doc_id", F.regexp_count("text", F.lit("[a-z]")).alias("size")).agg(F.count("*").alias("n")).collect()) == sum(by.values())


def test_fill():
    assert mixing.fill([60, 4, 4, 4], 12) == [1, 2, 3]
    assert mixing.fill([4, 60, 4, 4, 3], 15) == [0, 2, 3, 4]
    assert mixing.fill([5, 60, 9], 13) == [0, 2] and mixing.fill([5, 4, 13, 9], 14) == [0, 3] and mixing.fill([30], 13) == [] and mixing.fill([], 5) == []


def test_mixing_odd_rows(odd):
    got = mixing.mix_report(odd).collect()
    assert len(got) == len(odd_rows()) and all(r.taken <= 3 * r["size"] for r in got)


def test_splitting_tree_keeps_quotas():
    quotas = [1000, 3, 0, 77, 450]
    out = mixing.split_quotas(quotas, 13, 5)
    assert out.sum(0).tolist() == quotas and np.ptp(out.sum(1)) <= 13 and (out >= 0).all()
    assert (out == mixing.split_quotas(quotas, 13, 5)).all()


def test_water_fill():
    assert mixing.water_fill([100, 100], [1, 3], 3) == [50, 150]
    got = mixing.water_fill([10, 1000, 0], [3, 1, 1], 3)
    assert got[0] == 30 and got[2] == 0 and abs(sum(got) - 1010) < 1e-9
    assert mixing.water_fill([], [], 3) == []


# queries and pipeline


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, db, name):
    got = queries.queries()[name](spark, SF)
    want = db.sql(queries.oracle_sql()[name])
    plain = lambda rows: sorted(repr(tuple(r)) for r in rows)
    cols = sorted(got.columns)
    assert plain(got.select(*cols).collect()) == plain(want.select(*cols).fetchall())


def test_pipeline_stages(spark):
    docs = common.read(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources", "best-fit packing"]
    step = lambda name, d: common.written(spark, stages[name](spark, d, SF), "test")
    good = step("quality classifier", docs)
    kept = {r.doc_id for r in quality.quality_report(docs, common.read(spark, SF, "labels")).where("predicted = 1").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    unique = step("exact dedup", good)
    last = {}
    for r in good.collect():
        key = r.text.translate(LOWER)
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(last.values())
    apart = step("MinHash near-dedup", unique)
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    comp = brute_components(rows, 80)
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min(least.get(c, i), i)
    assert sorted(r.doc_id for r in apart.collect()) == sorted(least.values())
    mixed = step("mixing sources", apart)
    times = {r.doc_id: r.taken // r["size"] for r in mixing.mix_report(apart).collect() if r.taken}
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == times
    packed = step("best-fit packing", mixed)
    assert packed.where("piece = 0").count() == mixed.count()


def test_pipeline_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = common.written(spark, stage(spark, docs, SF), "odd")
            assert name == "best-fit packing" or "score" in docs.columns
