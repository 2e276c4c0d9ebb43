"""Token ids, packed sequences and token files against the library and plain versions."""

from __future__ import annotations

import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import common, hashing, packing, token_files, tokens

ENCODER = tokens.encoder(tokens.default_vocabulary())


def check(texts):
    raw = [x.encode() for x in texts]
    assert [x.tolist() for x in ENCODER.encode_bytes(raw)] == [x.tolist() for x in ENCODER._whole(raw)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abc'sdtrveml 1²\n\t\r .,!-_é×łżñ中文　   \x1c\x85😀́<|>", max_size=60), max_size=8))
def test_encoder_equals_the_library(texts):
    check([*texts, "a <|endoftext|> b", "it's  we'll x", " lead", "trail ", "two  \n three", ""])


def test_encoder_on_plain_long_and_repeated_texts(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé'.,1") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    monkeypatch.setattr(hashing, "SLICE", 5_000)
    check(texts + texts + [" ".join(texts), "x" * 30_000, " " * 12_000, "\n" * 12_000 + "b", "a　 　 " * 4_000])


def test_encoder_forgets_and_tells_equal_hashes_apart(monkeypatch):
    texts = [f"some words {k} and more {k * 7919} of them" for k in range(400)]
    monkeypatch.setattr(tokens, "MEMO_PIECES", 50)
    check(texts)
    check(texts[::-1])
    monkeypatch.setattr(hashing, "mix", lambda x: x & np.uint64(1))
    check(texts)


def plain_best_fit(sizes, capacity):
    rooms = []
    for n in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - n)
    return sorted(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_bins_equal_plain_best_fit(sizes):
    got = packing.best_fit_decreasing(np.array(sizes, "i8"), 50)
    assert sorted(k for b in got for k in b) == list(range(len(sizes)))
    assert sorted(50 - sum(sizes[k] for k in b) for b in got) == plain_best_fit(sizes, 50)


@pytest.mark.parametrize("low, high", [(1, 60), (40, 60), (1, 4), (55, 100)])
def test_bins_of_the_tree_are_about_as_few_as_of_one_best_fit(spark, monkeypatch, low, high):
    """Also where a worker packs in many runs and where far more bins stay open than go up."""
    monkeypatch.setattr(packing, "RUN_PIECES", 50)
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(3000)]
    common.prepare(spark)
    pieces = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(5)
    got = packing.pack_pieces(pieces, 100, slack=0, fan_in=2).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert sorted(r.doc_id for r in got) == list(range(3000)) and max(by.values()) <= 100
    assert len(by) <= 1.06 * len(plain_best_fit(sizes, 100)) + 2


@pytest.mark.parametrize("shares", [1, 2, 5, 30])
def test_parts_of_a_file_are_its_documents(shares):
    rng = np.random.default_rng(4)
    out = io.BytesIO()
    writer = token_files.Writer(out)
    docs = [(None if k % 9 == 0 else k, rng.integers(0, 50_000, rng.integers(0, 3 * token_files.BLOCK)).astype("<u4")) for k in range(25)]
    for k, ids in docs:
        writer.add(k, ids.tobytes())
    writer.close()
    got = [x for share in range(shares) for x in token_files.read_file(out, len(out.getvalue()), share, shares)]
    assert [(k, ids.tolist()) for k, _, ids in got] == [(k, ids.tolist()) for k, ids in docs]
    assert [at for _, at, _ in got] == [0, *np.cumsum([len(x) for _, x in docs])[:-1].tolist()]


def test_a_seek_reads_only_the_blocks_of_the_part():
    out, read = io.BytesIO(), []
    writer = token_files.Writer(out)
    for k in range(40):
        writer.add(k, np.full(token_files.BLOCK, k, "<u4").tobytes())
    writer.close()

    class Watched(io.BytesIO):
        def read(self, n):
            read.append(n)
            return super().read(n)

    assert len(list(token_files.read_file(Watched(out.getvalue()), len(out.getvalue()), 3, 10))) == 4 and len(read) == 2 + 4


def test_repeated_and_missing_ids_are_parted(spark):
    common.prepare(spark)
    docs = spark.createDataFrame([(None, f"text number {k}") for k in range(200)] + [(7, f"again {k}") for k in range(200)], "doc_id long, text string").repartition(4)
    folder = f"{common.shared_dir(spark)}/parted"
    manifest = token_files.write_token_files(docs, folder, 2, files=8)
    assert manifest.where("n_docs > 0").count() >= 6
    got = token_files.read_token_files(manifest, folder, share_ids=300).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None] * 200 + [7] * 200
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
