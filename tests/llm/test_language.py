"""Language identification: the best path against all paths, held-out texts, scripts, mixed texts and odd inputs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import common, language

from ..conftest import SF

ENGLISH = "the cat and the dog went to the house with a friend and they saw that it was good for them to be there"
GERMAN = "der hund und die katze gingen in das haus mit einem freund und sie sahen dass es gut war dort zu sein"
GREEK = "ο σκύλος και η γάτα πήγαν στο σπίτι με έναν φίλο και είδαν ότι ήταν καλό να είναι εκεί"
RUSSIAN = "собака и кошка пошли в дом с другом и увидели что там хорошо быть и жить вместе"


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    texts = [(lang, " ".join(rng.sample(text.split(), 12))) for lang, text in (("en", ENGLISH), ("de", GERMAN), ("el", GREEK), ("ru", RUSSIAN)) for _ in range(30)]
    docs = spark.createDataFrame([(k, text, lang) for k, (lang, text) in enumerate(texts)], "doc_id long, text string, lang string")
    return language.fit(common.prepare(spark) and docs, F.lit(True))


def _value(scores, prior, penalty, path):
    return int(prior[path[0]]) + sum(int(scores[t][k]) for t, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def _path(spans):
    return [k for a, b, k in spans for _ in range(a, b)]


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_best_path_against_all_paths(block):
    rng = np.random.default_rng(block)
    for _ in range(150):
        n, k, penalty = int(rng.integers(1, 7)), int(rng.integers(1, 4)), int(rng.integers(0, 6))
        scores, prior = rng.integers(-5, 6, (n, k)).astype("i4"), rng.integers(-3, 1, k)
        spans = language.label(scores, prior, penalty, block)
        assert [a for a, _, _ in spans] == [0, *(b for _, b, _ in spans[:-1])] and spans[-1][1] == n
        best = max(_value(scores, prior, penalty, p) for p in itertools.product(range(k), repeat=n))
        assert _value(scores, prior, penalty, _path(spans)) == best


def test_many_changes_and_blocks_agree():
    rng = np.random.default_rng(3)
    scores, prior = rng.integers(-900, 900, (4000, 5)).astype("i4"), np.zeros(5, "i8")
    for penalty in (1, 300, 5000):
        whole = language.label(scores, prior, penalty)
        value = _value(scores, prior, penalty, _path(whole))
        plain = prior.astype("i8") + scores[0]
        for row in scores[1:]:
            plain = np.maximum(plain, plain.max() - penalty) + row
        assert value == plain.max() == _value(scores, prior, penalty, _path(language.label(scores, prior, penalty, 64)))


def test_held_out_texts(spark):
    got = language.language_report(common.read(spark, "/root/testdata/sf0.01", "documents")).where("held_out").join(common.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.99 * n


def test_only_text_decides(spark):
    docs = common.read(spark, SF, "documents").limit(200)
    other = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("?")).repartition(3)
    a, b = (sorted(language.language_report(d).collect()) for d in (docs, other))
    assert a == b


def test_scripts_narrow_candidates(model):
    assert model.languages == ["de", "el", "en", "ru"]
    scores = language.word_scores(model, ["house", "σπίτι", "дом", "日本", "aσ"])
    foreign = -language.FOREIGN * language.UNIT
    assert (scores[0][[1, 3]] == foreign).all() and (scores[0][[0, 2]] > foreign).all()
    assert (scores[1][[0, 2, 3]] == foreign).all() and scores[2].argmax() == 3
    assert (scores[3] == 0).all()  # no language's script
    assert (scores[4][[0, 1, 2]] > foreign).all() and scores[4][3] == foreign


def test_mixed_texts_are_cut_into_spans(spark, model):
    parts = [("en", ENGLISH), ("de", GERMAN), ("el", GREEK), ("en", ENGLISH)]
    text = ". ".join(t for _, t in parts)
    docs = spark.createDataFrame([(1, text), (2, GREEK + "! " + RUSSIAN[:20])], "doc_id long, text string")
    got = {r.doc_id: r for r in language.label_languages(docs, model).collect()}
    spans = got[1].spans
    assert [s.lang for s in spans] == ["en", "de", "el", "en"] and spans[0].start == 0 and spans[-1].end == len(text)
    assert all(a.end == b.start for a, b in zip(spans, spans[1:]))
    at = text.index(GREEK)
    assert abs(spans[2].start - at) <= 4 and text[spans[2].start : spans[2].end].strip(". ").startswith("ο σκύλος")
    assert got[1].lang_pred == "en" and 0.3 < got[1].score < 0.7
    assert [s.lang for s in got[2].spans] == ["el", "ru"] and got[2].lang_pred == "el"


def test_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "123 ... ²²  _"), (4, "日本"), (5, GERMAN + " x" * 300_000), (6, GERMAN), (6, GERMAN), (None, ENGLISH), (7, "İİ " + ENGLISH), (8, "a" * 500_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, spans string").repartition(4)
    got = language.label_languages(docs, model, names=("l", "s", "p"))
    assert got.columns == [*docs.columns, "l", "s", "p"]
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert len(got.collect()) == len(rows)
    for text in (None, "", "123 ... ²²  _"):
        r = next(v for k, v in by.items() if k[1] == text)
        assert (r.l, r.s, r.p) == ("und", 0.0, [])
    assert by[6, GERMAN].l == "de" and by[None, ENGLISH].l == "en" and by[7, "İİ " + ENGLISH].l == "en" and by[4, "日本"].l in model.languages
    assert all(0 <= r.s <= 1 for r in by.values())
    assert language.label_languages(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")
    got = language.language_report(docs).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)} and len(got) == 2
    one = language.fit(spark.createDataFrame([(1, "some words", "en")], docs.schema), F.lit(True))
    assert language.label_languages(docs, one).where("doc_id = 1").first().lang_pred == "en"


def test_sample_is_bounded_and_the_same_however_dealt(spark):
    docs = spark.createDataFrame([(k, f"word{'abcdefgh'[k % 8]} {ENGLISH}", "en" if k % 3 else "de") for k in range(900)], "doc_id long, text string, lang string")
    a, b = (language.fit(d, F.lit(True), sample_bytes=20_000) for d in (docs, docs.repartition(7)))
    assert (a.table == b.table).all() and (a.prior == b.prior).all()
    assert len(language.fit(docs, F.lit(True), most_languages=1).languages) == 1


def test_words_are_forgotten_within_bounds(model, monkeypatch):
    texts = [f"{ENGLISH} {''.join(random.Random(k).choices('abcdefgh', k=9))}" for k in range(50)]
    want = [next(language.Labeller(model).texts([t])) for t in texts]
    monkeypatch.setattr(language, "KNOWN", 3000)
    small = language.Labeller(model)
    assert [next(small.texts([t])) for t in texts] == want and len(small.number) < 60
