"""JSON in answers: inner quotes, fences, cut-off texts, and what is JSON already."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from siftline.functions import answers as J


def _all(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", f(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_unescaped_quotes_in_a_review(spark):
    text = """prefix
```json
{
  "doi": "10.1/x",
  "result": "低风险",
  "trigger": "fine",
  "image_review": "pictures in order",
  "data_review": "the text says "the ratio of supplies stays", which is the model's trait.",
  "ref_review": "",
  "verdict": "建议低风险",
  "reason": "can be explained"
}
```
"""
    r = _all(spark, J.review_fields, [text])[0]
    assert r.result == "低风险" and r.data_review == 'the text says "the ratio of supplies stays", which is the model\'s trait.'
    assert r.methodology_review == "" and r.reason == "can be explained" and r.doi == "10.1/x"


def test_results_that_are_none_and_missing_verdicts(spark):
    texts = ['{"result": "maybe", "reason": "a "b" c"}', '{"reason": "a "b" c"}', "no braces", None, "", '{"result": "高风险", "reason": "so "it" is', '{"result":"高风险"}']
    got = _all(spark, J.review_fields, texts)
    assert got[:5] == [None] * 5
    assert got[5].verdict == "建议高风险" and got[5].reason == 'so "it" is' and got[6].reason == ""


def test_what_is_json_stays_as_it_is(spark):
    rng = random.Random(2)
    value = lambda d: rng.choice([lambda: rng.choice(['a "b" c', "x", "", "{", "}]", "\\", "a,b", 'say ": ', "line\nend", "漢"]), lambda: rng.randrange(9), lambda: None, lambda: True, *([lambda: [value(d - 1) for _ in range(rng.randrange(3))], lambda: {rng.choice("abc") * (k + 1): value(d - 1) for k in range(rng.randrange(3))}] if d else [])])()
    objects = [{"k": value(3), "z": value(2)} for _ in range(120)]
    texts = [json.dumps(x, ensure_ascii=rng.random() < 0.5) for x in objects]
    assert [json.loads(x) for x in _all(spark, J.json_in, [f"so {t} it is" for t in texts])] == objects
    assert [json.loads(x) for x in _all(spark, J.repaired_json, [f"so {t}, {{more}} it is" for t in texts])] == objects


def test_inner_quotes_against_what_was_meant(spark):
    rng = random.Random(6)
    pieces = ['"yes"', 'then "no", "never"', "plain", '"a": 5', "{x}", "[1, 2]", "said, he", '"', "end.", "two\nlines"]
    objects = [{"first": " ".join(rng.choices(pieces, k=3)) + " and", "list": ["one", "two"], "in": {"second": "so " + " ".join(rng.choices(pieces, k=2)) + "."}, "n": 3} for _ in range(150)]
    raw = lambda s: '"' + s + '"'
    texts = ['{"first": ' + raw(o["first"]) + ', "list": ["one", "two"], "in": {"second": ' + raw(o["in"]["second"]) + '}, "n": 3}' for o in objects]
    assert [json.loads(x) for x in _all(spark, J.repaired_json, texts)] == objects


def test_ends(spark):
    texts = ['{"a": "x",}', '{"a": ["x", "y",]}', '{"a": "x", "b": [1, {"c": "d', '{"a": "x", ', '{"a": "b"} and "more" {"c": 1}', "{}", '{"a": "tail\\\\"}', "x {broken"]
    got = _all(spark, J.repaired_json, texts)
    assert [json.loads(x) for x in got[:7]] == [{"a": "x"}, {"a": ["x", "y"]}, {"a": "x", "b": [1, {"c": "d"}]}, {"a": "x"}, {"a": "b"}, {}, {"a": "tail\\"}]
    assert _all(spark, J.json_in, texts[-1:]) == [None]
