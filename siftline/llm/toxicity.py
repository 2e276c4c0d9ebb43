"""Toxicity by noisy-channel deobfuscation.

Written words may be disguised: digits and signs for letters, letters set apart, letters repeated. Each such
word is a lattice of what its characters may stand for; the Viterbi path under a character trigram model of
the whole corpus restores it, however long it is. Where signs join several words, the words between them are restored
one by one; where letters are set apart, the path also chooses the word borders, and the letters without borders are
searched for the words that count. Learned word weights then score the restored text.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Log chances of the channel: a sign for a letter, a sign for any letter, a sign between letters, a letter said again.
SWAP, ANY, APART, AGAIN = -1.0, -4.0, -0.4, -0.4
BORDERS = (APART, APART + 1, APART + 2)  # a sign for a word's end: as likely as none, and favoured, as the model may miss one
MOST = 30.0
SYMBOLS = 28  # boundary, a to z, any other letter
REMEMBERED = 160  # code points of a token that is remembered; a longer one is restored each time
HIDDEN = 4  # letters of a word that is looked for in letters without borders

MINIMA, LIKE = 64, 0.8  # near copies: texts of which so large a share of so many smallest word hashes are equal
_MUL = np.random.default_rng(6).integers(0, 2**63, MINIMA, "u8") * np.uint64(2) + np.uint64(1)

_CODE = np.zeros(256, "i8")
_CODE[ord("a") : ord("z") + 1] = _CODE[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CODE[128:] = 27
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+*])(?:[ .\-_*](?:[^\W_]|[@$!|+*])){2,}(?!\S)")
_SINGLE = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+*])(?:[.\-_](?:[^\W_]|[@$!|+*])){3,}(?![^\W_])")  # single letters within a token
_EDGES = re.compile(r"^[^\w@$!|+(]+|([^\w@$])\1*$|[^\w@$]+$")
_NOISE = re.compile(r"([^\w\s])\1{2,}")  # a sign three times over is an ornament
_LETTER, _AFTER, _BEFORE, _THRICE = re.compile("[a-z]"), re.compile(r"[0-9@$!|+(*.\-_€]"), re.compile("[0-9@$!|+(*€]"), re.compile(r"([a-z])\1\1")
_JOINTS = re.compile(r"[^\w@$!|+(*€]+|_+")  # signs that may stand between words
_SIGNS = re.compile(r"[0-9*.\-_]*[@$!|+(€](?:[0-9@$!|+(*.\-_€]*[0-9@$!|+(€])?")  # no letter, and not a number alone


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each three symbols follow each other in all texts of ``docs``; the result's size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, "i8")
        for batch in batches:
            flat = _CODE[np.frombuffer("\n".join(x or "" for x in batch.column(0).to_pylist()).encode(), "u1")]
            if len(flat) > 2:
                total += np.bincount((flat[:-2] * SYMBOLS + flat[1:-1]) * SYMBOLS + flat[2:], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3)
    for r in rows:
        out[r.gram] = r.n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), mixed with P(third | second) and P(third)."""
    third = (counts.sum((0, 1)) + 1) / (counts.sum() + SYMBOLS)
    two = counts.sum(0)
    second = (two + 8 * third) / (two.sum(1, keepdims=True) + 8)
    return np.log((counts + 8 * second[None]) / (counts.sum(2, keepdims=True) + 8)).astype("f4")


def _odd(word: str) -> bool:
    """Letters before or after signs, or a letter three times."""
    letter, sign = _LETTER.search(word), _BEFORE.search(word)
    return bool((letter and _AFTER.search(word, letter.end())) or (sign and _LETTER.search(word, sign.end())) or _THRICE.search(word))


def lattice(word: str, border: float | None = None, again: bool = True) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for ("" for nothing), with the channel's log chance.

    With ``border``, its log chance, a sign between letters may also be a word's end, and letters repeat across such
    signs. Without ``again`` all repeats stay.
    """
    out, before = [], ""
    for c in word:
        if c.isalpha() and c not in LEET:
            options = [(c, 0.0)] + ([("", AGAIN)] if again and c == before else [])
        elif c in LEET:
            options = [(x, SWAP) for x in LEET[c]] + ([("", AGAIN)] if again and c == before else [])
        elif c == "*":
            options = [(x, ANY) for x in "abcdefghijklmnopqrstuvwxyz"] + [("", APART)]
        else:
            options = [("", APART)] + ([(" ", border)] if border is not None else [])
        out.append(options)
        if border is None or c == "*" or c.isalnum() or c in LEET:
            before = c
    return out


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27


def viterbi(word: str, model: np.ndarray, border: float | None = None, again: bool = True) -> str:
    """The likeliest letters behind ``word``: best path through its lattice under the character model."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(word, border, again):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, said) in best.items():
            for letter, cost in options:
                if letter:
                    c = _symbol(letter)
                    to, s, t = (b, c), score + cost + float(model[a, b, c]), (said, letter)
                else:
                    to, s, t = (a, b), score + cost, said
                if to not in after or s > after[to][0]:
                    after[to] = (s, t)
        best = after
    said, out = max(((score + float(model[a, b, 0]), said) for (a, b), (score, said) in best.items()), key=lambda x: x[0])[1], []
    while said:
        said, letter = said
        out.append(letter)
    return "".join(reversed(out))


@dataclass
class Restorer:
    """Restores words; remembers what it has met, up to a bound."""

    model: np.ndarray
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def word(self, token: str) -> str:
        word = _EDGES.sub("", _NOISE.sub(" ", token).strip())
        if _odd(word) or _SIGNS.fullmatch(word):
            return viterbi(word, self.model)
        return word.strip("!|+(@$")

    def parts(self, run: str) -> list[str]:
        """The words of letters that signs set apart or join: all as one, and between the likeliest borders."""
        return [viterbi(run, self.model), *(w for border in BORDERS for w in viterbi(run, self.model, border).split())]

    def said(self, token: str) -> tuple[str, ...]:
        """What a token may say: a word; of signs alone also with all repeats, and what is left without them; if signs
        join several words, all as one word, each of them, and those that single letters make."""
        word = _EDGES.sub("", _NOISE.sub(" ", token).strip())
        if _SIGNS.fullmatch(word):
            return self.word(token), viterbi(word, self.model, again=False), word.strip("!|+(@$")
        pieces = [x for x in _JOINTS.split(word) if x]
        if len(pieces) < 2:
            return (self.word(token),)
        out = [self.word(token)]
        for single, run in itertools.groupby(pieces, lambda x: len(x) == 1):
            run = list(run)
            if not single:
                out += (self.word(x) for x in run if not x.isdigit())
            elif len(run) > 2:
                out += self.parts(".".join(run))
        return tuple(dict.fromkeys(out))

    def words(self, text: str, known: frozenset[str] = frozenset()) -> set[str]:
        """The distinct restored words of a text, with those of ``known`` that stand in letters set apart."""
        low = text.lower()
        tokens = set(low.split())
        if len(self.memo) > 500_000:
            self.memo.clear()
        memo = self.memo
        out = set()
        for x in tokens:
            said = memo.get(x)
            if said is None:
                said = self.said(x)
                if len(x) <= REMEMBERED:
                    memo[x] = said
            out.update(said)
        apart = [m[0] for m in _SPACED.finditer(low)] + [m[0] for x in tokens for m in _SINGLE.finditer(x)]
        for run in apart:
            said = self.parts(run)
            out.update(said)
            out.update(w for w in known if w in said[0])
        out.discard("")
        return out


@dataclass
class Model:
    letters: np.ndarray
    weights: dict[str, float]
    slope: tuple[float, float]
    offset: float

    def hidden(self) -> frozenset[str]:
        """The words that are looked for in letters without borders."""
        return frozenset(w for w in self.weights if len(w) >= HIDDEN)

    def evidence(self, words: set[str]) -> tuple[float, float]:
        """Largest weight of the known words, and the sum of all weights, which counts up to ``MOST``: many words say no
        more than some."""
        found = sorted((self.weights[w] for w in words if w in self.weights), reverse=True)
        return (found[0], min(sum(found), MOST)) if found else (0.0, 0.0)

    def score(self, words: set[str]) -> float:
        top, total = self.evidence(words)
        return float(1 / (1 + np.exp(-np.clip(self.slope[0] * top + self.slope[1] * total + self.offset, -60, 60))))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = 2500, sample_bytes: int = 64 << 20) -> Model:
    """Character model from all texts; word weights from a bounded sample of labelled rows that aren't held out.

    The sample has up to ``per_class`` ids and ``sample_bytes`` bytes of each label. A word's weight is its log odds
    between the labels; support counts different texts, told apart by their whole word sets, and near copies of one
    text count once. All words that clearly favour the label are kept.
    """
    letters = log_model(trigram_counts(docs))
    texts, counts = common.labelled_texts(docs, labels, target, per_class, sample_bytes)
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(counts) < 2:
        return Model(letters, {}, (0.0, 0.0), prior)
    sample = common.cut(texts)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters)
        for batch in batches:
            said = [sorted(restorer.words(x or "")) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.int32()), pa.array([set_key(x) for x in said], pa.int64()), pa.array([minima(x).tobytes() for x in said], pa.binary()), pa.array(said, pa.list_(pa.string()))],
                names=["label", "set_key", "minima", "words"],
            )

    said = common.cut(sample.repartition(common.partitions(docs), "doc_id").mapInArrow(words, "label int, set_key long, minima binary, words array<string>"))
    sets = sorted((r.set_key, r.minima) for r in said.select("set_key", "minima").distinct().collect())  # of the sample only
    first = like_sets(np.frombuffer(b"".join(x[1] for x in sets), "<u4").reshape(-1, MINIMA))
    keys = docs.sparkSession.createDataFrame([(x[0], sets[k][0]) for x, k in zip(sets, first)], "set_key long, text_key long")
    said = common.cut(said.join(F.broadcast(keys), "set_key").select("label", "text_key", "words"))
    totals = {r.label: (r.n, r.keys) for r in said.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("text_key").alias("keys")).collect()}
    if len(totals) < 2:
        return Model(letters, {}, (0.0, 0.0), prior)
    a_all, b_all = totals[1][1], totals[0][1]
    by_word = said.select("label", "text_key", F.explode("words").alias("word")).groupBy("word").agg(*(F.count_distinct(F.when(F.col("label") == k, F.col("text_key"))).alias(n) for k, n in ((1, "a"), (0, "b"))))
    pa_, pb = (F.col("a") + 0.5) / (a_all + 1), (F.col("b") + 0.5) / (b_all + 1)
    pooled = (F.col("a") + F.col("b") + 1) / (a_all + b_all + 2)
    z = (pa_ - pb) / F.sqrt(pooled * (1 - pooled) * (1 / (a_all + 1) + 1 / (b_all + 1)))
    rows = by_word.where(F.col("a") >= 4).withColumn("weight", F.log(pa_ / pb)).withColumn("z", z).where((F.col("z") > 5) & (F.col("weight") > 1)).orderBy(F.desc("z"), "word").collect()  # words of the sample only
    model = Model(letters, {r.word: float(r.weight) for r in rows}, (1.0, 0.0), 0.0)
    weights = model.weights

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Model(np.empty(0), weights, (0, 0), 0).evidence(set(x)) for x in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64())], names=["label", "top", "total"])

    seen = said.select("label", "words").mapInArrow(evidence, "label int, top double, total double").collect()
    x = np.array([(r.top, r.total, 1.0) for r in sorted(seen, key=lambda r: (r.label, r.top, r.total))])
    y = np.array(sorted(r.label for r in seen), "f8")
    beta = np.zeros(3)
    for _ in range(25):  # Newton steps with a little ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-2, 1e-3])
        beta = np.clip(beta + np.linalg.solve(h, x.T @ (y - p) - np.array([1e-2, 1e-2, 1e-3]) * beta), -30, 30)
    shift = prior - float(np.log(totals[1][0] / totals[0][0]))
    return Model(letters, weights, (float(beta[0]), float(beta[1])), float(beta[2]) + shift)


def set_key(words: list[str]) -> int:
    """A hash of a whole set of words, given in order."""
    return int.from_bytes(hashlib.blake2b("\0".join(words).encode(), digest_size=8).digest(), "big", signed=True)


def minima(words: list[str]) -> np.ndarray:
    """The smallest hash of the words under each of ``MINIMA`` hash functions; of no words the largest number."""
    out = np.full(MINIMA, 2**32 - 1, "<u4")
    with np.errstate(over="ignore"):
        h = np.array([zlib.crc32(w.encode()) << 32 | zlib.adler32(w.encode()) for w in words], "u8") * np.uint64(0x9E3779B97F4A7C15)
        for at in range(0, len(h), 20_000):
            part = (h[at : at + 20_000] ^ (h[at : at + 20_000] >> np.uint64(29)))[:, None] * _MUL
            out = np.minimum(out, ((part ^ (part >> np.uint64(32))) * _MUL >> np.uint64(32)).astype("<u4").min(0))
    return out


def like_sets(found: np.ndarray) -> list[int]:
    """For each row of minima the first row that it is a near copy of, by rows of which each is like the next."""
    root = list(range(len(found)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in range(len(found)):
        for j in np.flatnonzero((found[:k] == found[k]).sum(1) >= LIKE * MINIMA).tolist():
            a, b = find(j), find(k)
            root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(found))]


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 from ``threshold`` on) and the toxic words.

    The score reads the whole restored text and nothing else; null and empty texts get the score of a text
    without known words; repeated rows are scored each. Without labels of both kinds every text gets the share
    of label 1.
    """
    model = fit(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of the bounded sample and a table of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer, hidden = Restorer(m.letters), m.hidden()
        for batch in batches:
            said = [restorer.words(x or "", hidden) for x in batch.column(1).to_pylist()]
            found = np.array([m.score(x) for x in said])
            hits = [sorted(w for w in x if w in m.weights) for x in said]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.float64()), pa.array(found >= threshold).cast(pa.int32()), pa.array(hits, pa.list_(pa.string()))], names=["doc_id", "score", "predicted", "words"])

    return common.only(docs, "doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int, words array<string>")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """score_toxicity with held_out; a null id counts as held out."""
    return score_toxicity(docs, labels, threshold).select("doc_id", common.held_out("doc_id").alias("held_out"), "score", "predicted", "words")
