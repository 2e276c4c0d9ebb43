"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word is a run of letters. Only languages whose training texts use its scripts compete for it; each scores it by how
much likelier than on average its letter n-grams are in that language. The best path over the words of a whole text,
where each change of language costs a penalty, cuts the text into spans of one language each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from . import common

#: The Unicode ranges of scripts (first and last code point).
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Latin", 0xFF21, 0xFF5A),
    ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF),
    ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF),
    ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF), ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F),
    ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF),
    ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x2FFFF),
)
NAMES = (*dict.fromkeys(name for name, _, _ in SCRIPTS), "other")
_ORDERED = sorted(SCRIPTS, key=lambda s: s[1])
_FIRST = np.array([s[1] for s in _ORDERED])
_LAST = np.array([s[2] for s in _ORDERED])
_NAME = np.array([NAMES.index(s[0]) for s in _ORDERED])

UND = "und"
ORDERS, BITS = (2, 3, 4, 5), 15
SLOTS = len(ORDERS) << BITS
#: Scores are whole numbers, so that sums are exact and ties are ties: this many to a nat.
UNIT = 256
#: What a word costs in a language that doesn't use its script, in nats.
FOREIGN = 40
#: Words scored at once, words of a text labelled at once, and bytes of known words that a worker keeps.
RUN, BLOCK, KNOWN = 1 << 15, 1 << 16, 48 << 20
_WORD = re.compile(r"[^\W\d_]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], "u8")


@dataclass
class Model:
    languages: list[str]  # ascending
    table: np.ndarray  # slot x language, in units
    uses: np.ndarray  # script x language: whether the language uses the script
    prior: np.ndarray  # in units
    penalty: int  # in units


def scripts(points: np.ndarray) -> np.ndarray:
    """Number of each code point's script in ``NAMES``."""
    at = np.maximum(np.searchsorted(_FIRST, points, "right") - 1, 0)
    return np.where((points >= _FIRST[at]) & (points <= _LAST[at]), _NAME[at], len(NAMES) - 1)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(code points, first place of each word, (places, slots) for each order, word of each place).

    Words stand in one row with single spaces before, between and after them; an n-gram may begin or end in a space.
    """
    text = " " + " ".join(w.lower() for w in words) + " "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4").astype("u8")
    space = points == 32
    first = np.flatnonzero(space)[:-1]
    owner = np.cumsum(space) - 1
    found = []
    for k, n in enumerate(ORDERS):
        places = np.arange(len(points) - n + 1)
        inner = np.concatenate([[0], np.cumsum(space)])
        places = places[inner[places + n - 1] == inner[places + 1]]  # no space but at the ends
        with np.errstate(over="ignore"):
            h = np.zeros(len(places), "u8")
            for j in range(n):
                h = (h + points[places + j]) * _ODD[j]
                h ^= h >> np.uint64(29)
        found.append((places, ((h * _ODD[0]) >> np.uint64(64 - BITS)).astype("i8") + (k << BITS)))
    return points, first, found, owner


def is_word(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Score of each word in each language, in units: mean over the orders of its n-grams' sums; a script that no
    language uses decides nothing."""
    points, first, found, _ = grams(words)
    total = np.zeros((len(words), len(model.languages)), "i8")
    for places, slots in found:
        if len(places):
            at = np.searchsorted(places, first)
            some = np.flatnonzero(at < np.append(at[1:], len(places)))
            total[some] += np.add.reduceat(model.table[slots].astype("i8"), at[some], axis=0)
    total //= len(ORDERS)
    fits = model.uses[scripts(points)]
    fits[points == 32] = True
    all_fit = np.logical_and.reduceat(fits, first, axis=0)
    fits[points == 32] = False
    any_fits = np.logical_or.reduceat(fits, first, axis=0)
    all_fit = np.where(all_fit.any(axis=1)[:, None], all_fit, any_fits)
    return np.where(all_fit, total, np.where(all_fit.any(axis=1)[:, None], -FOREIGN * UNIT, 0))


def _forward(scores: np.ndarray, enter: np.ndarray, penalty: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain over never changing, value) of the best path to each word in each language.

    With sums C of the scores, a path's value less C is the largest M(t) - penalty - C(t) of the changes so far,
    where M is the best value at a word. M is raised until it stays: each time, one more change is allowed.
    """
    total = np.cumsum(scores, axis=0) + enter
    best, gain = total.max(axis=1), np.zeros_like(total)
    for _ in range(40):
        np.maximum(0, best[:-1, None] - penalty - total[:-1], out=gain[1:])
        np.maximum.accumulate(gain, axis=0, out=gain)
        value = gain + total
        raised = value.max(axis=1)
        if (raised == best).all():
            return gain, value
        best = raised
    for t in range(1, len(total)):  # many changes: word by word
        value[t] = np.maximum(value[t - 1], value[t - 1].max() - penalty) + scores[t]
    return value - total, value


def label(scores: np.ndarray, prior: np.ndarray, penalty: int, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(first word, word after the last, language) of each span of the best path over a text's words.

    Of equal paths, seen from the end, the language of smaller number, which began earlier. Long texts go in blocks:
    the values between blocks are kept, and each block is worked out again on the way back.
    """
    n = len(scores)
    entries = [prior]
    starts = range(0, n, block)
    for a in starts[:-1]:
        value = _forward(scores[a : a + block].astype("i8"), entries[-1] if a == 0 else np.maximum(entries[-1], entries[-1].max() - penalty), penalty)[1]
        entries.append(value[-1])
    spans, language = [], None
    for a, before in zip(reversed(starts), reversed(entries)):
        enter = before if a == 0 else np.maximum(before, before.max() - penalty)
        gain, value = _forward(scores[a : a + block].astype("i8"), enter, penalty)
        t = len(value) - 1
        if language is None:
            language, stop = int(value[t].argmax()), n
        elif not stayed:
            language, stop = int(value[t].argmax()), a + t + 1
        while True:
            began = int(np.searchsorted(gain[: t + 1, language], gain[t, language]))
            if began == 0:
                break
            spans.append((a + began, stop, language))
            t, stop = began - 1, a + began
            language = int(value[t].argmax())
        stayed = a > 0 and before[language] >= before.max() - penalty
        if a > 0 and not stayed:
            spans.append((a, stop, language))
    return [(0, stop, language), *reversed(spans)]


class Labeller:
    """Labels texts and remembers the scores of words, up to a bound of bytes."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.bytes = 0
        self.rows, self.lengths = np.zeros((1024, len(self.model.languages)), "i4"), np.zeros(1024, "i8")

    def learn(self, words: set[str]) -> None:
        if self.bytes > KNOWN:
            self.forget()
        new = [w for w in words if w not in self.number]
        for a in range(0, len(new), RUN):
            some = new[a : a + RUN]
            first, last = len(self.number), len(self.number) + len(some)
            if last > len(self.lengths):
                more = max(last, 2 * len(self.lengths)) - len(self.lengths)
                self.rows = np.concatenate([self.rows, np.zeros((more, self.rows.shape[1]), "i4")])
                self.lengths = np.concatenate([self.lengths, np.zeros(more, "i8")])
            self.number.update(zip(some, range(first, last)))
            real = np.array([is_word(w) for w in some])
            self.rows[first:last] = np.where(real[:, None], word_scores(self.model, some), 0)
            self.lengths[first:last] = [len(w) if r else 0 for w, r in zip(some, real)]
            self.bytes += sum(map(len, some)) + len(some) * (160 + 4 * len(self.model.languages))

    def texts(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[dict]]]:
        """(language, score, spans) of each text; spans are in code points and cover it."""
        if not self.model.languages:
            yield from ((UND, 0.0, []) for _ in texts)
            return
        found = [_WORD.findall(x or "") for x in texts]
        self.learn({w for words in found for w in words})
        for text, words in zip(texts, found):
            yield self.one(text, words)

    def one(self, text: str | None, words: list[str]) -> tuple[str, float, list[dict]]:
        ids = np.fromiter(map(self.number.__getitem__, words), "i8", len(words))
        lengths = self.lengths[ids]
        if not lengths.any():
            return UND, 0.0, []
        scores = self.rows[ids]
        spans = label(scores, self.model.prior, self.model.penalty)
        letters = np.zeros(len(self.model.languages), "i8")
        for a, b, k in spans:
            letters[k] += lengths[a:b].sum()
        best = int(letters.argmax())
        own = sum(scores[a:b].sum(axis=0, dtype="i8") for a, b, k in spans if k == best) + self.model.prior
        certain = 1 / np.exp(np.clip((own - own[best]) / UNIT, -700, 50)).sum()
        edges = [0, len(text)]
        if len(spans) > 1:
            begins = [m.start() for m in _WORD.finditer(text)]
            edges = [0, *(begins[a] for a, _, _ in spans[1:]), len(text)]
        out = [{"start": s, "end": e, "lang": self.model.languages[k]} for s, e, (_, _, k) in zip(edges, edges[1:], spans)]
        return self.model.languages[best], float(min(1.0, certain)) * float(letters[best] / letters.sum()), out


def fit(docs: DataFrame, learn: Column, sample_bytes: int = 6 << 20, most_languages: int = 256, mix: float = 0.02, least_use: float = 0.01, penalty: float = 6.0) -> Model:
    """A model of the languages that ``docs`` (text, lang) names in the rows where ``learn`` holds.

    Rows without language or text are left out. A language's n-grams are counted over about ``sample_bytes`` bytes
    of its texts: rows are drawn by a hash of id and text, with the chance that this asks for. Only the ``most_languages``
    languages of most rows are learned, so the model is bounded: for each language 2^15 slots for each order of n-grams.
    ``mix`` is the share of the mean of all languages in each one's frequencies; a language uses a script from
    a share ``least_use`` of its letters on. No rows make a model without languages, which answers ``und``.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    languages = sorted(r.lang for r in sizes)
    count = len(languages)
    if not count:
        return Model([], np.zeros((SLOTS, 0), "i2"), np.zeros((len(NAMES), 0), bool), np.zeros(0, "i8"), 0)
    share = {r.lang: min(1.0, sample_bytes / max(r.bytes, 1)) for r in sizes}
    chance = F.create_map(*(F.lit(x) for kv in share.items() for x in kv))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.element_at(chance, F.col("lang")) * (1 << 30)
    taken = known.where(F.col("lang").isin(languages)).where(drawn)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, Counter()).update(_WORD.findall(text))
            for lang, words in by.items():
                if len(found) == 32 and lang not in found:  # a bound on what a task holds
                    yield from _counted(found)
                    found = {}
                total = found.setdefault(lang, np.zeros(SLOTS + len(NAMES), "i8"))
                some = sorted(w for w in words if is_word(w))
                for a in range(0, len(some), RUN):
                    run = some[a : a + RUN]
                    times = np.array([words[w] for w in run])
                    points, _, grams_, owner = grams(run)
                    for places, slots in grams_:
                        total[:SLOTS] += np.bincount(slots, times[owner[places]], SLOTS).astype("i8")
                    letters = points != 32
                    total[SLOTS:] += np.bincount(scripts(points[letters]), times[owner[letters]], len(NAMES)).astype("i8")
        yield from _counted(found)

    def dense(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS + len(NAMES), "i8")
        total[np.asarray(table["slot"])] = np.asarray(table["n"])
        return pa.table({"lang": [key[0].as_py()], "total": [total.tobytes()]})

    parts = taken.select("lang", "text").mapInArrow(counts, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    totals = {r.lang: np.frombuffer(r.total, "i8") for r in parts.groupBy("lang").applyInArrow(dense, "lang string, total binary").collect()}  # a row for each language
    total = np.stack([totals.get(lang, np.zeros(SLOTS + len(NAMES), "i8")) for lang in languages], axis=1).astype("f8")
    table = np.zeros((SLOTS, count))
    for k in range(len(ORDERS)):
        rows = slice(k << BITS, (k + 1) << BITS)
        own = total[rows] / np.maximum(total[rows].sum(axis=0), 1)
        mean = own.mean(axis=1, keepdims=True) + 1e-9
        table[rows] = np.log(((1 - mix) * own + mix * mean) / mean)
    letters = total[SLOTS:]
    uses = letters >= least_use * np.maximum(letters.sum(axis=0), 1)
    rows = np.array([next(r.n for r in sizes if r.lang == lang) for lang in languages], "f8")
    return Model(languages, np.round(table * UNIT).astype("i2"), uses, np.round(np.log(rows / rows.sum()) * UNIT).astype("i8"), round(penalty * UNIT))


def _counted(found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, total in found.items():
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots.astype("i4")), pa.array(total[slots])], names=["lang", "slot", "n"])


def label_languages(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """Every row of ``docs`` with, as ``names`` calls them, the language with most letters in its text, a score (0 to 1:
    that language's share of the letters, times how certain its spans are) and the spans (start, end, lang) in code
    points, which cover the text.

    The whole text is read and nothing else. Null and empty texts and texts without letters are ``und`` with score 0
    and no spans. Repeated rows are labelled each; of languages with equally many letters the one that sorts first wins.
    Other columns are kept, unless they have those names.
    """
    span = StructType().add("start", IntegerType()).add("end", IntegerType()).add("lang", StringType())
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            found = list(labeller.texts(batch.column("text").to_pylist()))
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), spans_type)))], names=[*batch.schema.names, *names])

    kept = docs.drop(*names)
    schema = StructType([*kept.schema.fields]).add(names[0], StringType()).add(names[1], DoubleType()).add(names[2], ArrayType(span))
    return kept.mapInArrow(labels, schema)


def held_out(doc_id: Column | str) -> Column:
    """Rows that the model may not learn from: crc32 of the id as text leaves 2 when divided by 4; a null id too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def language_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``docs`` (doc_id, text, lang)."""
    model = fit(common.only(docs, "doc_id", "text", "lang"), ~held_out("doc_id"), **options)
    return label_languages(common.only(docs, "doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
