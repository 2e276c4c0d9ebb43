"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded and pass learned filters of ``WIDTH`` bytes at every second byte. A document is covered by chunks of
``CHUNK`` bytes, each of which shares its second half with the next. Each filter is max-pooled over a chunk; a
document's mean and maximum over its chunks enter one logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

WIDTH, STRIDE, EMBED, FILTERS, CHUNK = 8, 2, 8, 16, 512
HALF = CHUNK // 2
#: Bytes that pass the filters at once; longer texts go in several segments that overlap.
SEGMENT = 64 * CHUNK


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    weight: np.ndarray  # mean and maximum of each filter
    offset: float


def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, owner and start of each chunk) of runs of about ``SEGMENT`` bytes; each text is followed by padding."""
    parts, owners, starts, at = [], [], [], 0
    for k, text in enumerate(texts):
        for a in range(0, max(len(text), 1), SEGMENT):
            left = max(len(text) - a, 1)
            if a and left <= HALF:  # the chunk before reaches to the end
                break
            n = min(left, SEGMENT + HALF)
            piece = np.frombuffer(text[a : a + n + WIDTH - STRIDE], "u1")
            room = -(-max(len(piece), n) // STRIDE) * STRIDE + WIDTH
            block = np.zeros(room, "u1")
            block[: len(piece)] = piece
            for b in range(0, min(left, SEGMENT), HALF):
                if b and b + HALF >= left:
                    break
                owners.append(k)
                starts.append((at + b, at + min(b + CHUNK, -(-n // STRIDE) * STRIDE)))
            parts.append(block)
            at += room
            if at >= SEGMENT:
                yield np.concatenate(parts), np.array(owners), np.array(starts) // STRIDE
                parts, owners, starts, at = [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(owners), np.array(starts) // STRIDE


def _convolve(net: Net, flat: np.ndarray) -> np.ndarray:
    """Responses of the filters at every second byte."""
    steps = WIDTH // STRIDE
    x = net.embed[flat].reshape(-1, STRIDE * EMBED)
    y = x @ np.ascontiguousarray(net.filters.reshape(steps, STRIDE * EMBED, -1).transpose(1, 0, 2).reshape(STRIDE * EMBED, -1))
    f = net.filters.shape[1]
    n = len(y) - steps + 1
    out = y[:n, :f].copy()
    for k in range(1, steps):
        out += y[k : k + n, k * f : (k + 1) * f]
    return out


def chunk_features(net: Net, flat: np.ndarray, spans: np.ndarray) -> np.ndarray:
    pooled = np.maximum.reduceat(_convolve(net, flat), np.minimum(spans.reshape(-1), len(flat) // STRIDE - WIDTH // STRIDE), axis=0)[::2]
    return np.maximum(pooled + net.bias, 0)


def features(net: Net, texts: list[bytes]) -> np.ndarray:
    """Mean and maximum over the chunks of each text."""
    f = len(net.bias)
    total, most, count = np.zeros((len(texts), f), "f8"), np.zeros((len(texts), f), "f4"), np.zeros(len(texts))
    for flat, owners, spans in _segments(texts):
        z = chunk_features(net, flat, spans)
        np.add.at(total, owners, z)
        np.maximum.at(most, owners, z)
        np.add.at(count, owners, 1)
    return np.concatenate([total / count[:, None], most], axis=1).astype("f4")


def predict(net: Net, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.empty(0)
    z = features(net, texts).astype("f8") @ net.weight + net.offset
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Net:
    """Minimises the weighted log loss by Adam; the gradient of a pool goes to the window that won."""
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.5, (256, EMBED)).astype("f4"), rng.normal(0, 0.18, (WIDTH * EMBED, FILTERS)).astype("f4"), np.zeros(FILTERS, "f4"), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    names = ("embed", "filters", "bias", "weight", "offset")
    m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), batch):
            rows = order[low : low + batch]
            grads = _gradient(net, [texts[k] for k in rows], labels[rows], weights[rows])
            t += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                step = rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, float(net.offset - step) if k == "offset" else (getattr(net, k) - step).astype(getattr(net, k).dtype))
    return net


def _gradient(net: Net, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict:
    f, n = FILTERS, len(texts)
    held, total, most, best, count = [], np.zeros((n, f)), np.zeros((n, f)), np.full((n, f), -1), np.zeros(n)
    for flat, owners, spans in _segments(texts):
        y = _convolve(net, flat)
        at = np.empty((len(owners), f), "i8")
        for k, (a, b) in enumerate(spans):
            at[k] = a + y[a : max(b, a + 1)].argmax(axis=0)
        z = np.maximum(np.take_along_axis(y, at, axis=0) + net.bias, 0)
        for k, (owner, row) in enumerate(zip(owners, z), start=sum(len(h[2]) for h in held)):
            total[owner] += row
            count[owner] += 1
            better = row > most[owner]
            most[owner][better] = row[better]
            best[owner][better] = k
        held.append((flat, owners, at, z))
    x = np.concatenate([total / count[:, None], most], axis=1)
    p = 1 / (1 + np.exp(-np.clip(x @ net.weight + net.offset, -60, 60)))
    d = weights * (p - labels) / n
    grads = {"weight": d @ x + 1e-4 * net.weight, "offset": d.sum(), "embed": np.zeros_like(net.embed), "filters": np.zeros_like(net.filters), "bias": np.zeros_like(net.bias)}
    first = 0
    for flat, owners, at, z in held:
        k = np.arange(first, first + len(owners))[:, None]
        dz = d[owners, None] * (net.weight[:f] / count[owners, None] + net.weight[f:] * (best[owners] == k)) * (z > 0)
        first += len(owners)
        chunk, which = np.nonzero(dz)
        g = dz[chunk, which].astype("f4")
        windows = flat[(at[chunk, which] * STRIDE)[:, None] + np.arange(WIDTH)]  # bytes that won
        seen = net.embed[windows].reshape(len(g), -1)
        for j in range(f):
            mine = which == j
            grads["filters"][:, j] += g[mine] @ seen[mine]
            grads["bias"][j] += g[mine].sum()
        np.add.at(grads["embed"], windows.reshape(-1), (g[:, None] * net.filters.T[which]).reshape(-1, EMBED))
    return grads


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = 700, sample_bytes: int = 32 << 20) -> Net:
    """A network for the chance of label 1, from a bounded sample of labelled rows that aren't held out.

    The sample has up to ``per_class`` ids and ``sample_bytes`` bytes of each label and is weighted back to the
    share that each label has among all labelled ids. With one label only, or none, the network gives that label's
    share everywhere.
    """
    texts, counts = common.labelled_texts(docs, labels, target, per_class, sample_bytes)
    sample = [(r.text.encode(), r.label) for r in sorted(texts.collect(), key=lambda r: r.doc_id)]  # bounded by both
    if len({y for _, y in sample}) < 2:
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return Net(np.zeros((256, EMBED), "f4"), np.zeros((WIDTH * EMBED, FILTERS), "f4"), np.zeros(FILTERS, "f4"), np.zeros(2 * FILTERS), float(np.log(share / (1 - share))))
    y = np.array([x[1] for x in sample])
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    # the rarer label counts at least a quarter in training; the offset is put right afterwards
    share = counts[1] / (counts[0] + counts[1])
    lifted = np.clip(share, 0.25, 0.75)
    weight = weight * np.where(y == 1, lifted / share, (1 - lifted) / (1 - share))
    net = train([x[0] for x in sample], y, weight / weight.mean())
    net.offset += float(np.log(share / (1 - share)) - np.log(lifted / (1 - lifted)))
    return net


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted"), **options) -> DataFrame:
    """Every row of ``docs`` with, as ``names`` calls them, its score (0 to 1, higher: label 1 likelier) and
    whether it is predicted 1 (from ``threshold`` on).

    The score reads the whole text and nothing else; null counts as empty; empty texts get the score of a
    chunk of padding. Repeated rows are scored each; other columns are kept, unless they have those names.
    """
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    net = fit(docs, labels, **options)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict(net, [(x or "").encode() for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array(found >= threshold).cast(pa.int32())], names=[*batch.schema.names, *names])

    kept = docs.drop(*names)
    schema = StructType([*kept.schema.fields]).add(names[0], DoubleType()).add(names[1], IntegerType())
    return kept.mapInArrow(score, schema)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``, as score_quality gives them. A null id counts as
    held out."""
    return score_quality(common.only(docs, "doc_id", "text"), labels, threshold).select("doc_id", common.held_out("doc_id").alias("held_out"), "score", "predicted")
