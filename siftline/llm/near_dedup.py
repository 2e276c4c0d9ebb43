"""Near duplicates by MinHash with tensored banding, confirmed on whole shingle sets.

Two collections hold ``side`` keys each; a key joins ``DEPTH`` minhashes. Every pair of a left and a right key
makes the key of one table, so ``2 * side * DEPTH`` minhashes serve ``side ** 2`` tables of ``2 * DEPTH``.
A pair of similarity s meets in some table unless a whole collection fails: ``side`` follows from the threshold,
so that a link at it is missed with a chance below one in a thousand.

Texts with equal sets are one node. In each partition nodes that share buckets are tied to the smallest of them,
one tie a node, and a hot bucket sends on one row for each partition. Of the nodes that share a bucket only those
stay that have enough shingles in common with any others. The clusters that remain are compared on their whole
sets: small ones in one group, large ones in tiles, whose components then meet by representatives. Where few
nodes of a cluster are outside its largest component, they meet all of it at last. Where many are, nodes get longer
keys, by the same tensored banding, and only those that share one of these buckets meet once more: so texts that are alike
but not linked don't all meet each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .exact_dedup import _LOWER
from .hashing import BASE, SLICE, mix, stretches
from .tokens import forget

#: Minhashes of a key: at first, and of the longer keys within large clusters.
WORDS, DEPTH, STEEP = 5, 3, 6
#: Nodes and shingles of one tile, about, and so many tiles of nodes outside a cluster's largest component meet all of it.
TILE, TILE_GRAMS, FEW = 250, 1 << 20, 4


@dataclass(frozen=True)
class Banding:
    """What the threshold, in hundredths, decides."""

    percent: int
    depth: int = DEPTH

    @property
    def side(self) -> int:
        """The fewest keys in each collection with which a link at the threshold is rarely missed."""
        return next(n for n in range(1, 1000) if 2 * (1 - (self.percent / 100) ** self.depth) ** n < 8e-4)

    @property
    def hashes(self) -> int:
        return 2 * self.side * self.depth


#: Nodes whose buckets one worker holds at once.
RUN_NODES = 10_000
_ROWS = 8_000  # shingles hashed at once: a number each for every minhash

_rng = np.random.default_rng(23)
_MUL = _rng.integers(0, 2**63, 54, "u8") * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**64, 54, "u8")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """The factors and summands of so many hash functions."""
    global _MUL, _ADD
    if len(_MUL) < hashes:
        more = np.random.default_rng(21)  # always the same ones, from the first on
        _MUL = np.concatenate([_MUL[:54], more.integers(0, 2**63, hashes, "u8") * np.uint64(2) + np.uint64(1)])
        _ADD = np.concatenate([_ADD[:54], mix(_MUL[54:])])
    return _MUL[:hashes], _ADD[:hashes]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each run of bytes that aren't white space."""
    flat = np.frombuffer(text, "u1")
    inside = np.concatenate([[False], ~_SPACE[flat], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return stretches(flat, edges[0::2], edges[1::2]), edges[0::2]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 48-bit hashes of the five-word shingles of each lower-cased text."""
    words: list[np.ndarray] = [np.empty(0, "u8")] * len(texts)
    group, size = [], 0
    for k, text in enumerate([*texts, None]):
        if group and (text is None or size + len(text) > SLICE):
            found, starts = word_hashes(b"\n".join(texts[g] for g in group))
            ends = np.cumsum([len(texts[g]) + 1 for g in group])
            for g, part in zip(group, np.split(found, np.searchsorted(starts, ends[:-1]))):
                words[g] = part
            group, size = [], 0
        if text is None:
            break
        if len(text) > SLICE:  # a very long text goes in slices cut at white space
            at, parts = 0, []
            while at < len(text):
                end = min(at + SLICE, len(text))
                while end < len(text) and not _SPACE[text[end]]:
                    end += 1
                parts.append(word_hashes(text[at:end])[0])
                at = end
            words[k] = np.concatenate(parts)
        else:
            group.append(k)
            size += len(text) + 1
    return [_shingles(w) for w in words]


def _shingles(words: np.ndarray) -> np.ndarray:
    n = min(len(words), WORDS)
    if not n:
        return np.empty(0, "u8")
    with np.errstate(over="ignore"):
        h = np.full(len(words) - n + 1, n, "u8")
        for k in range(n):
            h = h * np.uint64(BASE) + words[k : len(words) - n + 1 + k]
        return np.unique(mix(h) & np.uint64(2**48 - 1))


def minhashes(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """Rows of ``hashes`` minima; zeros for an empty set."""
    out = np.zeros((len(sets), hashes), "u8")
    group: list[int] = []
    for k in [*(k for k, s in enumerate(sets) if len(s)), None]:
        if group and (k is None or sum(len(sets[g]) for g in group) + len(sets[k]) > _ROWS):
            _minima(sets, group, out)
            group = []
        if k is not None:
            group.append(k)
    return out


def _minima(sets: list[np.ndarray], group: list[int], out: np.ndarray) -> None:
    with np.errstate(over="ignore"):
        mul, add = _functions(out.shape[1])
        if len(group) == 1:
            s = sets[group[0]]
            out[group[0]] = np.min([(mix(s[a : a + _ROWS])[:, None] * mul + add).min(0) for a in range(0, len(s), _ROWS)], axis=0)
        else:
            at = np.cumsum([0, *(len(sets[g]) for g in group[:-1])])
            out[group] = np.minimum.reduceat(mix(np.concatenate([sets[g] for g in group]))[:, None] * mul + add, at, axis=0)


def side_keys(minima: np.ndarray, side: int) -> np.ndarray:
    """The 2 * side keys of each row: left ones, then right ones."""
    with np.errstate(over="ignore"):
        h = np.full((len(minima), 2 * side), 7, "u8")
        depth = minima.shape[1] // (2 * side)
        parts = minima.reshape(len(minima), 2 * side, depth)
        for k in range(depth):
            h = mix(h * np.uint64(BASE) + parts[:, :, k])
    return h


def tables(keys: np.ndarray, side: int) -> Iterator[np.ndarray]:
    """The key of each row in each of the ``side ** 2`` tables, one table after the other."""
    for i in range(side):
        with np.errstate(over="ignore"):
            table = mix(keys[:, i : i + 1] * np.uint64(BASE) + keys[:, side:] + np.arange(side, dtype="u8") + np.uint64(side * i))
        yield from table.T


def _pack(grams: np.ndarray) -> bytes:
    return grams.astype("<u8").view("u1").reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(data, "u1").reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _lowered(column: pa.Array) -> list[bytes]:
    return [(x or "").encode().translate(_LOWER) for x in column.to_pylist()]


def _set_hash(grams: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int((mix(grams + np.uint64(1)).sum(dtype="u8") ^ (mix(grams ^ np.uint64(BASE)).sum(dtype="u8") * np.uint64(3))).astype("i8"))


def signatures(docs: DataFrame, banding: Banding) -> DataFrame:
    """tag, doc_id, text_hash, n_shingles, set_hash and keys (packed) of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            sets = shingle_sets(_lowered(batch.column(1)))
            keys = side_keys(minhashes(sets, banding.hashes), banding.side)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(at, at + len(sets)), pa.int64()),
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_hash(s) for s in sets], pa.int64()),
                    pa.array([x.tobytes() for x in keys], pa.binary()),
                ],
                names=["tag", "doc_id", "text_hash", "n_shingles", "set_hash", "keys"],
            )
            at += len(sets)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sign, "tag long, doc_id long, text_hash long, n_shingles long, set_hash long, keys binary")


def roots(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """The smallest number that each one in ``pairs`` hangs together with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def bucket_rows(nodes: DataFrame, side: int) -> DataFrame:
    """(key, node, tie): nodes of a partition, or of a run of it, that share buckets hang on the smallest of them. ``node`` with ``key``:
    what a table's bucket hangs on, once for each partition. ``node`` with ``tie``: what another node hangs on."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), "u8").reshape(-1, 2 * side)))
                n += batch.num_rows
            if n >= RUN_NODES:
                yield from rows(held)
                held, n = [], 0
        if n:
            yield from rows(held)

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        node = np.concatenate([h[0] for h in held])
        keys = np.concatenate([h[1] for h in held])
        order = np.argsort(node)
        node, keys = node[order], keys[order]
        ties, buckets = set(), []
        for table in tables(keys, side):
            key, first, which = np.unique(table, return_index=True, return_inverse=True)
            buckets.append((key, first.astype("i4")))
            other = np.flatnonzero(first[which] != np.arange(len(node)))
            ties.update(zip(other.tolist(), first[which[other]].tolist()))
        hangs = np.arange(len(node))
        for x, r in roots(ties).items():
            hangs[x] = r
        for key, first in buckets:
            yield batch_of(key.view("i8"), node[hangs[first]], None)
        tied = np.flatnonzero(hangs != np.arange(len(node)))
        yield batch_of(None, node[tied], node[hangs[tied]])

    def batch_of(key: np.ndarray | None, node: np.ndarray, tie: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(node), pa.int64())
        return pa.RecordBatch.from_arrays([none if key is None else pa.array(key), pa.array(node), none if tie is None else pa.array(tie)], names=["key", "node", "tie"])

    return nodes.select("node", "keys").mapInArrow(spread, "key long, node long, tie long")


def candidate_ties(nodes: DataFrame, side: int) -> DataFrame:
    """(a, b): nodes that share a bucket hang together by these, a few for each node whatever the buckets' sizes."""
    rows = common.cut(bucket_rows(nodes, side))
    # the smallest node of each bucket, by one shuffle and no join; a bucket has a row for each partition or run at most
    least = F.first("node").over(Window.partitionBy("key").orderBy("node"))
    across = rows.where("key is not null").select(F.col("node").alias("a"), least.alias("b")).where("b < a").distinct()
    return across.unionByName(rows.where("key is null").select(F.col("node").alias("a"), F.col("tie").alias("b")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that each end of ``edges`` (a, b) can reach.

    Each round takes the smallest label among the neighbours and then the label's own label, until nothing
    changes; labels stay distributed.
    """
    both = common.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = common.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        better = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = common.cut(better.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.where("label < old").isEmpty():
            return labels
    raise RuntimeError("labels still change")


def _bloom(ids: DataFrame, most_words: int = 1 << 20) -> np.ndarray | None:
    """A filter of the ids that are needed, while it fits ``most_words``; None beyond."""
    n = ids.count()
    words = 1 << max(6, (n * 12 // 64).bit_length())
    if words > most_words:
        return None
    h = F.xxhash64("doc_id")
    bit = F.explode(F.array(*(F.pmod(F.shiftrightunsigned(h, s), F.lit(words * 64)) for s in (0, 21, 35)))).alias("bit")
    rows = ids.select(bit).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(words, "i8")
    out[rows["word"].to_numpy("i8")] = rows["bits"].to_numpy("i8")
    return out


def needed_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, size, grams) of the nodes in ``needed`` (doc_id, set_hash, node)."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), "text")
    bits = _bloom(needed.select("doc_id").distinct())
    if bits is None:
        texts = texts.join(needed.select("doc_id").distinct(), "doc_id", "left_semi")
    else:
        shared = docs.sparkSession.sparkContext.broadcast(bits)
        mask = len(bits) * 64

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            if bits is not None:
                h = batch.column(2).to_numpy().view("u8")
                hit = np.ones(len(h), bool)
                for s in (0, 21, 35):
                    at = np.mod((h >> np.uint64(s)).view("i8"), mask)
                    hit &= (shared.value[at // 64].view("u8") >> (at % 64).astype("u8")) & np.uint64(1) == 1
                batch = batch.filter(pa.array(hit))
            sets = shingle_sets(_lowered(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_pack(s) for s in sets], pa.binary())],
                names=["doc_id", "set_hash", "size", "grams"],
            )

    found = texts.withColumn("h", F.xxhash64("doc_id")).mapInArrow(grams, "doc_id long, set_hash long, size long, grams binary")
    # repeated rows have the same set: one of them is enough
    return found.join(needed, ["doc_id", "set_hash"]).dropDuplicates(["node"]).select("node", "size", "grams")


def supported(sets: DataFrame, percent: int) -> DataFrame:
    """(node, size, grams) of ``sets`` without the nodes that can be linked with none of the others.

    A link at ``percent`` needs as large a share of a node's shingles in another set. A shingle that no other
    node has adds nothing; where too many of them do, no partner is possible.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = _unpack(packed).view("i8")
                for at in range(0, len(grams), 50_000):
                    part = grams[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), node))], names=["gram", "node"])

    grams = sets.select("node", "grams").mapInArrow(spread, "gram long, node long")
    alone = grams.groupBy("gram").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy("node").agg(F.count("*").alias("alone"))
    kept = sets.join(alone, "node", "left").where((F.col("size") - F.coalesce("alone", F.lit(0))) * 100 >= F.col("size") * percent)
    return kept.select("node", "size", "grams")


def intersections(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many numbers each of ``sets`` has in common with each of ``others``; a set holds a number once."""
    out = np.zeros((len(sets), len(others)))
    flat = np.concatenate([*sets, *others])
    if not len(flat):
        return out
    owner = np.repeat(np.arange(len(sets) + len(others)), [len(x) for x in (*sets, *others)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    same = flat[1:] == flat[:-1]
    held = np.concatenate([same, [False]]) | np.concatenate([[False], same])  # numbers of one set alone add nothing
    column = np.cumsum(np.concatenate([[False], ~same]))[held]
    owner = owner[held]
    column = np.cumsum(np.concatenate([[0], (column[1:] != column[:-1]).astype("i8")]))[: len(column)]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, (low, low + 2048))
        table = np.zeros((len(sets) + len(others), 2048), "f4")
        table[owner[a:b], column[a:b] - low] = 1
        out += table[: len(sets)] @ table[len(sets) :].T
    return out


def linked(sets: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``sets`` are linked with which of ``others``, on their whole sets."""
    both = intersections(sets, others)
    size, other = (np.array([len(x) for x in part], "f8") for part in (sets, others))
    return 100 * both >= percent * (size[:, None] + other[None, :] - both)


def smallest_reached(links: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric table of links reaches."""
    label = np.arange(len(links))
    while True:
        least = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _in_tile(percent: int):
    """Labels of one tile's nodes: the smallest node that each reaches within it, and how many links it has."""

    def compare(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        order = np.argsort(node)
        packed = table.column("grams").to_pylist()
        grams = [_unpack(packed[k]) for k in order]
        links = linked(grams, grams, percent)
        label = smallest_reached(links)
        first = {c: table.column(c)[0].as_py() for c in ("cluster", "tile", "tiles")}
        n = len(node)
        return pa.table({"cluster": pa.array([first["cluster"]] * n, pa.int64()), "tile": pa.array([first["tile"]] * n, pa.int64()), "tiles": pa.array([first["tiles"]] * n, pa.int64()), "node": node[order], "label": node[order][label], "degree": links.sum(axis=1).astype("i8") - 1})

    return compare


def _across(percent: int):
    """Links between labels from nodes that come from two sides (``side`` 0 and 1): one link a label at most."""

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        names, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        packed = table.column("grams").to_pylist()
        sides = [np.flatnonzero(side == k) for k in (0, 1)]
        links = np.zeros((len(names), len(names)), bool)
        a, b = np.nonzero(linked(*([_unpack(packed[k]) for k in part] for part in sides), percent)) if all(map(len, sides)) else ((), ())
        a, b = label[sides[0]][list(a)], label[sides[1]][list(b)]
        links[a, b] = links[b, a] = True
        least = smallest_reached(links)
        moved = np.flatnonzero(least != np.arange(len(names)))
        return pa.table({"a": names[moved], "b": names[least[moved]]})

    return compare


def confirmed(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """(node, label): the smallest node that each node of ``clusters`` (node, label) can reach by links within its
    cluster, each confirmed on whole sets.

    A cluster of up to ``TILE`` nodes is one group. A larger one is dealt into tiles. The components of its tiles
    are joined by their best linked nodes, each group of which holds the cluster's best linked one; then links that
    still join two labels are looked for, see missed_links. What is shuffled is each set a few times, and those of large
    clusters of many labels once for each bucket of longer keys that they share with another label.
    """
    sized = clusters.withColumnRenamed("label", "cluster").join(sets.select("node", "size"), "node")
    tiles = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_GRAMS)).alias("tiles")).select("cluster", F.least("tiles", F.lit(2**31 - 1)).alias("tiles"))
    placed = common.cut(sized.join(tiles, "cluster").select("cluster", "node", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile")))
    grams = sets.select("node", "grams")
    out = common.cut(placed.join(grams, "node").groupBy("cluster", "tile").applyInArrow(_in_tile(percent), "cluster long, tile long, tiles long, node long, label long, degree long"))
    wide = out.where("tiles > 1")
    if wide.isEmpty():
        return out.select("node", "label")
    # the best linked node of each label; each group of them has the best of the cluster
    best = common.cut(wide.groupBy("cluster", "label").agg(F.max_by("node", F.struct("degree", F.negative("node"))).alias("node"), F.max("degree").alias("degree"), F.count("*").alias("n")))
    teams = best.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).alias("teams"), F.max_by("label", F.struct("degree", F.negative("label"))).alias("head"))
    met = best.join(teams, "cluster").withColumn("side", (F.col("label") == F.col("head")).cast("int"))
    team = F.when(F.col("side") == 1, F.sequence(F.lit(0).cast("long"), F.col("teams") - 1)).otherwise(F.array(F.pmod(F.xxhash64("label"), F.col("teams"))))
    met = met.select("cluster", "node", "label", "side", F.explode(team).alias("team"))
    # all of a team meet each other: the head stands on both sides, the others on one and, as copies, on the other
    both = met.where("side = 0").withColumn("side", F.lit(1)).unionByName(met.where("side = 0")).unionByName(met.where("side = 1"))
    links = common.cut(both.join(grams, "node").select("cluster", "team", "label", "side", "grams").groupBy("cluster", "team").applyInArrow(_across(percent), "a long, b long"))
    joined = components(links)
    named = wide.join(joined.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select("cluster", "tile", "tiles", "node", F.coalesce("now", "label").alias("label"))
    named = common.cut(named.select("cluster", "node", "label").join(sets.select("node", "size"), "node"))
    rest = missed_links(named, grams, percent)
    final = components(links.unionByName(rest)).select(F.col("node").alias("label"), F.col("label").alias("now"))
    return out.join(final, "label", "left").select("node", F.coalesce("now", "label").alias("label"))


def groups_of(named: DataFrame, group: str) -> DataFrame:
    """For each ``group`` of nodes (group, node, label, size) with several labels: the label of most nodes (``largest``), how
    many nodes there are (``all``) and how many have another one (``out``), the tiles and chunks that they make, and the
    sets that a comparison would move."""
    counts = named.groupBy(group, "label").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    large = counts.groupBy(group).agg(
        F.max_by("label", F.struct("n", F.negative("label"))).alias("largest"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("out"),
        F.sum("grams").alias("all_grams"), (F.sum("grams") - F.max_by("grams", F.struct("n", F.negative("label")))).alias("out_grams"),
    ).where("out > 0")
    tiles, chunks = (F.greatest(F.ceil(F.col(n) / TILE), F.ceil(F.col(f"{n}_grams") / TILE_GRAMS)) for n in ("all", "out"))
    return large.select(group, "largest", "all", "out", tiles.alias("tiles"), chunks.alias("chunks"), (chunks * F.col("all") + tiles * F.col("out")).alias("moved"))


def outer_links(named: DataFrame, large: DataFrame, group: str, grams: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels that a link joins in the groups of ``large``: the nodes outside a group's largest label, in chunks, meet
    all of its nodes, in tiles."""
    named = named.join(large.select(group, "largest", "tiles", "chunks"), group)
    deal = lambda salt, c: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(c))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    here = named.select(group, "node", "label", deal(0, "tiles").alias("tile"), upto("chunks").alias("chunk"), F.lit(0).alias("side"))
    there = named.where("label <> largest").select(group, "node", "label", upto("tiles").alias("tile"), deal(1, "chunks").alias("chunk"), F.lit(1).alias("side"))
    met = here.unionByName(there).join(grams, "node").select(group, "tile", "chunk", "label", "side", "grams")
    return common.cut(met.groupBy(group, "tile", "chunk").applyInArrow(_across(percent), "a long, b long"))


def missed_links(named: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels of one cluster (cluster, node, label, size) that a link still joins.

    Where few nodes are outside a cluster's largest label, they meet the whole cluster. Where many are, longer keys say
    which of them to compare, unless the buckets of these keys move more sets than that.
    """
    large = common.cut(groups_of(named, "cluster"))
    many = large.where(F.col("out") > FEW * TILE)
    if many.isEmpty():
        return outer_links(named, large, "cluster", grams, percent)
    buckets = common.cut(steep_buckets(named.join(many.select("cluster"), "cluster", "left_semi"), grams, percent))
    shared = common.cut(groups_of(buckets, "bucket").join(buckets.groupBy("bucket").agg(F.min("cluster").alias("cluster")), "bucket"))
    dear = shared.groupBy("cluster").agg(F.sum("moved").alias("by_keys")).join(many, "cluster").where("by_keys >= moved").select("cluster")
    whole = large.where(F.col("out") <= FEW * TILE).unionByName(many.join(dear, "cluster", "left_semi"))
    return outer_links(named, whole, "cluster", grams, percent).unionByName(outer_links(buckets, shared.join(dear, "cluster", "left_anti"), "bucket", grams, percent))


def steep_buckets(named: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(cluster, bucket, node, label, size) of the nodes that share a bucket of longer keys with a node of another label; of buckets
    that hold the same nodes one. A link at the threshold is missed with a chance below one in a thousand."""
    banding = Banding(percent, STEEP)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                keys = side_keys(minhashes([_unpack(x) for x in some.column("grams").to_pylist()], banding.hashes), banding.side)
                for table in tables(keys, banding.side):
                    yield pa.RecordBatch.from_arrays([some.column("cluster"), pa.array(table.view("i8")), some.column("node"), some.column("label"), some.column("size")], names=["cluster", "key", "node", "label", "size"])

    nodes = named.join(grams, "node").select("cluster", "node", "label", "size", "grams")
    rows = common.cut(nodes.mapInArrow(spread, "cluster long, key long, node long, label long, size long").select("cluster", F.xxhash64("cluster", "key").alias("bucket"), "node", "label", "size"))
    kinds = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members")).where("low < high")
    kinds = kinds.groupBy("n", "members").agg(F.min("bucket").alias("bucket")).select("bucket")
    return rows.join(kinds, "bucket", "left_semi")


def near_groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs without white space after lower-casing A-Z; a set holds the distinct five-word shingles, or
    the whole text's words as one where there are fewer. Two rows are linked when their sets' Jaccard similarity
    is at least ``percent`` hundredths; component_id is the smallest doc_id reachable. Null, empty and wordless texts have an
    empty set and are linked with nothing. Rows with equal sets are one node; of rows that repeat both the id
    and the text one is kept. A null id comes after all others.
    """
    banding = Banding(percent)
    signed = common.cut(signatures(docs, banding))
    ordered = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col("tag"))
    classes = common.cut(signed.where("n_shingles > 0").groupBy("set_hash", "n_shingles").agg(F.min(ordered).alias("first")).select("set_hash", "n_shingles", F.col("first.id").alias("id"), F.col("first.tag").alias("node")))
    nodes = signed.select("tag", "keys").join(classes.select(F.col("node").alias("tag"), "node"), "tag").select("node", "keys")
    ties = common.cut(candidate_ties(nodes, banding.side))
    sharing = ties.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = common.cut(classes.join(sharing, "node").select(F.col("id").alias("doc_id"), "set_hash", "node"))
    sets = common.cut(supported(common.cut(needed_sets(docs, needed)), percent))
    clusters = components(candidate_ties(nodes.join(sets.select("node"), "node", "left_semi"), banding.side))
    linked_ = confirmed(sets, clusters, percent)
    # the smallest id among all nodes of a component; a node's own id where it has no link
    labelled = classes.join(linked_, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min(F.struct("id", "node")).alias("least")).select("label", F.col("least.id").alias("least_id"), F.col("least.node").alias("least_node"))
    by_class = labelled.join(least, "label").select("set_hash", "n_shingles", "least_id", "least_node")
    # a hot set meets its class once for each partition, then the partition's rows meet that
    signed = signed.withColumn("run", F.shiftright("tag", 40)).select("run", "tag", "doc_id", "text_hash", "set_hash", "n_shingles")
    in_runs = signed.where("n_shingles > 0").select("run", "set_hash", "n_shingles").distinct().join(by_class, ["set_hash", "n_shingles"])
    return signed.join(in_runs, ["run", "set_hash", "n_shingles"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("least_node").isNull(), F.col("doc_id")).when(F.col("least_id") < 2**63 - 1, F.col("least_id")).alias("component_id"),
        F.coalesce(F.col("tag") == F.col("least_node"), F.lit(True)).alias("kept"),
        "text_hash",
    )


def near_kept(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that near_groups keeps, with all their columns."""
    return common.keep_rows(docs, near_groups(docs, percent))
