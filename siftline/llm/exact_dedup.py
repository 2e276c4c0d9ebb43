"""Exact duplicates by a tree-merge of sorted digest runs.

Every partition reduces its texts to a run: sorted SHA-256 digests, each with its smallest identifier and a
count. Runs are exchanged in rounds along a binomial tree. In each round groups of ``2**bits`` runs are merged
and the merged digest range is split into as many parts, so that the number of pieces never grows: after the
last round each holder has one digest range of the whole input. At every level equal 64-bit prefixes are
verified by the whole digest and the text's length before the smaller identifier is retained.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: One entry of a run: digest, length of the text in bytes, rank of the identifier, tag of the row, count.
ENTRY = np.dtype([("sha", "<u8", 4), ("size", "<i8"), ("rank", "<i8"), ("tag", "<i8"), ("n", "<i8")])
_RUN = "node long, part long, entries binary"
#: Entries sorted in memory at once; a partition with more makes several runs.
RUN_ENTRIES = 1_000_000


def merge_runs(entries: np.ndarray) -> np.ndarray:
    """Entries of several sorted runs as one: for each text the smallest (rank, tag), and the sum of counts."""
    if not len(entries):
        return entries
    entries = entries[np.argsort(entries["sha"][:, 0], kind="stable")]  # a stable sort merges runs that are sorted
    same_prefix = entries["sha"][1:, 0] == entries["sha"][:-1, 0]
    same = same_prefix & (entries["sha"][1:] == entries["sha"][:-1]).all(axis=1) & (entries["size"][1:] == entries["size"][:-1])
    if (same != same_prefix).any():  # two texts share a prefix: order by all that tells them apart
        s = entries["sha"]
        entries = entries[np.lexsort((entries["size"], s[:, 3], s[:, 2], s[:, 1], s[:, 0]))]
        same = (entries["sha"][1:] == entries["sha"][:-1]).all(axis=1) & (entries["size"][1:] == entries["size"][:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    best = np.lexsort((entries["tag"], entries["rank"], group))
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    out = entries[best[starts]]
    out["n"] = np.add.reduceat(entries["n"], starts)
    return out


def digests(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """(doc_id, text_hash, sha, size, rank, tag) of each row; texts are lower-cased A-Z only, null counts as empty."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            texts = [(x or "").encode().translate(_LOWER) for x in batch.column(1).to_pylist()]
            flat = ids.fill_null(0).to_numpy(zero_copy_only=False)
            rank = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo("i8").max, flat if keep == "smallest" else ~flat)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(2), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), pa.array([len(x) for x in texts], pa.int64()), pa.array(rank, pa.int64()), pa.array(np.arange(at, at + len(texts)), pa.int64())],
                names=["doc_id", "text_hash", "sha", "size", "rank", "tag"],
            )
            at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(digest, "doc_id long, text_hash long, sha binary, size long, rank long, tag long")


def tree_merge(table: DataFrame, bits: int = 3) -> DataFrame:
    """(sha, size, keep_rank, keep_tag, n) for each text of a table of digests, by rounds of merges."""
    depth = max(0, table.rdd.getNumPartitions() - 1).bit_length()
    steps = [min(bits, depth - at) for at in range(0, depth, bits)]

    def emit(node: int, part: int, entries: np.ndarray, done: int, step: int) -> Iterator[dict]:
        """Splits a merged run by the next ``step`` bits of its digests."""
        top = entries["sha"][:, 0] >> np.uint64(64 - done - step) if done + step else np.zeros(len(entries), "u8")
        cuts = [0, *np.flatnonzero(top[1:] != top[:-1]) + 1, len(entries)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield {"node": node >> step, "part": int(top[a]), "entries": entries[a:b].tobytes()}

    schema = pa.schema([("node", pa.int64()), ("part", pa.int64()), ("entries", pa.binary())])
    first = steps[0] if steps else 0

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, node = [], 0, 0
        for batch in batches:
            e = np.zeros(batch.num_rows, ENTRY)
            e["sha"] = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").reshape(-1, 4)
            for k, name in enumerate(("size", "rank", "tag"), 1):
                e[name] = batch.column(k).to_numpy()
            e["n"] = 1
            node = int(e["tag"][0]) >> 40 if len(e) else node
            held.append(e)
            n += len(e)
            if n >= RUN_ENTRIES:
                yield pa.RecordBatch.from_pylist(list(emit(node, 0, merge_runs(np.concatenate(held)), 0, first)), schema)
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_pylist(list(emit(node, 0, merge_runs(np.concatenate(held)), 0, first)), schema)

    def merge_at(done: int, step: int):
        def merge(run: pa.Table) -> pa.Table:
            merged = merge_runs(np.frombuffer(b"".join(run.column("entries").to_pylist()), ENTRY))
            return pa.Table.from_pylist(list(emit(run.column("node")[0].as_py(), run.column("part")[0].as_py(), merged, done, step)), schema)

        return merge

    runs, done = table.select("sha", "size", "rank", "tag").mapInArrow(local, _RUN), first
    for step in [*steps[1:], 0]:
        runs = runs.groupBy("node", "part").applyInArrow(merge_at(done, step), _RUN)
        done += step

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                e = np.frombuffer(x, ENTRY)
                sha = e["sha"].astype(">u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sha[k : k + 32] for k in range(0, len(sha), 32)], pa.binary()), *(pa.array(np.ascontiguousarray(e[c]), pa.int64()) for c in ("size", "rank", "tag", "n"))],
                    names=["sha", "size", "keep_rank", "keep_tag", "n"],
                )

    return runs.select("entries").mapInArrow(unpack, "sha binary, size long, keep_rank long, keep_tag long, n long")


def exact_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the smallest (or ``keep="largest"``) doc_id stays; rows without id
    stay only if the group has no other. Rows that repeat both id and text count in group_size and one of
    them stays. Two rows are taken as equal when SHA-256 and length agree.

    A hot text is joined in two steps: each run meets it once, then the rows of a run meet their run's entry,
    so no join key has more rows than a run or than there are runs.
    """
    table = common.cut(digests(docs, keep)).withColumn("run", F.shiftright("tag", 40))
    best = tree_merge(table)
    in_runs = table.select("run", "sha", "size").distinct()
    down = in_runs.join(best, ["sha", "size"])
    keep_id = F.col("keep_rank") if keep == "smallest" else F.bitwise_not(F.col("keep_rank"))
    return table.join(down, ["run", "sha", "size"]).select(
        "doc_id",
        F.when(F.col("keep_rank") != F.lit(2**63 - 1), keep_id).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("tag") == F.col("keep_tag")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "text_hash",
    )


def exact_kept(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that exact_groups keeps, with all their columns."""
    return common.keep_rows(docs, exact_groups(docs, keep))
