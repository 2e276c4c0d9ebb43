"""Best-fit packing of token sequences by a hierarchy of residual bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import default_vocabulary, encoder

#: What is kept of a piece: its document, number, start, length, crc32, and whether the document has no id.
FIELDS = 6
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one worker packs at once.
RUN_PIECES = 500_000
_BINS = "node long, open boolean, fill int, sequence_id long, pieces binary"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Positions of the items of each bin; each item goes to the fullest bin that has room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    rooms = 0  # bit r: some bin has room r
    for k in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[k])
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


def cut_pieces(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32): whole if it fits, else full pieces after a first one that may be shorter."""
    n = len(ids) // 4
    first = n % capacity or capacity
    ends = [n] if n <= capacity else [first, *range(first + capacity, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip([0, *ends], ends)]


def token_pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each row of ``docs``, ``end_id`` after each document."""
    vocabulary = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            found = encoder(vocabulary).encode_column(batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), found):
                rows += [(doc_id, k, *x) for k, x in enumerate(cut_pieces(ids.tobytes() + end, capacity))]
            cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 1 else pa.int64()) for k, x in enumerate(cols)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.only(docs, "doc_id", "text").mapInArrow(encode, _PIECES)


def pack_pieces(pieces: DataFrame, capacity: int, slack: int | None = None, fan_in: int = 8) -> DataFrame:
    """Put each piece into a sequence of at most ``capacity`` ids.

    Each partition packs its pieces best-fit, decreasing. Bins with at most ``slack`` free places are done;
    the others go up a tree of groups of ``fan_in`` and are packed again as single items, until one group is
    left; a bin at most half full is taken apart on the way, since its pieces fit where it doesn't.

    Of a group's bins only the ``fan_in * capacity / 2`` emptiest go up, so that no task's input grows with the
    table, and nothing is lost by that. After best fit any two bins hold more than ``capacity`` together, so two
    that are more than half full never share a bin, and at most one bin of a group is taken apart. What is taken
    apart in the next group is at most that many ids, in as many pieces at most; a piece that fits a bin that
    stayed behind fits each emptier one, and one of those is still as it was. No piece is left out. Adds
    sequence_id and offset; within a sequence offsets have no gaps. Ties go by doc_id and piece; null ids count
    as 0 for that.
    """
    slack = capacity // 64 if slack is None else slack
    carry = fan_in * capacity // 2

    def rows(level: int, node: int, first: int, sizes: np.ndarray, held: list[bytes], last: bool) -> pa.RecordBatch:
        bins = best_fit_decreasing(sizes, capacity)
        fill = np.array([int(sizes[x].sum()) for x in bins], "i8")
        may = np.flatnonzero(fill < capacity - slack) if not last else np.empty(0, "i8")
        is_open = np.zeros(len(bins), bool)
        is_open[may[np.argsort(fill[may], kind="stable")][:carry]] = True
        number = [(level << 56) | (node << 32) | (first + k) for k in range(len(bins))]
        return pa.RecordBatch.from_arrays(
            [pa.array([node // fan_in] * len(bins), pa.int64()), pa.array(is_open), pa.array(fill, pa.int32()), pa.array(number, pa.int64()), pa.array([b"".join(held[k] for k in x) for x in bins], pa.binary())],
            names=["node", "open", "fill", "sequence_id", "pieces"],
        )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node, first, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            cols = [x.to_numpy(zero_copy_only=False) for x in (batch.column(0).fill_null(0), *batch.columns[1:], batch.column(0).is_null())]
            held.append(np.stack([x.astype("<i8") for x in cols], axis=1))
            n += len(held[-1])
            if n >= RUN_PIECES:  # bounds a worker's memory; what half fills a bin goes on into the next run
                done, rest = pack(node, first, np.concatenate(held), True)
                yield done
                first, held, n = first + n, [rest], len(rest)
        if n:
            yield pack(node, first, np.concatenate(held), False)[0]

    def pack(node: int, first: int, items: np.ndarray, more: bool) -> tuple[pa.RecordBatch, np.ndarray]:
        items = items[np.lexsort((items[:, 1], items[:, 0]))]
        rest = np.zeros(len(items), bool)
        if more:
            for x in best_fit_decreasing(items[:, 3], capacity):
                if 2 * items[x, 3].sum() <= capacity:
                    rest[x] = True
        done = items[~rest]
        return rows(0, node, first, done[:, 3], [x.tobytes() for x in done], last=False), items[rest]

    def merge_at(level: int):
        def merge(table: pa.Table) -> pa.Table:
            table = table.sort_by("sequence_id")
            node = table.column("node")[0].as_py()
            sizes, held = [], []
            for fill, pieces_ in zip(table.column("fill").to_pylist(), table.column("pieces").to_pylist()):
                parts = [pieces_] if 2 * fill > capacity else [pieces_[k : k + 8 * FIELDS] for k in range(0, len(pieces_), 8 * FIELDS)]
                held += parts
                sizes += [fill] if len(parts) == 1 else [int.from_bytes(x[24:32], "little") for x in parts]
            return pa.Table.from_batches([rows(level, node, 0, np.array(sizes, "i8"), held, last=level == levels)])

        return merge

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(x, "<i8").reshape(-1, FIELDS) for x in batch.column(1).to_pylist()]
            counts = [len(x) for x in items]
            sequence = np.repeat(batch.column(0).to_numpy(), counts)
            offset = np.concatenate([np.cumsum(x[:, 3]) - x[:, 3] for x in items]) if items else np.empty(0, "i8")
            flat = np.concatenate(items) if items else np.empty((0, FIELDS), "i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[:, 0], mask=flat[:, 5] != 0), pa.array(flat[:, 1], pa.int32()), *(pa.array(flat[:, k]) for k in (2, 3, 4)), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    pieces = common.cut(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"))
    levels, width = 0, pieces.rdd.getNumPartitions()
    while width > 1 or not levels:
        levels, width = levels + 1, -(-width // fan_in)
    spread = common.cut(pieces.mapInArrow(local, _BINS))
    done = spread.where(~F.col("open"))
    for level in range(1, levels + 1):
        spread = common.cut(spread.where("open").groupBy("node").applyInArrow(merge_at(level), _BINS))
        done = done.unionByName(spread.where(~F.col("open")))
    return done.select("sequence_id", "pieces").mapInArrow(unpack, f"{_PIECES}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text), cut what is longer than ``capacity`` and pack all pieces.

    Null text counts as empty and still has its ``end_id``; repeated rows are packed once each; a null id
    stays null.
    """
    return pack_pieces(token_pieces(docs, capacity, end_id, vocabulary), capacity)
