"""Token-ID files: patched frame-of-reference blocks with an index of block starts.

A file holds the ids of a run of documents, ascending by document id::

    magic | block ... | block starts | document ids | null flags | ids per document | trailer

A block has up to ``BLOCK`` ids: their minimum, a bit width that holds at least nine tenths of the
differences from it, the low bits of all differences packed at that width, and a list of positions and
high bits for the exceptions. The trailer says where the lists begin, so a reader can seek to any block.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import default_vocabulary, encoder

MAGIC, BLOCK, FIT = b"SLPFOR01", 2048, 0.9
_HEAD, _TRAIL = struct.Struct("<IHHB"), struct.Struct("<QQQ8s")
_FLUSH = 256 * BLOCK


def pack_block(ids: np.ndarray) -> bytes:
    """One block of 1 to ``BLOCK`` unsigned 32-bit ids."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype("<u4")
    bits = np.frexp(rest.astype("f8"))[1]
    width = int(np.partition(bits, k := int(FIT * (len(bits) - 1)))[k])
    odd = np.flatnonzero(bits > width).astype("<u2")
    flat = np.unpackbits(rest.view("u1").reshape(len(rest), 4), axis=1, bitorder="little")[:, :width]
    body = np.packbits(flat.reshape(-1), bitorder="little").tobytes()
    high = (rest[odd].astype("u8") >> np.uint64(width)).astype("<u4")
    return _HEAD.pack(low, len(rest), len(odd), width) + body + odd.tobytes() + high.tobytes()


def unpack_block(data: bytes) -> np.ndarray:
    low, n, n_odd, width = _HEAD.unpack_from(data)
    at = _HEAD.size
    size = (n * width + 7) // 8
    full = np.zeros((n, 32), "u1")
    if width:
        full[:, :width] = np.unpackbits(np.frombuffer(data, "u1", size, at), count=n * width, bitorder="little").reshape(n, width)
    rest = np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(n).copy()
    odd = np.frombuffer(data, "<u2", n_odd, at + size)
    high = np.frombuffer(data, "<u4", n_odd, at + size + 2 * n_odd)
    rest[odd] |= (high.astype("u8") << np.uint64(width)).astype("<u4")
    return rest + np.uint32(low)


class Writer:
    """Writes one file to any open binary stream."""

    def __init__(self, out):
        self.out, self.at, self.starts = out, 0, []
        self.ids, self.nulls, self.sizes = [], [], []
        self.held, self.n_held, self.n_ids = [], 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _blocks(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        end = len(ids) if last else len(ids) - len(ids) % BLOCK
        for k in range(0, end, BLOCK):
            self.starts.append(self.at)
            self._put(pack_block(ids[k : min(k + BLOCK, end)]))
        self.held = [ids[end:].tobytes()]
        self.n_held = len(ids) - end

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_held >= _FLUSH:
            self._blocks(False)

    def close(self) -> None:
        self._blocks(True)
        lists = self.at
        for what, kind in ((self.starts, "<u8"), (self.ids, "<i8"), (self.nulls, "u1"), (self.sizes, "<u8")):
            self._put(np.asarray(what, kind).tobytes())
        self._put(_TRAIL.pack(lists, len(self.starts), len(self.ids), MAGIC))


def read_file(source, size: int, share: int = 0, shares: int = 1) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, place in the file, ids) of the documents of one file, or of one of ``shares`` even parts of them.

    ``source`` has seek and read. Only blocks that hold ids of the part are read, from where the index says.
    """

    def piece(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    lists, n_blocks, n_docs, magic = _TRAIL.unpack(piece(size - _TRAIL.size, _TRAIL.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    tail = piece(lists, size - _TRAIL.size - lists)
    starts = np.frombuffer(tail, "<u8", n_blocks).astype("i8")
    ids = np.frombuffer(tail, "<i8", n_docs, 8 * n_blocks)
    nulls = np.frombuffer(tail, "u1", n_docs, 8 * (n_blocks + n_docs))
    sizes = np.frombuffer(tail, "<u8", n_docs, 8 * n_blocks + 9 * n_docs).astype("i8")
    before = np.concatenate([[0], np.cumsum(sizes)])
    first, last = n_docs * share // shares, n_docs * (share + 1) // shares
    ends = np.append(starts[1:], lists)
    held, block = np.empty(0, "<u4"), int(before[first]) // BLOCK  # every block but the last holds BLOCK ids
    skip = int(before[first]) - block * BLOCK
    for doc_id, null, at, n in zip(ids[first:last].tolist(), nulls[first:last].tolist(), before[first:last].tolist(), sizes[first:last].tolist()):
        parts, have = [held], len(held)
        while have < n:
            parts.append(unpack_block(piece(int(starts[block]), int(ends[block] - starts[block])))[skip:])
            have += len(parts[-1])
            block, skip = block + 1, 0
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield (None if null else doc_id), at, held[:n]
        held = held[n:]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", uri))


def write_token_files(docs: DataFrame, folder: str, end_id: int, vocabulary: str | None = None, files: int | None = None, file_bytes: int = 128 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write one file for each range of document ids.

    There are as many files as shuffle partitions, or more, so that each takes about ``file_bytes`` of text. Null
    text counts as empty; rows without id come first; rows that repeat an id keep a document each, by a hash of
    their texts, and ranges may part them. Returns the manifest (part, path, n_docs, n_ids), a row for each file,
    written to the shared folder. A task that runs again writes a new file; the manifest names only files of
    tasks that succeeded.
    """
    if files is None:
        files = max(common.partitions(docs), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // file_bytes))
    vocabulary = vocabulary or default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store, path = _store(folder)
                store.create_dir(path, recursive=True)
                name = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.pfor"
                stream = store.open_output_stream(name)
                out, ids = Writer(stream), encoder(vocabulary)
            end = np.array([end_id], "<u4").tobytes()
            for doc_id, found in zip(batch.column(0).to_pylist(), ids.encode_column(batch.column(1))):
                out.add(doc_id, found.tobytes() + end)
        if out is not None:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [name], "n_docs": pa.array([len(out.ids)], pa.int64()), "n_ids": pa.array([out.n_ids], pa.int64())})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("from"))
    ranged = keyed.repartitionByRange(files, "doc_id", "h", "from").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return common.cut(ranged.mapInArrow(write, "part long, path string, n_docs long, n_ids long"))


def read_token_files(manifest: DataFrame, folder: str, share_ids: int = 1 << 24) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; a large file is read in parts."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = _store(folder)
                rows = []
                with store.open_input_file(row["path"]) as source:
                    for doc_id, at, ids in read_file(source, source.size(), row["share"], row["shares"]):
                        rows.append((doc_id, row["before"] + at, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 20_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c, d = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c, d)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    found = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("shares", F.ceil(F.col("n_ids") / share_ids))
    found = found.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    return found.repartition(common.partitions(manifest), "part", "share").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, end_id: int = 2, vocabulary: str | None = None, files: int | None = None) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    folder = f"{common.shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, end_id, vocabulary, files), folder)
