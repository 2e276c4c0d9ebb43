"""Bundles of files as a data source: ``spark.read.format("bundles")`` and ``spark.readStream.format("bundles")``.

Rows are cells, as in ``cells``. Partitions are planned by bytes: small files share one, each sheet of a large workbook
and each byte range of a large CSV file, or several where there are many, is one. The option ``only`` chooses bundles, files and sheets before any file is read, and
``spark.read.schema(...)`` with fewer columns makes only those. Paths may be of any file system that Arrow knows.
Filters aren't taken over from the plan: Spark 4.1 keeps what was pushed with the source, so that a second query on the same
DataFrame would read what the filter of the first had left (measured: a count after a filtered count was too low).

A CSV field may hold line breaks, so a range of bytes can't tell by itself whether it begins inside quotes.
``bundle_cells`` lets every range count its quotes and, for either beginning, its line ends; prefix sums over these
few rows tell where each range begins and its first record's number, and the second pass reads all ranges on their own.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import importable
from . import cells

RANGES = "path string, start long, stop long, quotes long, ends_outside long, ends_inside long, odd_outside boolean, odd_inside boolean, utf8 boolean"
#: Bytes of one partition, and what opening a file counts for.
RANGE_BYTES, OPEN_BYTES = 64 << 20, 1 << 20
_ROWS = 8192


@dataclass
class Part(InputPartition):
    """Files, or a piece of one, for one task: (bundle, name, ext, path)."""

    files: list[tuple[str, str, str, str]]
    sheet: int | None = None
    start: int = 0
    stop: int | None = None
    inside: bool = False
    first_row: int = 0
    utf8: bool = True
    more: tuple[Part, ...] = ()  # further pieces that the same task reads

    def __post_init__(self):
        self.value = None  # what InputPartition keeps


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri(f"file://{path}")


@dataclass
class Listing:
    """Files below a folder; a bundle is a folder of the first level."""

    root: str
    only: dict[str, list[str]]

    def files(self) -> Iterator[tuple[tuple[str, str, str, str], int, int]]:
        """((bundle, name, ext, path), bytes, time of change in nanoseconds), in order of path."""
        system, root = _system(self.root)
        root = root.rstrip("/")
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda x: x.path):
            inner = info.path[len(root) + 1 :].split("/")
            name = inner[-1]
            ext = name.rpartition(".")[2].lower()
            if info.type != fs.FileType.File or ext not in ("csv", "xlsx", "docx") or any(x.startswith(("_", ".")) for x in inner):
                continue
            bundle = inner[0] if len(inner) > 1 else ""
            if all(value in self.only.get(column, [value]) for column, value in (("bundle_id", bundle), ("file", name))):
                yield (bundle, name, ext, info.path), info.size, info.mtime_ns


def ranges(size: int, range_bytes: int) -> list[tuple[int, int]]:
    return [(a, min(a + range_bytes, size)) for a in range(0, size, range_bytes)]


def packed(parts: list[Part], tasks: int) -> list[Part]:
    """Ranges that follow each other share a task where there are more than ``tasks`` would need, up to ``RANGE_BYTES``."""
    sizes = [0 if p.stop is None else p.stop - p.start for p in parts]
    most = min(RANGE_BYTES, sum(sizes) // tasks if tasks else 0)
    out, some, used = [], [], 0
    for part, size in zip(parts, sizes):
        if part.stop is None:
            out.append(part)
            continue
        if some and used + size > most:
            out.append(replace(some[0], more=tuple(some[1:])))
            some, used = [], 0
        some.append(part)
        used += size
    return out + ([replace(some[0], more=tuple(some[1:]))] if some else [])


def plan(system: fs.FileSystem, files: Iterable[tuple[tuple[str, str, str, str], int]], range_bytes: int, entries: dict) -> list[Part]:
    """Partitions of files with their sizes. ``entries`` tells of a large CSV file where its ranges begin; without them,
    a file of any size is one partition, read as a stream."""
    parts, some, used = [], [], 0
    for file, size in files:
        if file[3] in entries:
            parts += [Part([file], start=a, stop=b, inside=inside, first_row=row, utf8=utf8) for a, b, inside, row, utf8 in entries[file[3]]]
        elif size <= range_bytes:
            if some and used + size > range_bytes:
                parts.append(Part(some))
                some, used = [], 0
            some.append(file)
            used += max(size, OPEN_BYTES)
        elif file[2] == "xlsx":
            try:
                with system.open_input_file(file[3]) as f, zipfile.ZipFile(f) as z:
                    parts += [Part([file], sheet=k) for k in range(len(cells.workbook(z)[0]))]
            except cells.BROKEN:
                parts.append(Part([file]))
        else:
            parts.append(Part([file]))
    return parts + ([Part(some)] if some else [])


def scan(data: bytes, before: int | None) -> tuple[int, int, int, bool, bool]:
    """(quotes, line ends outside quotes if the range begins outside, if it begins inside, whether a quote opens
    elsewhere than at a field's start or a carriage return stands alone, for either beginning). ``before`` is the byte
    before the range."""
    b = np.frombuffer(data, "u1")
    quote, ends = b == 34, b == 10
    inside = np.logical_xor.accumulate(quote) ^ quote  # before each byte, if the range begins outside
    previous = np.concatenate([np.array([10 if before is None else before], "u1"), b[:-1]])
    opens = quote & (previous != 44) & (previous != 10) & (previous != 34)
    lone = (b == 13) & (np.append(b[1:], np.uint8(10)) != 10)
    odd, within = opens | lone, int(np.count_nonzero(ends & inside))
    return int(np.count_nonzero(quote)), int(np.count_nonzero(ends)) - within, within, bool((odd & ~inside).any()), bool((odd & inside).any())


def _is_utf8(data: bytes) -> bool:
    """Whether a piece of a file is UTF-8 but for characters cut off at its ends."""
    first = next((k for k in range(min(3, len(data))) if data[k] & 0xC0 != 0x80), min(3, len(data)))
    for cut in range(4):
        try:
            data[first : len(data) - cut].decode("utf-8")
            return True
        except UnicodeDecodeError as e:
            if e.end < len(data) - cut - 3:
                return False
    return False


def range_records(f, start: int, stop: int, inside: bool, encoding: str) -> Iterator[list[str]]:
    """The records that begin behind a line end within [start, stop), and the file's first if that is ``start``."""
    f.seek(start)
    at = start

    def lines() -> Iterator[bytes]:
        nonlocal at
        while line := f.readline():
            at += len(line)
            yield line

    source = lines()
    if start:
        for line in source:  # up to the first line end outside quotes
            inside ^= bool(line.count(b'"') & 1)
            if not inside:
                break
    texts = (line.decode(encoding) for line in source)
    if not start:
        texts = (t.removeprefix("\ufeff") if k == 0 else t for k, t in enumerate(texts))
    reader = csv.reader(texts)
    while at <= stop and at - start > 0 or not start and at == 0:
        record = next(reader, None)
        if record is None:
            return
        yield record


class BundleSource(DataSource):
    """Options: path, rangeBytes, ``only`` (JSON: lists of bundle_id, file and sheet), ``what`` (cells or, for planning, ranges
    of large CSV files) and entries."""

    @classmethod
    def name(cls) -> str:
        return "bundles"

    def schema(self) -> str:
        return RANGES if self.options.get("what") == "ranges" else cells.CELLS

    def reader(self, schema: StructType) -> BundleReader:
        return (RangeReader if self.options.get("what") == "ranges" else BundleReader)(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> BundleStream:
        return BundleStream(dict(self.options), schema)


class _Cells:
    """Reads parts into batches of the columns asked for."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.columns, self.only = options, schema.names, json.loads(options.get("only") or "{}")
        self.schema = to_arrow_schema(schema)
        self.tasks = int(self.options.get("tasks") or 0)
        self.range_bytes = int(options.get("rangebytes") or options.get("rangeBytes") or RANGE_BYTES)

    def files(self) -> Iterator[tuple[tuple[str, str, str, str], int, int]]:
        return Listing(self.options["path"], self.only).files()

    def plan(self, files) -> list[Part]:
        system, _ = _system(self.options["path"])
        return packed(plan(system, files, self.range_bytes, json.loads(self.options.get("entries") or "{}")), self.tasks)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        names = [column.split()[0] for column in cells.CELLS.split(", ")]
        places = [names.index(c) for c in self.columns]
        rows = []
        for row in chain.from_iterable(map(self.rows, (part, *part.more))):
            if "sheet" in self.only and row[2] not in self.only["sheet"]:
                continue
            rows.append([row[k] for k in places])
            if len(rows) == _ROWS:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), self.schema.types)], schema=self.schema)

    def rows(self, part: Part) -> Iterator[tuple]:
        system, _ = _system(self.options["path"])
        for bundle, name, ext, path in part.files:
            try:
                with system.open_input_file(path) as f:
                    for cell in self.cells(f, ext, part):
                        yield bundle, name, *cell, None
            except cells.BROKEN as e:
                yield bundle, name, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def cells(self, f, ext: str, part: Part) -> Iterator[tuple[str, int, int, int, str]]:
        if ext == "xlsx":
            yield from cells.xlsx_cells(f, part.sheet)
        elif ext == "docx":
            yield from cells.docx_cells(f)
        else:
            csv.field_size_limit(2**31 - 1)
            if part.stop is None:
                records = cells.csv_records(f)
            else:
                records = range_records(io.BufferedReader(f, 1 << 20), part.start, part.stop, part.inside, "utf-8" if part.utf8 else "latin-1")
            for i, record in enumerate(records, part.first_row):
                for j, x in enumerate(record):
                    if x != "":
                        yield "Sheet1", 0, i, j, x


class BundleReader(_Cells, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.plan((file, size) for file, size, _ in self.files()) or [Part([])]


class RangeReader(_Cells, DataSourceReader):
    """A row for each range of each large CSV file."""

    def partitions(self) -> list[Part]:
        large = [(file, size) for file, size, _ in self.files() if file[2] == "csv" and size > self.range_bytes]
        return packed([Part([file], start=a, stop=b) for file, size in large for a, b in ranges(size, self.range_bytes)], self.tasks) or [Part([])]

    def read(self, part: Part) -> Iterator[tuple]:
        system, _ = _system(self.options["path"])
        for piece in (part, *part.more):
            for *_, path in piece.files:
                with system.open_input_file(path) as f:
                    f.seek(max(piece.start - 1, 0))
                    data = f.read(piece.stop - max(piece.start - 1, 0))
                before, data = (data[0], data[1:]) if piece.start else (None, data)
                yield path, piece.start, piece.stop, *scan(data, before), _is_utf8(data)


class BundleStream(_Cells, DataSourceStreamReader):
    """Files as they arrive, each once, by time of change and path: put them in place by renaming."""

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((at, file[3]) for file, _, at in self.files()), default=(0, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        since, until = (start["time"], start["path"]), (end["time"], end["path"])
        return self.plan((file, size) for file, size, at in self.files() if since < (at, file[3]) <= until)


def register(spark: SparkSession) -> SparkSession:
    """Make the source known to a session."""
    importable(spark).dataSource.register(BundleSource)
    return spark


def range_entries(spans: DataFrame) -> DataFrame:
    """Where each range of a file begins: ``inside`` quotes or not, and the number of its first record. Files with
    quotes or carriage returns in odd places have one range, the whole file."""
    ahead = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("path")
    inside = F.coalesce(F.sum("quotes").over(ahead), F.lit(0)) % 2 == 1
    d = spans.withColumn("inside", inside)
    d = d.withColumn("ends", F.when(F.col("inside"), F.col("ends_inside")).otherwise(F.col("ends_outside"))).withColumn("odd", F.bool_or(F.when(F.col("inside"), F.col("odd_inside")).otherwise(F.col("odd_outside"))).over(every))
    row = F.when(F.col("start") == 0, 0).otherwise(F.sum("ends").over(ahead) + 1)
    return d.withColumn("first_row", row).withColumn("utf8", F.bool_and("utf8").over(every)).where("not odd").select("path", "start", "stop", "inside", "first_row", "utf8")


def bundle_cells(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES, schema: str | None = None, only: dict[str, list[str]] | None = None) -> DataFrame:
    """Cells of all files below ``root``: large CSV files are read in ranges of ``range_bytes``, each by its own task while there
    are few for each core; else a task takes several, so that tasks, which cost more than a small range, don't grow with the input.

    The row index is the number of the record in the file, blank ones counted. ``only`` has lists of ``bundle_id``, ``file`` or
    ``sheet`` to read. The driver holds one entry for each range, as it does for every partition of a scan.
    """
    tasks = 16 * register(spark).sparkContext.defaultParallelism
    spans = spark.read.format("bundles").option("what", "ranges").option("tasks", tasks).option("rangeBytes", range_bytes).option("only", json.dumps(only or {})).load(root)
    entries: dict[str, list] = {}
    for r in range_entries(spans).orderBy("path", "start").collect():
        entries.setdefault(r.path, []).append((r.start, r.stop, r.inside, r.first_row, r.utf8))
    reader = spark.read.format("bundles").option("tasks", tasks).option("rangeBytes", range_bytes).option("only", json.dumps(only or {})).option("entries", json.dumps(entries))
    return (reader.schema(schema) if schema else reader).load(root)


def arriving_cells(spark: SparkSession, root: str) -> DataFrame:
    """Cells of files as they arrive below ``root``."""
    return register(spark).readStream.format("bundles").load(root)
