"""Source tables as one long table of cells, whatever the file kind.

``cells``: bundle_id, file, sheet, sheet_ord, row_idx, col_idx, raw. Spreadsheet and document files are ZIP
archives of XML and are read with the standard library inside ``mapInPandas`` or the data source of ``bundle_source``; a
file that can't be read gives one row with ``error``, after the cells that could be.
"""

from __future__ import annotations

import codecs
import csv
import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, time, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "bundle_id string, file string, sheet string, sheet_ord int, row_idx int, col_idx int, raw string, error string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def csv_cells(spark: SparkSession, path: str, bundle: str = "") -> DataFrame:
    """Cells of CSV files, header included; the row index counts the records of a file that aren't blank."""
    files = spark.read.format("binaryFile").load(path)
    listing = files.select(F.lit(bundle).alias("bundle_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("csv").alias("ext"), "content")
    return archive_cells(listing)


def _csv(f) -> Iterator[tuple[str, int, int, int, str]]:
    for i, row in enumerate(r for r in csv_records(f) if any(r)):
        yield from (("Sheet1", 0, i, j, x) for j, x in enumerate(row) if x != "")


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def workbook(z: zipfile.ZipFile) -> tuple[list[str], list[str]]:
    """Titles and member names of a workbook's sheets, in its order."""
    names = z.namelist()
    found = list(ElementTree.parse(z.open("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
    if "xl/_rels/workbook.xml.rels" in names:  # which file holds a sheet is told by the workbook's relations
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).iter() if r.get("Id")}
        sheets = [re.sub("^(/?xl/)?", "xl/", targets[s.get(_ID)]) for s in found]
    else:
        sheets = sorted((x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.search(r"\d+", x)[0]))
    return [s.get("name") for s in found], sheets


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date or a time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.parse(z.open("xl/styles.xml"))
    codes = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower() for f in root.iter(f"{_MAIN}numFmt")}
    kinds = [int(x.get("numFmtId", 0)) for part in root.iter(f"{_MAIN}cellXfs") for x in part.iter(f"{_MAIN}xf")]
    return {k for k, kind in enumerate(kinds) if 14 <= kind <= 22 or 45 <= kind <= 47 or re.search("[ymdhs]", codes.get(kind, ""))}


def _as_date(number: str, epoch: datetime) -> str:
    """A day number of a workbook as ISO date, or date and time; a share of a day alone as time."""
    days = float(number)
    if epoch.year == 1899 and days < 60:
        days += days >= 1  # the calendar of 1900 has a 29 February that never was
    at = epoch + timedelta(seconds=round(days * 86_400))
    return at.strftime("%H:%M:%S") if 0 <= days < 1 else at.strftime("%Y-%m-%d") if at.time() == time() else at.strftime("%Y-%m-%d %H:%M:%S")


def xlsx_cells(f, sheet: int | None = None) -> Iterator[tuple[str, int, int, int, str]]:
    """Cells of a workbook, or of one of its sheets; each sheet's XML is read as a stream. Dates come in ISO form."""
    with zipfile.ZipFile(f) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.parse(z.open("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates = _date_styles(z)
        late = any(p.get("date1904") in ("1", "true") for p in ElementTree.parse(z.open("xl/workbook.xml")).iter(f"{_MAIN}workbookPr"))
        epoch = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        for k, (title, member) in enumerate(zip(*workbook(z))):
            if sheet is not None and k != sheet:
                continue
            for _, row in ElementTree.iterparse(z.open(member)):
                if row.tag != f"{_MAIN}row":
                    continue
                for c in row.iter(f"{_MAIN}c"):
                    ref, v, kind = c.get("r", "A1"), c.find(f"{_MAIN}v"), c.get("t", "n")
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if kind == "inlineStr" else None if v is None else v.text
                    if text is not None and kind == "s":
                        text = shared[int(text)]
                    elif text is not None and kind == "b":
                        text = "TRUE" if text == "1" else "FALSE"
                    elif text is not None and kind == "n" and int(c.get("s", 0)) in dates:
                        text = _as_date(text, epoch)
                    if text not in (None, ""):
                        yield title, k, int(re.search(r"\d+", ref)[0]) - 1, _column(ref), text
                row.clear()


def docx_cells(f) -> Iterator[tuple[str, int, int, int, str]]:
    with zipfile.ZipFile(f) as z:
        tables = [t for t in ElementTree.parse(z.open("word/document.xml")).iter(f"{_WORD}tbl") if len(list(t.iter(f"{_WORD}tr"))) >= 2]
        for k, table in enumerate(tables):
            for i, row in enumerate(table.iter(f"{_WORD}tr")):
                for j, cell in enumerate(row.iter(f"{_WORD}tc")):
                    if text := "".join(t.text or "" for t in cell.iter(f"{_WORD}t")).strip():
                        yield f"Table{k + 1}", k, i, j, text


def csv_records(f) -> Iterator[list[str]]:
    """Records of a CSV file, as a stream: UTF-8 with or without a mark, else Latin-1."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    encoding = "utf-8-sig"
    try:
        while piece := f.read(1 << 20):
            decoder.decode(piece)
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        encoding = "latin-1"
    f.seek(0)
    csv.field_size_limit(2**31 - 1)  # a cell may be as long as it likes
    yield from csv.reader(io.TextIOWrapper(f, encoding, newline=""))


_READERS = {"csv": _csv, "xlsx": xlsx_cells, "docx": docx_cells}
#: What reading a broken file may raise.
BROKEN = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError, OverflowError, csv.Error)


def archive_cells(listing: DataFrame) -> DataFrame:
    """Cells of csv, xlsx and docx files of a listing with ``content``, some thousand rows at a time. Dates of workbooks
    come in ISO form."""

    def rows(frames):
        for frame in frames:
            for bundle, file, ext, content in zip(frame.bundle_id, frame.name, frame.ext, frame.content):
                try:
                    for cell in _READERS[ext](io.BytesIO(content)):
                        yield bundle, file, *cell, None
                except BROKEN as e:
                    yield bundle, file, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def read(frames):
        import pandas as pd

        every = rows(frames)
        while some := list(itertools.islice(every, 8192)):
            yield pd.DataFrame(some, columns=["bundle_id", "file", "sheet", "sheet_ord", "row_idx", "col_idx", "raw", "error"]).astype({"sheet_ord": "Int32", "row_idx": "Int32", "col_idx": "Int32"})

    return listing.where(F.col("ext").isin(*_READERS)).select("bundle_id", "name", "ext", "content").mapInPandas(read, CELLS)


def sub_tables(cells: DataFrame) -> DataFrame:
    """Sheets split at label rows (a lone text in the first used cell); adds ``segment`` and ``label``."""
    sheet = ["bundle_id", "file", "sheet"]
    rows = cells.where("raw is not null").groupBy(*sheet, "row_idx").agg(F.count("*").alias("filled"), F.min_by("raw", "col_idx").alias("first"))
    is_label = (F.col("filled") == 1) & F.col("first").try_cast("double").isNull()
    w = Window.partitionBy(*sheet).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("is_label", is_label).withColumn("segment", F.sum(F.col("is_label").cast("int")).over(w)).withColumn("label", F.last(F.when(F.col("is_label"), F.col("first")), ignorenulls=True).over(w))
    return cells.join(rows.select(*sheet, "row_idx", "segment", "label", "is_label").hint("merge"), [*sheet, "row_idx"])


def with_headers(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Named numeric cells: the header is the row above the first row with half or more numbers; names that repeat
    get a count, empty ones their column's number. What the joins bring in has a row for each sheet, row or column and is
    merged: the planner guesses its size from the files', and would send it whole through the driver."""
    number = F.col("raw").try_cast("double")
    ratio = cells.where("raw is not null and not is_label").groupBy(*keys, "row_idx").agg(F.avg(number.isNotNull().cast("double")).alias("numeric"))
    first = ratio.where("numeric >= 0.5").groupBy(*keys).agg(F.min("row_idx").alias("first_data"))
    above = ratio.join(first.hint("merge"), keys).where("row_idx < first_data").groupBy(*keys).agg(F.max("row_idx").alias("header_row"))
    names = cells.join(above.hint("merge"), keys).where("row_idx = header_row").select(*keys, "col_idx", F.col("raw").alias("name"))
    names = names.withColumn("again", F.row_number().over(Window.partitionBy(*keys, "name").orderBy("col_idx")) - 1).withColumn("name", F.when(F.col("again") > 0, F.concat_ws("_", "name", "again")).otherwise(F.col("name"))).drop("again")
    data = cells.join(first.hint("merge"), keys).where("row_idx >= first_data")
    named = data.join(names.hint("merge"), [*keys, "col_idx"], "left").withColumn("col_name", F.coalesce("name", F.concat(F.lit("col_"), "col_idx"))).withColumn("v", F.when(~F.isnan(number), number))
    some = named.groupBy(*keys, "col_idx").agg(F.count("v").alias("numbers")).where("numbers > 0")
    return named.join(some.select(*keys, "col_idx").hint("merge"), [*keys, "col_idx"], "left_semi").select(*keys, "row_idx", "col_idx", "col_name", "raw", "v")
