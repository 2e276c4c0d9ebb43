"""The data source of bundles against the csv module, in ranges of every size, with filters, dates and arriving files."""

from __future__ import annotations

import csv
import io
import os
import random
import zipfile

import pytest

from siftline.sources import bundle_source as BS
from siftline.sources import cells

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _random_csv(rng: random.Random, odd: bool = False) -> bytes:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    for _ in range(rng.randrange(1, 30)):
        writer.writerow(["".join(rng.choices(["a", "ü", '"', ",", "\n", "\r\n", " ", "漢", "1"], k=rng.randrange(0, 8))) for _ in range(rng.randrange(1, 4))])
    text = out.getvalue()
    return (text + ('5" pipe,x\n' if odd else "")).encode()


def _plain(data: bytes) -> list[tuple[int, int, str]]:
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return [(i, j, x) for i, row in enumerate(csv.reader(io.StringIO(text, newline=""))) for j, x in enumerate(row) if x != ""]


def test_ranges_of_any_size_tile_the_records():
    rng = random.Random(7)
    for _ in range(300):
        data, size = _random_csv(rng), rng.randrange(1, 40)
        inside, row, found, odd = False, 0, [], False
        for a, b in BS.ranges(len(data), size):
            quotes, outside_ends, inside_ends, odd_outside, odd_inside = BS.scan(data[a:b], data[a - 1] if a else None)
            odd |= odd_inside if inside else odd_outside
            first = row + 1 if a else 0
            found += [(i, j, x) for i, record in enumerate(BS.range_records(io.BytesIO(data), a, b, inside, "utf-8"), first) for j, x in enumerate(record) if x != ""]
            row += inside_ends if inside else outside_ends
            inside ^= bool(quotes & 1)
        if not odd:
            assert found == _plain(data), data


def test_pieces_of_utf8_are_known():
    data = "aü漢𝄞z".encode() * 3
    assert all(BS._is_utf8(data[a:b]) for a in range(len(data)) for b in range(a, len(data) + 1))
    assert not BS._is_utf8(b"abc \xfc def ghi") and not BS._is_utf8(b"\xff\xfe a b c d e f")


@pytest.fixture()
def root(tmp_path):
    rng = random.Random(3)
    files = {"p1/a.csv": _random_csv(rng) * 40, "p1/b.csv": "﻿x,y\n1,2\n\n3,4\n".encode(), "p2/odd.csv": _random_csv(rng, odd=True) * 30, "p2/latin.csv": "stra\xdfe,1\n".encode("latin-1") * 200, "p2/mac.csv": b"a,b\rc,d\r" * 100}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "p3").mkdir()
    (tmp_path / "p3" / "bad.xlsx").write_bytes(b"no archive")
    (tmp_path / "p3" / "notes.txt").write_text("not a table")
    return tmp_path, files


@pytest.mark.parametrize("range_bytes", [37, 500, 1 << 20])
def test_files_in_ranges(spark, root, range_bytes):
    folder, files = root
    df = BS.bundle_cells(spark, str(folder), range_bytes)
    got = {}
    for r in df.where("error is null").collect():
        got.setdefault(f"{r.bundle_id}/{r.file}", []).append((r.row_idx, r.col_idx, r.raw))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(_plain(v)) for k, v in files.items()}
    assert [r.file for r in df.where("error is not null").collect()] == ["bad.xlsx"]
    if range_bytes == 500:
        assert df.rdd.getNumPartitions() > len(files) + len(files["p1/a.csv"]) // 500 - 3  # large files in many tasks


def test_files_are_chosen_and_columns_pruned(spark, root):
    folder, files = root
    df = BS.bundle_cells(spark, str(folder), 1 << 20, "file string, raw string", {"file": ["b.csv"]})
    assert df.columns == ["file", "raw"] and sorted(r.raw for r in df.collect()) == ["1", "2", "3", "4", "x", "y"]
    whole = BS.bundle_cells(spark, str(folder), 200)
    every = whole.count()
    one = BS.bundle_cells(spark, str(folder), 200, only={"bundle_id": ["p1"], "file": ["b.csv"]})
    assert one.rdd.getNumPartitions() == 1 < whole.rdd.getNumPartitions() and one.count() == 6
    assert whole.where("bundle_id = 'p1'").count() < every == whole.count()  # a filter leaves the next query alone
    assert BS.bundle_cells(spark, str(folder), only={"bundle_id": ["p3"], "sheet": ["Sheet1"]}).count() == 0


def _workbook(sheets: int = 2) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}"><sheets>' + "".join(f'<sheet name="S{k}"/>' for k in range(sheets)) + "</sheets></workbook>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm&quot;d&quot;"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        for k in range(sheets):
            rows = "".join(f'<row r="{i + 1}"><c r="A{i + 1}"><v>{k * 1000 + i}</v></c><c r="B{i + 1}" s="{i % 4}"><v>45000.25</v></c><c r="C{i + 1}" t="inlineStr"><is><t>{"x" * 50}</t></is></c></row>' for i in range(60))
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_sheets_are_partitions_and_dates_are_dates(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "w.xlsx").write_bytes(_workbook(3))
    df = BS.bundle_cells(spark, str(tmp_path), 100)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 3 * 60 * 3
    got = {(r.sheet, r.row_idx, r.col_idx): r.raw for r in df.collect()}
    assert got["S2", 5, 0] == "2005" and [got["S1", i, 1] for i in range(4)] == ["45000.25", "2023-03-15 06:00:00", "2023-03-15 06:00:00", "45000.25"]
    assert df.where("sheet = 'S1'").count() == 180 == BS.bundle_cells(spark, str(tmp_path), 100, only={"sheet": ["S2"]}).count()


def test_days_of_workbooks():
    from datetime import datetime

    day = lambda x: cells._as_date(x, datetime(1899, 12, 30))
    assert [day("1"), day("59"), day("61"), day("0.5"), day("45000"), day("45000.5")] == ["1900-01-01", "1900-02-28", "1900-03-01", "12:00:00", "2023-03-15", "2023-03-15 12:00:00"]


def test_arriving_files_are_read_once(spark, tmp_path):
    root, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    (root / "p1").mkdir(parents=True)

    def arrive(name, data, at):
        (root / name).write_bytes(data)
        os.utime(root / name, (at, at))

    def run():
        cells_ = BS.arriving_cells(spark, str(root)).select("bundle_id", "file", "row_idx", "col_idx", "raw")
        cells_.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.file, r.raw) for r in spark.read.parquet(str(out)).collect())

    arrive("p1/a.csv", b"1,2\n", 1000)
    arrive("p1/b.csv", b"3\n", 1000)
    assert run() == [("a.csv", "1"), ("a.csv", "2"), ("b.csv", "3")]
    arrive("p1/c.csv", b"4\n", 2000)
    assert run() == [("a.csv", "1"), ("a.csv", "2"), ("b.csv", "3"), ("c.csv", "4")]
    assert len(run()) == 4


def test_many_ranges_share_tasks(spark, tmp_path):
    """More ranges than some for each core are read by no more tasks than that, and every record once."""
    (tmp_path / "p").mkdir()
    for name in ("a", "b"):
        (tmp_path / "p" / f"{name}.csv").write_text("".join(f'{k},"x\n""{k}"""\n' for k in range(4000)))
    df = BS.bundle_cells(spark, str(tmp_path), 50)
    tasks = 16 * spark.sparkContext.defaultParallelism
    assert sum(p.stat().st_size for p in (tmp_path / "p").iterdir()) // 50 > 10 * tasks and 8 < df.rdd.getNumPartitions() <= 2 * tasks
    got = sorted((r.file, r.row_idx, r.col_idx, r.raw) for r in df.collect())
    assert got == sorted((f"{n}.csv", k, j, x) for n in "ab" for k in range(4000) for j, x in enumerate((str(k), f'x\n"{k}"')))
