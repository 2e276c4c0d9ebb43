"""Rules of reading files and references, filters and folds that the queries' tables can't show."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siftline.functions import roles as R
from siftline.functions import strings as S
from siftline.operators import images as I
from siftline.operators import records as D
from siftline.operators import sheets as H
from siftline.plans import score
from siftline.sources import bundles, cells

from .test_rules import findings, overall


def test_csv_records_with_line_breaks_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfname,note\r\n"x, y","two\nlines and ""quotes"""\r\n\r\n,' + b"z" * 2_000_000 + b"\n")
    got = sorted((r.row_idx, r.col_idx, r.raw) for r in cells.csv_cells(spark, str(tmp_path / "a.csv"), "b").collect())
    assert got[:4] == [(0, 0, "name"), (0, 1, "note"), (1, 0, "x, y"), (1, 1, 'two\nlines and "quotes"')] and len(got[4][2]) == 2_000_000 and got[4][:2] == (2, 1)


def test_sheets_follow_the_workbooks_relations(spark):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="A" r:id="r2"/><sheet name="B" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        for k, v in ((1, '<c r="A1"><v>1</v></c>'), (2, '<c r="B2" t="b"><v>1</v></c>')):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {main}><sheetData><row>{v}</row></sheetData></worksheet>")
    listing = spark.createDataFrame([("b", "x.xlsx", "xlsx", bytearray(out.getvalue()))], "bundle_id string, name string, ext string, content binary")
    assert sorted((r.sheet, r.sheet_ord, r.row_idx, r.col_idx, r.raw) for r in cells.archive_cells(listing).collect()) == [("A", 0, 1, 1, "TRUE"), ("B", 1, 0, 0, "1")]


def test_names_of_controls_are_no_measurements(spark):
    names = ["baseline value", "background", "reference arm", "calibrated", "bg signal", "ctrl", "tumor volume", "growth"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(R.is_measurement_name(F.col("n")).alias("m")).collect()
    assert [r.m for r in got] == [False] * 6 + [True] * 2


@pytest.mark.parametrize("name, length, score_", [("p1.pdf", 300_000, 82), ("p1_main.pdf", 10, 85), ("scan_of_p1.pdf", 10, 35), ("author_response.pdf", 10, -120), ("审稿.pdf", 10, -85), ("other.pdf", 90_000_000, 0)])
def test_main_file_scores(spark, name, length, score_):
    got = bundles.main_file(spark.createDataFrame([("p1", name, "pdf", length)], "bundle_id string, name string, ext string, length long")).first()
    assert got.score == score_


def test_crawled_and_standalone_files(spark):
    rows = [("b", "/r/b/source_data/x.xlsx", "x.xlsx", "xlsx"), ("b", "/r/b/supp/s1.pdf", "s1.pdf", "pdf"), ("b", "/r/b/supp/reporting_summary.pdf", "reporting_summary.pdf", "pdf"), ("b", "/r/b/page.html", "page.html", "html")]
    got = bundles.crawled(spark.createDataFrame(rows, "bundle_id string, path string, name string, ext string"))
    assert sorted((r["name"], r.kind) for r in got.collect()) == [("s1.pdf", "supplement"), ("x.xlsx", "data")]
    images = spark.createDataFrame([("b", "/b/figures/1.png", False), ("b", "/b/p3.png", True), ("c", "/c/figures/1.png", False)], "bundle_id string, path string, from_pdf boolean")
    assert sorted(r.path for r in bundles.without_standalone_figures(images).collect()) == ["/b/p3.png", "/c/figures/1.png"]


def test_manifests_and_reports(spark, tmp_path):
    for b, text in (("b1", '{"doi": " 10.1/X ", "title": "T", "html": "p.html"}'), ("b2", "no json")):
        (tmp_path / b).mkdir()
        (tmp_path / b / "manifest.json").write_text(text)
    got = {r.bundle_id: (r.doi, r.page, r.error) for r in D.manifests(spark, str(tmp_path)).collect()}
    assert got["b1"] == ("10.1/x", "p.html", None) and got["b2"][0] is None
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "report.json").write_text('{"doi": "10.1/Y",\n "findings": [{"test": "cv", "severity": "high"}, {"test": "x"}]}')
    assert sorted((r.doi, r.test, r.severity) for r in D.reports(spark, str(tmp_path / "r"), "test:string,severity:string").collect()) == [("10.1/y", "cv", "high"), ("10.1/y", "x", None)]


def test_filtered_references_do_not_make_the_level_high(spark):
    good = "Lee K, Roe C. A study of what happened there. Journal of Seas 12, 2004"
    base = {"kind": "reference", "test": "not_found", "severity": "high"}
    names = [c for c in findings(spark, [{}]).columns]

    def level(rows, references):
        f = findings(spark, [base] * len(rows))
        texts = spark.createDataFrame([(k, t, d) for k, (t, d) in enumerate(rows)], "ord int, ref_text string, resolved_doi string")
        return score.overall(f.select(*names).join(texts, "ord"), spark.createDataFrame([(1, references)], "bundle_id int, total_references int")).first().level

    assert level([(good, None)] * 6, 30) == score.HIGH
    assert level([(good, None)] * 6 + [("doi:10.1/x", None)] * 6, 60) == score.LOW  # 6 of 12 are noise: eight are needed
    assert overall(spark, [base] * 6, references=30).level == score.HIGH


def test_small_image_files_are_no_pictures(spark):
    rows = [{"kind": "image", "test": "dup", "severity": "low", "image_a": f"a{k % 4}", "image_b": f"b{k // 4}", "page_a": 1, "page_b": 2 + k % 4} for k in range(12)]
    f = findings(spark, rows)
    assert score.image_pages(f).first().cross_page == 12
    assert score.image_pages(f.withColumn("size_a", F.lit(5000)).withColumn("size_b", F.when(F.col("image_b") == "b0", 1999).otherwise(5000))).first().cross_page == 0


def test_page_lines_and_own_doi(spark):
    text = "1. Lee\nArticle https://doi.org/10.1/x\nNature | Volume 3 | 2020\n2. Kim (see) Article https://doi.org/10.1/(x) more\nPublisher's note Springer"
    got = spark.createDataFrame([(text, "10.1/(x)"), (text, None)], "t string, d string").select(S.without_own_doi(S.without_page_lines(F.col("t")), F.col("d"))).collect()
    assert got[0][0] == "1. Lee\n2. Kim (see)   more" and "10.1/(x)" in got[1][0]


def test_words_of_reports(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.plain_report_text(F.lit("## Head\n**bold** `x`\n| a | b |\n---\n```json\n{}\n```\nend"))).split() == ["Head", "bold", "x", "{}", "end"]
    assert one(S.reworded(F.lit("fraud found"), {"fraud": "irregularity", "found": "noted"})) == "irregularity noted"
    assert one(S.json_in(F.lit("x {broken"))) is None


def test_hamming_matches_miss_nothing(spark):
    import random

    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(40)]
    values += [v ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 10))) for v in values]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "k long, h long")
    got = {(r["query"], r.match): r.distance for r in I.hamming_matches(df, df, "k", "h", 8).collect()}
    want = {(a, b): (x ^ y).bit_count() for a, x in enumerate(values) for b, y in enumerate(values) if a != b and (x ^ y).bit_count() <= 8}
    assert got == want and want


def test_battery_roles_and_sequences(spark):
    columns = {"tumor volume": [10.5 + 2.25 * k + (0.001 if k == 7 else 0) for k in range(20)], "days": [float(k) for k in range(20)], "growth": [3.0, 9.5, 1.25, 7.0, 2.0, 8.5, 4.75], "weight": [2.5] * 6, "group": [float(k % 2) for k in range(30)], "sd": [0.5, 1.0, 1.5, 2.0]}
    v = spark.createDataFrame([("s", c, k, x) for c, xs in columns.items() for k, x in enumerate(xs)], "sheet string, c string, pos int, v double")
    figures = H.column_figures(v, ["sheet"], "c")
    roles = {r.c: r.m for r in figures.select("c", H.is_measurement("c").alias("m")).collect()}
    assert roles == {"tumor volume": False, "days": False, "growth": True, "weight": True, "group": False, "sd": False}
    found = {(r.c, r.test, r.severity) for r in H.column_findings(figures, ["sheet"], "c").collect()}
    assert ("weight", "arithmetic_sequence", "medium") in found and ("weight", "coefficient_of_variation", "high") in found and ("sd", "sd_regularity", "low") in found
    assert not any(c in ("growth", "days", "group") and t != "decimal_uniformity" for c, t, _ in found)
    assert H.sheet_findings(v.limit(0), ["sheet"], "c").count() == 0


def test_first_two_hundred_sheet_pairs(spark):
    sheets = spark.createDataFrame([("f", f"s{k:03}", k, 10, 1) for k in range(300)] + [("supp tree", "x", 1, 10, 1)], "file string, sheet string, ord int, rows int, measures int")
    got = [(r.sheet_a, r.sheet_b) for r in H.sheets_to_compare(sheets, "file", "sheet", "ord").orderBy("turn").collect()]
    assert got == [("s000", f"s{k:03}") for k in range(1, 201)]


def test_sinks(spark, tmp_path):
    from siftline.sources import sinks

    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, t string")
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_csv(df, str(tmp_path / "c"))
    for _ in range(2):
        sinks.append_metrics(df, str(tmp_path / "m"))
    sinks.write_lines(D.markdown_table(df, ["k", "t"], ["k"]), str(tmp_path / "md"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.csv(str(tmp_path / "c"), header=True).where("t is null").count() == 1
    assert spark.read.json(str(tmp_path / "m")).count() == 4
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()] == ["| k | t |", "|-|-|", r"| 1 | a\|b |", "| 2 |  |"]
    a, b = (sinks.replaced(spark, df, str(tmp_path / "v")) for _ in range(2))
    assert a != b and spark.read.parquet(a).count() == spark.read.parquet(b).count() == 2


def test_columns_by_place_and_last(spark):
    c = spark.createDataFrame([("s", r, k, f"{r}{k}") for r in range(3) for k in range(4)], "sheet string, row_idx int, col_idx int, raw string")
    assert sorted((r.row_idx, r.a, r.b) for r in D.columns_by_place(c, ["sheet"], {"a": 3, "b": 0}).collect()) == [(1, "13", "10"), (2, "23", "20")]
    rows = spark.createDataFrame([("10.1/A", 1, "x"), ("10.1/a", 2, "y"), (" ", 3, "z")], "doi string, row_idx int, v string")
    assert [r.v for r in D.last_by(rows, "doi", "row_idx").collect()] == ["y"]


def test_versions_are_seen_whole(spark, tmp_path):
    from siftline.sources import sinks

    base = str(tmp_path / "t")
    one, two = spark.range(3), spark.range(5)
    with pytest.raises(ValueError):
        sinks.current(spark, base)
    assert sinks.publish(one, base, 1) and sinks.current(spark, base).count() == 3
    before = sinks.current(spark, base)
    broken = two.withColumn("x", F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        sinks.publish(broken, base, 2)
    assert sinks.versions(spark, base) == [1] and sinks.current(spark, base).count() == 3  # amid a failed write
    assert sinks.publish(two, base, 2) and not sinks.publish(one, base, 2)  # run again: nothing happens
    assert sinks.current(spark, base).count() == 5 and before.count() == 3 and sinks.current(spark, base, 1).count() == 3
    assert sinks.publish(spark.range(7), base, 10) and sinks.versions(spark, base) == [1, 2, 10]
    assert sinks.drop_versions(spark, base, 2) == [1] and sinks.versions(spark, base) == [2, 10]


def test_titles_and_short_texts(spark):
    from siftline.operators import references as X

    one = lambda c: spark.range(1).select(c).first()[0]
    cover = lambda a, b: one(X.title_coverage(F.lit(a), F.lit(b)))
    assert cover("deep deep deep blue", "in deep water") == 0.75 and cover("", "text") == 0.0 and cover("...", "text") == 0.0
    assert cover("Deep-Blue", "so deep blue it is") == 1.0 and cover("of it", "nothing") == 0.0
    assert [one(S.is_garbled(F.lit(t))) for t in ("nospaceword", "a", "", " " * 25, " " * 19, "x" * 20, "some words that stand apart")] == [False, False, False, True, False, True, False]


def test_decimals_are_the_same_in_sql(spark):
    from siftline.functions import numbers as N
    from siftline.functions import sql

    sql.register(spark)
    df = spark.createDataFrame([(x,) for x in (1e-5, 1.5e-7, 1.25, 3.0, 1e10, 1.2345e9, 12345678.75, None, 0.1)], "v double")
    got = df.select(F.expr("sift_decimals(v)").alias("a"), N.decimals(F.col("v")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and got[0].a == 5


def test_rows_are_numbered_in_ranges(spark):
    from siftline.session import numbered

    rows = spark.createDataFrame([(k * 7 % 100, "x") for k in range(100)] + [(3, "x")], "k int, t string").repartition(6)
    got = numbered(rows, [F.desc("k"), F.col("t")], "no").collect()
    assert sorted(r.no for r in got) == list(range(1, 102)) and [r.k for r in sorted(got, key=lambda r: r.no)] == sorted((r.k for r in got), reverse=True)
    assert numbered(rows.limit(0), [F.col("k")], "no").count() == 0
    told = D.frequencies(spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("c",)], "v string"), "v")
    assert [(r.v, r.n, r["rank"]) for r in told.orderBy("rank").collect()] == [("b", 2, 1), ("a", 1, 2), ("c", 1, 3), (None, 1, 4)]
    assert [r.v for r in D.frequencies(told.select("v"), "v", 2).orderBy("rank").collect()] == ["a", "b"]


def test_names_of_findings_are_judged_once_each(spark):
    """Patterns are matched with distinct names, not in each row; names that are null take nothing away."""
    from siftline.operators import revision as V

    data = [("coefficient_of_variation", "high", c, o, 0.1, False, 2.0, 0.0) for c, o in (("time", "a"), ("tumor volume", "sample number"), (None, None), ("tumor volume", None))]
    data += [("linear_dependency", "high", "tumor volume", o, 0.1, False, 2.0, 0.0) for o in ("growth rate", "sample number", None)]
    kept = V.standing(spark.createDataFrame(data, "test string, severity string, column string, other string, deviation double, constant boolean, slope double, intercept double"))
    assert "RLIKE" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, (r[:1] + r[2:4] for r in kept.collect()))) == sorted(map(str, [(t, c, o) for t, _, c, o, *_ in data if c != "time" and not (t == "linear_dependency" and o == "sample number")]))
