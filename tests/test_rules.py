"""Boundaries of the column tests, the scorer and the readers on small synthetic inputs."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siftline.functions import numbers as N
from siftline.functions import strings as S
from siftline.operators import columns as C
from siftline.operators import references as X
from siftline.operators import structure as A
from siftline.operators import upkeep as U
from siftline.plans import review, score
from siftline.sources import bundles, cells, pages

FINDING = "bundle_id int, kind string, ord int, test string, severity string, r_squared double, slope double, intercept double, overlap_ratio double, p_value double, title_similarity double, match_type string, page_a int, page_b int, image_a string, image_b string"


def vectors(spark, columns: dict[str, list]):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in columns.items() for i, v in enumerate(vs)], "c string, pos int, v double")


def by_column(df):
    return {r["c"]: r for r in df.collect()}


def findings(spark, rows: list[dict]):
    names = [x.split()[0] for x in FINDING.split(", ")]
    return spark.createDataFrame([tuple(({"bundle_id": 1, "ord": k} | r).get(n) for n in names) for k, r in enumerate(rows)], FINDING)


def overall(spark, rows, references=0):
    return score.overall(findings(spark, rows), spark.createDataFrame([(1, references)], "bundle_id int, total_references int")).first()


def test_recycling_levels(spark):
    got = by_column(C.value_recycling(vectors(spark, {"curve": [k % 132 + 0.5 for k in range(4501)], "few": [k % 6 + 0.25 for k in range(60)], "codes": [k % 3 for k in range(12)]}), ["c"]))
    assert got["curve"].severity == "medium" and got["few"].severity == "high" and not got["codes"].flagged


def test_sequences_and_axes(spark):
    v = vectors(spark, {"even": range(10, 20), "constant": [2.5] * 5, "noise": [3.0, 9.0, 1.0, 7.0, 2.0], "index": range(1, 9)})
    got = by_column(C.arithmetic_sequence(v, ["c"]))
    assert got["even"].flagged and got["constant"].severity == "medium" and not got["noise"].flagged
    roles = by_column(C.axis_roles(v, ["c"]))
    assert roles["even"].is_axis and roles["index"].is_row_index and not roles["noise"].is_axis


def test_axis_roles_sort_twice_and_keep_no_map_of_values(spark):
    """Uneven and falling steps, few codes, gaps; by place and by step only, in more tasks than their bytes ask for."""
    v = vectors(spark, {"falling": [9.0, 7.0, 5.02, 3.0], "uneven": [0.0, 1.0, 2.0, 4.0], "codes": [1, 2, 1, 2, 3] * 4, "counts": [1, 2, 3]})
    f = C.axis_roles(v, ["c"])
    plan = f._jdf.queryExecution().executedPlan().toString()
    got = {r.c: (r.n, r.is_row_index, r.is_axis, r.is_category) for r in f.collect()}
    assert got == {"falling": (4, False, True, False), "uneven": (4, False, False, False), "codes": (20, False, False, True), "counts": (3, True, False, False)}
    assert "median" not in plan.lower() and "percentile" not in plan.lower() and plan.count("Sort [") == 2


def test_cv_boundary(spark):
    got = by_column(C.coefficient_of_variation(vectors(spark, {"tight": [100, 100.01, 99.99], "loose": [100, 110, 90], "zero": [-1, 0, 1]}), ["c"]))
    assert got["tight"].severity == "high" and not got["loose"].flagged and "zero" not in got


def test_decimals_and_grim(spark):
    df = spark.createDataFrame([(0.25,), (17.0,), (1e-5,), (12345678.9,)], "v double").select(N.decimals(F.col("v")))
    assert [r[0] for r in df.collect()] == [2, 0, 5, 1]
    g = spark.createDataFrame([(3.48, 25), (3.49, 25)], "m double, n int").select(N.grim(F.col("m"), F.col("n"), 2))
    assert [r[0] for r in g.collect()] == [True, False]


def test_score_splices_and_caps(spark):
    splice = {"kind": "splice", "test": "splice", "severity": "medium"}
    assert overall(spark, [splice]).level == score.LOW
    two = overall(spark, [splice] * 2)
    assert two.level == score.HIGH and two.image_score >= 56
    cv = overall(spark, [{"kind": "data", "test": "coefficient_of_variation", "severity": "high"}] * 7)
    assert cv.data_score == 64 and cv.level == score.HIGH


def test_score_alone_does_not_set_the_level(spark):
    refs = overall(spark, [{"kind": "reference", "test": "doi_not_found", "severity": "high"}] * 7, references=100)
    assert refs.score >= 60 and refs.level == score.LOW
    low = overall(spark, [{"kind": "data", "test": "benfords_law", "severity": "medium"}] * 6 + [{"kind": "data", "test": "decimal_uniformity", "severity": "low"}] * 20)
    assert low.score <= 60 and low.level == score.LOW


def test_same_page_pairs_do_not_count(spark):
    same = [{"kind": "image", "test": "dup", "severity": "high", "image_a": f"a{k}", "image_b": f"b{k}", "page_a": 2, "page_b": 2} for k in range(8)]
    assert overall(spark, same).image_score == 0


def test_burden(spark):
    rows = [{"kind": "data", "test": "value_recycling", "severity": "medium"}] * 4 + [{"kind": "data", "test": "benfords_law", "severity": "medium"}] * 2 + [{"kind": "data", "test": "terminal_digit", "severity": "medium"}]
    rows += [{"kind": "data", "test": "decimal_uniformity", "severity": "low"}] * 8 + [{"kind": "reference", "test": "not_found", "severity": "medium"}] * 4
    got = overall(spark, rows, references=50)
    assert got.score == 61 and got.high_dimensions == "data,reference"


@pytest.mark.parametrize(
    "first, second, judge, final",
    [("high", None, None, "high"), ("low", "low", None, "low"), ("low", "high", "low", "low"), ("error", "low", "high", "high"), ("low", "error", "high", "high"), ("low", "error", "error", "low"), ("error", "low", "error", "low"), ("error", "error", "error", "error")],
)
def test_review(spark, first, second, judge, final):
    df = spark.createDataFrame([(first, second, judge)], "a string, b string, c string")
    assert df.select(review.decide(F.col("a"), F.col("b"), F.col("c"))).first()[0] == final


def test_atoms(spark):
    def line(serial, name, seq, x, y, z, occ, b):
        return f"ATOM  {serial:>5} {name:<4} ALA A{seq:>4}    {x:8.3f}{y:8.3f}{z:8.3f}{occ:6.2f}{b:6.2f}"

    rows = [line(1, "N", 1, 0, 0, 0, 1, 2), line(2, "N", 1, 0, 0, 0, 1.5, 2), line(3, "CA", 2, 0, 0, 0, 1, -3), line(4, "C", 3, 4, 5, 6, 1, 2)]
    atoms = A.atoms(spark.createDataFrame([(1, r) for r in rows], "f int, value string"))
    assert {r.test for r in A.duplicate_findings(atoms, "f").collect()} == {"pdb_duplicate_atom_identity", "pdb_duplicate_coordinates"}
    assert {r.test for r in A.range_findings(atoms, "f").collect()} == {"pdb_invalid_occupancy", "pdb_negative_bfactor", "pdb_zero_coordinates"}


def test_references(spark):
    text = "Intro\nReferences\n1. Lee A. A study of the deep sea. doi:10.1234/abc.1.\n2. Kim B. Waves over the\nnorth coast. 2001\n3. Roe C. Tides.\n1. Footer"
    got = X.references(spark.createDataFrame([(1, text), (2, "none")], "d int, t string"), "d", "t").collect()
    assert [(r.number, r.doi) for r in got] == [(1, "10.1234/abc.1"), (2, None), (3, None), (1, None)]
    sim = spark.createDataFrame([("Waves over the north coast", "kim b. waves over the north coast"), ("other words", "nothing")], "a string, b string").select(X.title_coverage(F.col("a"), F.col("b")))
    assert [r[0] for r in sim.collect()] == [1.0, 0.0]


def test_verify_table(spark):
    base = {"doi": "10.1/x", "doi_valid": True, "transient": False, "title_similarity": 0.9, "match_score": 60.0, "matched": True, "garbled": False, "titleless": False, "truncated": False, "unindexed": False}
    cases = [({}, None, None), ({"title_similarity": 0.4}, "title_mismatch", "high"), ({"title_similarity": 0.6}, "title_mismatch", "medium"), ({"doi_valid": False}, "doi_not_found", "high"), ({"doi_valid": False, "truncated": True}, "doi_truncated", "low"), ({"doi": None, "matched": False}, "not_found", "medium"), ({"doi": None, "match_score": 40.0, "title_similarity": 0.3}, "low_match_score", "high")]
    schema = "doi string, doi_valid boolean, transient boolean, title_similarity double, match_score double, matched boolean, garbled boolean, titleless boolean, truncated boolean, unindexed boolean"
    issue, severity = X.verify()
    got = spark.createDataFrame([tuple((base | c).values()) for c, _, _ in cases], schema).select(issue.alias("i"), severity.alias("s")).collect()
    assert [(r.i, r.s) for r in got] == [(i, s) for _, i, s in cases]


def test_upsert_null_keys_and_protection(spark):
    t = spark.createDataFrame([(1, None, "a", "r"), (2, "x", "b", "r")], "k int, f string, v string, review string")
    u = spark.createDataFrame([(1, None, "A"), (2, "x", "B"), (3, None, "C")], "k int, f string, v string")
    got = U.upsert(t, u, ["k", "f"], protected=spark.createDataFrame([(2, "x")], "k int, f string"), reset=["review"])
    assert sorted((r.k, r.v, r.review, r.action) for r in got.collect()) == [(1, "A", None, "updated"), (2, "b", "r", "kept"), (3, "C", None, "inserted")]


def test_strings(spark):
    df = spark.createDataFrame([("see https://doi.org/10.1234/Ab(1).",), ("no",)], "t string").select(S.doi(F.col("t")))
    assert df.first()[0] == "10.1234/Ab(1"
    assert spark.range(1).select(S.slug(F.lit("https://doi.org/10.1/a:b"))).first()[0] == "10.1__a_b"
    assert spark.range(1).select(S.html_text(F.lit("<p>a<script>x<1</script> &lt;b&gt;</p><!-- c -->"))).first()[0] == "a <b>"


def _xlsx() -> bytes:
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, v: f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    grid = [["Figure 1"], ["dose", "size"], [1, 2.5], [2, 3.5]]
    rows = "".join(f'<row r="{i + 1}">' + "".join(cell(f"{'AB'[j]}{i + 1}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(grid))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_spreadsheets_become_cells(spark):
    listing = spark.createDataFrame([("b", "x.xlsx", "xlsx", bytearray(_xlsx())), ("b", "bad.xlsx", "xlsx", bytearray(b"no zip"))], "bundle_id string, name string, ext string, content binary")
    got = cells.archive_cells(listing)
    assert got.where("error is not null").count() == 1
    named = cells.with_headers(cells.sub_tables(got.where("error is null")), ["bundle_id", "file", "sheet", "label"])
    assert sorted((r.label, r.col_name, r.v) for r in named.collect()) == [("Figure 1", "dose", 1.0), ("Figure 1", "dose", 2.0), ("Figure 1", "size", 2.5), ("Figure 1", "size", 3.5)]


def test_csv_cells_and_bundles(spark, tmp_path):
    for b, name, data in (("p1", "main.pdf", b"1" * 10), ("p1", "p1_supp.pdf", b"2" * 99), ("p1", "data.csv", b'a,"b,c"\n1,2\n'), ("p1", "copy.csv", b'a,"b,c"\n1,2\n'), ("p2", "figures.csv", b"x")):
        (tmp_path / b).mkdir(exist_ok=True)
        (tmp_path / b / name).write_bytes(data)
    listing = bundles.files(spark, str(tmp_path), content=True)
    assert [(r.bundle_id, r.route, r.has_data) for r in bundles.bundles(listing).collect()] == [("p1", "pdf", True)]
    assert bundles.main_file(listing).first()["name"] == "main.pdf"
    assert sorted(r["name"] for r in bundles.distinct_files(listing.where("ext = 'csv' and bundle_id = 'p1'")).collect()) == ["copy.csv"]
    got = cells.csv_cells(spark, str(tmp_path / "p1" / "data.csv"), "p1").orderBy("row_idx", "col_idx").collect()
    assert [r.raw for r in got] == ["a", "b,c", "1", "2"]


def test_page_readers(spark):
    html = '<html lang="en"><script type="application/ld+json">{"@type":"Article","author":[{"name":"A B","affiliation":[{"name":"X"}]}]}</script><ol><li data-counter="3." data-doi="10.1/a">Ref <b>one</b></li></ol>'
    df = spark.createDataFrame([(1, html)], "k int, h string")
    assert [(r.name, r.affiliation) for r in pages.authors(df, "k", "h").collect()] == [("A B", "X")]
    assert [(r.number, r.doi, r.text) for r in pages.reference_items(df, "k", "h").collect()] == [(3, "10.1/a", "Ref one")]


def test_exact_p_values(spark):
    from siftline.functions.tails import recomputed_p

    rows = [("chi2", 15.5073, 8.0, 0.0, 0.05, 1e-5), ("chi2", 21.666, 9.0, 0.0, 0.01, 1e-5), ("t", 2.228139, 10.0, 0.0, 0.05, 1e-5), ("F", 4.964603, 1.0, 10.0, 0.05, 1e-5), ("r", 0.576, 10.0, 0.0, 0.05, 2e-3)]
    df = spark.createDataFrame(rows, "kind string, x double, a double, b double, want double, near double")
    assert all(abs(r.p - r.want) < r.near for r in df.withColumn("p", recomputed_p(F.col("kind"), F.col("x"), F.col("a"), F.col("b"))).collect())


def test_picture_screens(spark):
    import numpy as np

    from siftline.operators import pictures

    rng = np.random.default_rng(3)
    blot = rng.normal(200, 5, (60, 180))
    for x in range(8, 180, 20):
        blot[20:40, x : x + 10] -= 120
    spliced = blot.copy()
    spliced[:, 91:] -= 55
    assert abs(bin((pictures.phash(blot) ^ pictures.phash(blot + 3)) & (2**64 - 1)).count("1")) <= 4
    assert pictures.correlation(blot, blot) > 0.999
    rows = [(1, 180, 60, spliced.ravel().tolist()), (2, 180, 60, blot.ravel().tolist()), (3, 5, 5, [1.0])]
    got = {r.k: r for r in pictures.screen(spark.createDataFrame(rows, "k int, width int, height int, pixels array<double>"), "k").collect()}
    assert got[1].suspect and 90 in got[1].seams and not got[2].suspect and got[3].error
    merged = spark.range(1).select(pictures.merged_peaks(F.expr("array(10, 12, 13, 20)"))).first()[0]
    assert merged == [10, 20]


def test_grouped_citations(spark):
    lines = ["Lee, A. Deep sea tides.", "Journal of Seas (2001). 3, 1-9.", "Kim, B. Waves. doi: 10.1234/x", "Roe, C. Winds"]
    got = spark.createDataFrame([(lines,)], "l array<string>").select(X.grouped_lines(F.col("l"))).first()[0]
    assert len(got) == 3 and got[0].startswith("Lee, A. Deep sea tides. Journal")


def test_metadata(spark):
    from siftline.operators import metadata as D

    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(D.doi_by_precedence(F.lit(" "), F.lit(None).cast("string"), F.lit(""), F.lit("x_10.1234__ab"))) == "10.1234/ab"
    assert one(D.doi_year(F.lit("10.1234/j.2019.55"))) == 2019 and one(D.doi_year(F.lit("10.1234/x1234"))) is None
    assert one(D.upsert_key(F.lit(""), F.lit("A Title!"))) == "t:atitle"
    assert one(D.author_place(F.array(F.lit("A B"), F.lit("C D"), F.lit("E F")), "c d")) == "second last"
    assert one(D.is_bad_title(F.lit("paper.pdf"))) and not one(D.is_bad_title(F.lit("A study of the tides")))
    lines = spark.createDataFrame([(1, 0, 8.0, "Vol"), (1, 1, 20.0, "A study"), (1, 2, 19.0, "of tides"), (1, 3, 9.0, "Lee"), (1, 4, 20.0, "Later")], "k int, ord int, size double, text string")
    assert D.title_lines(lines, "k").first().title == "A study of tides"
    a = spark.createDataFrame([(1, 0, "Ann Lee1,2"), (1, 1, "Bo Kim3"), (2, 0, "Cy Roe1")], "k int, ord int, author string")
    i = spark.createDataFrame([(1, 3, "North University"), (1, 1, "Other"), (2, 2, "North University")], "k int, idx int, institution string")
    assert {r.k: r.names for r in D.authors_at(a, i, "k", "north").collect()} == {1: "Bo Kim", 2: "Cy Roe"}
    blocks = spark.createDataFrame([(1, "r1", 55.0, 0.0, 100.0, 5.0), (1, "l2", 0.0, 9.0, 45.0, 15.0), (1, "l1", 0.0, 1.0, 45.0, 5.0), (1, "r2", 55.0, 9.0, 100.0, 15.0)], "p int, t string, x0 double, y0 double, x1 double, y1 double")
    assert [r.t for r in D.reading_order(blocks, ["p"]).orderBy("ord").collect()] == ["l1", "l2", "r1", "r2"]
    names = spark.createDataFrame([("z", "p1/a.pdf"), ("z", "p2/b.csv"), ("y", "../x.exe")], "a string, path string")
    assert {r.a: (r.kind, r.errors) for r in D.archive_kind(names, "a", "path").collect()} == {"z": ("batch", []), "y": ("single", ["unsafe path", "forbidden: exe", "no PDF"])}


def test_records_between_blanks_models_and_broken_ones(spark):
    lines = [
        "MODEL        2", "ATOM      1  CA  ALA A   1      11.104   6.134  -6.504  1.00  9.00", "ATOM   2 CA ALA A 7 1.5 2 -3e0 0.5 -1", "ATOM   3 CA ALA", "HETATM 4 CA ALA A 1 1 2 x", "HETATM 4 CA ALA A 1 0 0.0001 0",
        "ENDMDL", "MODEL", "ATOM      1  CA  ALA A   1      11.104   6.134  -6.504            ", "TER", "ATOM      1  CA  ALA A   1      11.104   6.134  bad     1.00  9.00",
    ]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "f int, place int, value string")
    got = {r.place: r for r in A.atoms(A.with_models(df, "f", "place")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 8, 10} and {k for k, r in got.items() if r.malformed} == {3, 4, 10}
    assert (got[2].x, got[2].z, got[2].b_factor) == (1.5, -3.0, -1.0)
    assert (got[1].x, got[1].occupancy, got[1].model) == (11.104, 1.0, "2") and (got[8].occupancy, got[8].b_factor, got[8].model) == (None, None, "7")
    assert A.malformed_findings(A.atoms(df), "f").first().severity == "medium"
    assert A.duplicate_findings(A.atoms(A.with_models(df, "f", "place")), "f").count() == 0  # of each model apart
    assert A.duplicate_findings(A.atoms(df), "f").count() > 0
