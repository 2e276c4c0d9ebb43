"""Pairs of columns within and across sheets: severities at their borders, guards, and how often the source is read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftline.operators import references as X
from siftline.operators import sheets as H


def _vectors(spark, columns, keys=("s",)):
    rows = [(*keys, name, i, float(v)) for name, values in columns.items() for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "sheet string, name string, pos int, v double")


def _pairs(spark, columns):
    found = H.sheet_findings(_vectors(spark, columns), ["sheet"], "name").where("other is not null")
    return {(r.name, r.other, r.test): r.severity for r in found.collect()}


def _wave(i, k=1):
    return (i * i * 37 * k) % 101 / 7 + 3


def test_severity_of_columns_that_agree(spark):
    fine = [round(_wave(i), 8) for i in range(40)]
    coarse = [round(_wave(i), 1) for i in range(40)]
    agree = lambda x, n: [v if i < n else v + 1.7 for i, v in enumerate(x)]
    assert _pairs(spark, {"aa": fine, "bb": agree(fine, 24)}) == {("aa", "bb", "cross_group_duplicate"): "medium"}
    assert _pairs(spark, {"aa": fine, "bb": agree(fine, 16)}) == {}  # fine values alone make no finding
    assert _pairs(spark, {"aa": coarse, "bb": agree(coarse, 24)}) == {("aa", "bb", "cross_group_duplicate"): "low"}
    assert _pairs(spark, {"aa": coarse, "bb": agree(coarse, 32)}) == {("aa", "bb", "cross_group_duplicate"): "medium"}
    assert _pairs(spark, {"aa": coarse, "bb": agree(coarse, 38)}) == {("aa", "bb", "cross_group_duplicate"): "high"}
    # fine values in common at other places count as well
    moved = agree(coarse, 24)[:36] + [round(1 / 7, 8), round(2 / 7, 8), round(3 / 7, 8), 1.5]
    source = coarse[:33] + [round(3 / 7, 8), round(1 / 7, 8), round(2 / 7, 8)] + coarse[36:]
    assert _pairs(spark, {"aa": source, "bb": moved}) == {("aa", "bb", "cross_group_duplicate"): "medium"}


@pytest.mark.parametrize("slope, offset, severity", [(1.0, 7.0, "high"), (1.005, 7.2, "high"), (1.0, 0.6, "medium"), (1.02, 7.0, "medium"), (-1.0, 7.0, "medium")])
def test_lines_that_are_offsets(spark, slope, offset, severity):
    a = [_wave(i) for i in range(60)]
    assert _pairs(spark, {"aa": a, "bb": [slope * v + offset for v in a]}) == {("aa", "bb", "linear_dependency"): severity}
    assert _pairs(spark, {"aa": a[:49], "bb": [slope * v + offset for v in a[:49]]}) == {}


def _cross(spark, sheets, file="book"):
    rows = [(file, sheet, k, name, i, float(v)) for k, (sheet, columns) in enumerate(sheets.items()) for name, values in columns.items() for i, v in enumerate(values)]
    v = spark.createDataFrame(rows, "file string, sheet string, ord int, name string, pos int, v double")
    return {(r.sheet_a, r.column_a, r.sheet_b, r.column_b): (r.n, r.matched, r.severity) for r in H.cross_sheet_columns(v, "file", "sheet", "ord", "name").collect()}


def test_columns_across_sheets(spark):
    a, coarse = [round(_wave(i), 8) for i in range(20)], [round(_wave(i, 3), 2) for i in range(20)]
    near = [v if i < 18 else v + 1 for i, v in enumerate(a)]
    sheets = {"one": {"aa": a, "bb": coarse}, "two": {"cc": near, "dd": coarse + [4.25, 5.5]}, "flat": {"ee": [2.5] * 20, "ff": [2.5] * 20}}
    assert _cross(spark, sheets) == {("one", "aa", "two", "cc"): (20, 18, "high"), ("one", "bb", "two", "dd"): (20, 20, "medium")}
    assert _cross(spark, {"one": {"aa": a}, "two": {"cc": [v if i < 17 else v + 1 for i, v in enumerate(a)]}}) == {}
    assert _cross(spark, {"one": {"aa": a}, "two": {"time": a}}) == {}  # an axis, by its name
    assert _cross(spark, {"one SNPs tree": {"aa": a}, "two": {"cc": a}}) == {}
    assert _cross(spark, {"one": {"aa": a}, "two": {"cc": a}}, "phylogeny") == {}
    long = [round(_wave(i) + i % 11, 3) for i in range(5001)]
    assert _cross(spark, {"one": {"aa": long}, "two": {"cc": long}}) == {} and len(_cross(spark, {"one": {"aa": long[:5000]}, "two": {"cc": long[:5000]}})) == 1


def test_citations_of_several_lines(spark):
    lines = ["Smith, L. J. The deep sea", "and what lives there (2010). Sea 12,", "34-56.", "Lee, K. Waves. doi:", "10.1234/abc", "van Dyke, A. No end", "Kim, S. not whole, so one", "", None, "  text (2001) 5 - 6  ", "Wu, X. last (1999)."]
    df = spark.createDataFrame([(k, i, x) for k in (1, 2) for i, x in enumerate(lines)] + [(3, 0, "only"), (4, 0, None)], "k int, place int, line string").repartition(5)
    got = {}
    for r in X.citations(spark, df).orderBy("k", "number").collect():
        got.setdefault(r.k, []).append((r.lines, r.text))
    want = [(3, "Smith, L. J. The deep sea and what lives there (2010). Sea 12, 34-56."), (2, "Lee, K. Waves. doi: 10.1234/abc"), (3, "van Dyke, A. No end Kim, S. not whole, so one text (2001) 5 - 6"), (1, "Wu, X. last (1999).")]
    assert got == {1: want, 2: want, 3: [(1, "only")]}
    plan = X.citations(spark, df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "UDTF" not in plan  # lines go to Python in batches
    fold = df.where("k = 1 and trim(line) <> ''").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.trim("line").alias("x")))), lambda x: x["x"]).alias("l"))
    assert fold.select(X.grouped_lines(F.col("l"))).first()[0] == [t for _, t in want]


def test_headers_send_nothing_whole_through_the_driver(spark):
    """The planner guesses sizes from the files'; rows, headers and columns of sheets must not be broadcast on its guess."""
    from siftline.plans import queries as q

    from .conftest import SF

    for name in ("sheet_headers", "sheet_segments"):
        assert "Broadcast" not in q.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_cross_sheet_columns_shuffle_columns_not_pairs_of_values(spark):
    v = spark.createDataFrame([("f", "c", k, x) for k, x in enumerate((0.0, -0.0, 1.123456, 1.123456, 2.5, 3.654321))] + [("f", "d", k, 7.0) for k in range(3)], "file string, name string, pos long, v double")
    got = {r.name: (r.vs, r.changes, r.fine) for r in H.shown_columns(v, ["file"], "name").collect()}
    assert got == {"c": ([0.0, 0.0, 1.123456, 1.123456, 2.5, 3.654321], 3, 4), "d": ([7.0] * 3, None, None)}
    from siftline.plans import queries as q

    from .conftest import SF

    assert "place" not in q.queries()["cross_sheet_columns"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_figures_keep_no_map_of_values(spark):
    """Medians of 0..6 and of a column without order, by places; no percentile, which keeps each group's values."""
    v = spark.createDataFrame([("s", "up", k, float(k * k)) for k in range(7)] + [("s", "mixed", k, x) for k, x in enumerate((3.0, -8.0, 5.0, -1.0))], "sheet string, c string, pos long, v double")
    f = H.column_figures(v, ["sheet"], "c")
    got = {r.c: (r.middle, r.mid, r.kinds) for r in f.collect()}
    assert got == {"up": (9.0, 6.0, 7), "mixed": (4.0, None, 4)}
    assert "percentile" not in f._jdf.queryExecution().executedPlan().toString().lower()


def test_pairs_of_a_sheet_are_summed_before_they_move(spark):
    """Positions of one sheet that are near stay together, so that sums for each pair are shuffled and not its rows."""
    ranked = spark.sql("select 's' as sheet, c, cast(id + 1 as int) as pos, cast(id as double) as v from range(5000) lateral view explode(array('a', 'b', 'c')) t as c")
    got = H.place_pairs(ranked, ["sheet"], "c").withColumn("task", H.F.spark_partition_id()).groupBy("a", "b").agg(H.F.count("*").alias("n"), H.F.count_distinct("task").alias("tasks"), H.F.count_if(H.F.col("va") != H.F.col("vb")).alias("off")).collect()
    assert len(got) == 3 and all(r.n == 5000 and r.tasks <= 2 and r.off == 0 for r in got)


def test_rows_are_sorted_once_for_all_their_columns(spark):
    """Figures of rows are those of their cells, also with nulls, and only counts of values are sorted by value."""
    wide = spark.createDataFrame(
        [("s", k, float(k * k), None if k % 3 == 0 else float(-k), 2.25) for k in range(9)] + [("t", 1, 4.0, None, 0.5), (None, 1, 1.0, 1.0, None), (None, 2, 3.5, 9.0, -0.0), (None, 3, 7.0, 81.0, 0.0)],
        "sheet string, pos long, a double, b double, c double",
    )
    cells = wide.unpivot(["sheet", "pos"], ["a", "b", "c"], "c", "v")
    got, want = (sorted(map(repr, f.select(sorted(f.columns)).collect())) for f in (H.row_figures(wide, ["sheet"], "c", ["a", "b", "c"]), H.column_figures(cells, ["sheet"], "c")))
    assert got == want and len(got) == 8
    plan = H._steps_of_rows(wide, ["sheet"], "c", ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.index("Generate") < plan.index("Sort [")


def test_only_sheets_with_monotone_columns_are_sorted_again(spark):
    """Medians of steps take the rows of monotone columns' sheets alone, and a value's digits are told once for its copies."""
    wide = spark.createDataFrame([("up", k, float(k), 7.25) for k in range(8)] + [("flat", k, float(k % 2), 120.5) for k in range(9)], "sheet string, pos long, a double, b double")
    f = H.row_figures(wide, ["sheet"], "c", ["a", "b"])
    got = {(r.sheet, r.c): (r.mid, r.mean_decimals, r.t0, r.t7, r.b1, r.nonzero, r.largest) for r in f.collect()}
    assert got == {
        ("up", "a"): (1.0, 0.0, 1, 1, 1, 7, 7.0), ("up", "b"): (None, 2.0, 0, 8, 0, 8, 7.25),
        ("flat", "a"): (None, 0.0, 5, 0, 4, 4, 1.0), ("flat", "b"): (None, 1.0, 9, 0, 9, 9, 120.5),
    }
    assert "LeftSemi" in f._jdf.queryExecution().executedPlan().toString()


def _wide(spark):
    """Sheets of four columns: lines, copies with fine values in place and elsewhere, codes, even axes, nulls in whole rows and in single cells."""
    import random

    rng, rows = random.Random(4), []
    for s in range(24):
        fine = [round(_wave(i, s + 1), 8 if s % 3 else 1) for i in range(60)]
        for i in range(60 if s % 5 else 1 + s):
            a = fine[i]
            b = {0: 1.005 * a + 7.2, 1: a if i < 36 else a + 1.7, 2: 3.0 * i if s % 2 else float(i), 3: float(i % 4)}[s % 4]
            c = rng.choice([a, a + 1e-9, a + 1e-8, a + 3e-8]) if s % 6 else fine[(i + 7) % 60]
            d = round(rng.gauss(50, 10), 2) if s != 9 else 2.5
            gone = i == 4 and s % 8 == 5
            odd = i % 9 == 2 and s % 8 == 6
            rows.append((f"s{s}" if s else None, s % 2, i, None if gone else a, None if gone or odd else b, None if gone else c, None if gone or (odd and i > 30) else d))
    return spark.createDataFrame(rows, "sheet string, part long, pos int, growth double, aa double, mass double, ee double").repartition(3)


def test_rows_of_sheets_give_what_their_cells_give(spark):
    """Also where batches end amid a sheet."""
    keys, measures, key = ["sheet", "part"], ["growth", "aa", "mass", "ee"], "spark.sql.execution.arrow.maxRecordsPerBatch"
    wide = _wide(spark)
    cells = wide.unpivot([*keys, "pos"], measures, "name", "v")
    shown = lambda f: sorted(repr((r.other is None, r.sheet, r.part, r.name, r.other, r.test, r.severity, None if r.figure is None else round(r.figure, 6))) for r in f.collect())
    rows, before = wide.repartition(2, *keys), spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got, two = shown(H.row_findings(rows, keys, "name", measures)), shown(H.row_pair_findings(rows, keys, "name", measures))
        roles = sorted(repr(tuple(r)) for r in H.row_roles(rows, keys, "name", measures).select(*keys, "name", "n", H.is_measurement("name")).collect())
    finally:
        spark.conf.set(key, before)
    want = shown(H.sheet_findings(cells, keys, "name"))
    assert got == want and two == [x for x in want if x.startswith("(False")] and len(two) > 20
    assert roles == sorted(repr(tuple(r)) for r in H.column_figures(cells, keys, "name").select(*keys, "name", "n", H.is_measurement("name")).collect())


def test_equal_to_eight_decimals_and_finer():
    from decimal import ROUND_HALF_EVEN, Decimal

    import numpy as np

    from siftline.operators import row_sums as W

    a = np.array([0.0, 5e-9, 1.5e-8, 2.5e-8, 1.000000005, 1.000000015, 123456.123456785, -1e-9, 2e9 + 0.5, 7.25, 1e12])
    b = np.array([-0.0, 0.0, 2e-8, 2e-8, 1.0, 1.00000002, 123456.12345678, 1e-9, 2e9 + 0.5, 7.2500001, 1e12 + 1])
    r = lambda x: float(Decimal(repr(float(x))).quantize(Decimal("1e-8"), ROUND_HALF_EVEN))
    assert W.equal(a, b).tolist() == [r(x) == r(y) for x, y in zip(a, b)]
    v = np.array([0.1, 0.12345, 0.123456, 1 / 3, 1e-5, 1e-6, 12345678.12345, 1e9 + 0.25, 1e9 + 1 / 3, 3e15, -0.000001])
    assert W.finer(v, 5).tolist() == [False, False, True, True, False, True, False, False, True, False, True]


@pytest.mark.parametrize("name", ["sheet_pairs", "sheet_battery", "cross_sheet_columns"])
def test_batteries_move_rows_not_cells(spark, name):
    """One row for each row of the table is shuffled, not one for each cell, and not what is made of it."""
    from siftline.plans import queries as q

    from .conftest import SF

    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = moved()
    assert q.queries()[name](spark, SF).count() and moved() - before < 1_000_000
