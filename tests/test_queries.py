"""Every registered screening query against its SQL twin on the smallest tables."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pandas as pd
import pytest

from siftline.plans import queries as q

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return str(pd.Timestamp(v))
    return v.item() if hasattr(v, "item") else v


def rows(frame: pd.DataFrame) -> list[str]:
    cols = sorted(frame.columns)
    return sorted(repr([float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in map(norm, r)]) for r in frame[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_matches_sql(spark, db, name):
    got = q.queries()[name](spark, SF).toPandas()
    want = db.sql(q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_runs(spark, name):
    assert q.queries()[name](spark, SF).count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_tumbling_matches_sql(spark, db):
    got = q.queries()["stream_tumbling"](spark, SF).toPandas()
    assert rows(got) == rows(db.sql(q.oracle_sql()["tumbling"]).df())


def test_stream_tumbling_counts_late_rows_over_batches(spark, db, tmp_path):
    """Twenty files, the newest events first: several batches, whose later rows are days behind."""
    for k in range(20):
        db.sql(f"copy (select * from events qualify ntile(20) over (order by ts desc, event_id) = {k + 1}) to '{tmp_path}/events{k:02}.parquet' (format parquet)")
    db.sql(f"copy (select * from events limit 0) to '{tmp_path}/events.parquet' (format parquet)")
    got = q.queries()["stream_tumbling"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(db.sql(q.oracle_sql()["tumbling"]).df())


def test_title_similarity_takes_the_whole_title(spark, tmp_path):
    """A garbled title with no word of the text, a match that starts after 60 characters, and a title of low coverage."""
    from siftline.operators.exact import title_ratio

    title = "a study of the statistical behaviour of sea ice under rising temperature " + "with records of many hundred stations in the arctic ocean from winters past and the summers that followed them as well as a list of all its sources"
    joined = title.replace(" ", "")
    other = "zz " * 25 + title[75:]
    data = [(title, "smith 2020 " + joined + " nature 12", 0.0), (title, other, 0.5), (title, "xq " * 30, 0.0)]
    got = spark.createDataFrame(data, "a string, b string, c double").select(title_ratio("a", "b", "c").alias("r")).collect()
    assert len(title) > 200 and got[0].r > 0.75 and got[1].r > 0.55 and got[2].r < 0.2
    rows_ = q.queries()["title_similarity"](spark, SF).collect()
    assert all(r.similarity >= r.coverage for r in rows_) and any(r.coverage < 0.5 and r.similarity > r.coverage for r in rows_)


def test_stream_claims_in_order_over_frames(spark, tmp_path):
    """One user's 900 events in 9 frames of 100, dealt at random: the same actions as in order of time."""
    n = 900
    events = spark.sql(f"select id as event_id, 1L as user_id, timestamp_seconds(1700000000 + id * 60) as ts from range({n})").orderBy("event_id")
    for k in range(4):
        events.where(f"pmod(hash(event_id), 4) = {k}").orderBy("event_id", ascending=False).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "100")
    try:
        out = q.M.claims(q.M.event_stream(spark, f"{tmp_path}/in/*", events.schema))
        q.M.run_available(out, f"{tmp_path}/out", f"{tmp_path}/state")
    finally:
        spark.conf.set(key, before)
    got = {r.event_id: r.action for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    assert len(got) == n and [k for k, a in sorted(got.items()) if a == "claim"] == [0] and [k for k, a in sorted(got.items()) if a == "retry"] == [361]
    assert all(got[k] == "give up" for k in range(722, n)) and all(got[k] == "busy" for k in range(362, 722))


def test_score_all_kinds_has_each_bundle_once(spark, tmp_path):
    """Bundle 1000050 has rows of its own and is also what bundle 50 makes: one row, as in the SQL."""
    con = duckdb.connect()
    con.sql(f"copy (select * replace (l_orderkey % 16 + case when l_orderkey % 2 = 0 then 400 else 8000400 end as l_orderkey) from '{SF}/lineitem.parquet' limit 300) to '{tmp_path}/lineitem.parquet'")
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = q.queries()["score_all_kinds"](spark, str(tmp_path)).toPandas()
    assert 1000050 in list(got.bundle_id) and rows(got) == rows(con.sql(q.oracle_sql()["score_all_kinds"]).df())


def test_title_ratio_is_worked_out_only_where_it_can_matter(monkeypatch):
    """Windows with the title's letters in another order share too short a subsequence to pass what is known already."""
    import difflib

    import pandas as pd

    from siftline.operators.exact import title_ratio

    asked, ratio = [], difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: asked.append(1) or ratio(self))
    title = "abcdefghijklmnopqrstuvwxyz"
    got = title_ratio.func(pd.Series([title, title]), pd.Series([title[::-1] * 20, title[::-1] * 3 + title]), pd.Series([0.6, 0.6]))
    assert list(got) == [0.0, 1.0] and len(asked) == 1


def test_structure_files_reads_its_lines_once(spark):
    """Lines are numbered and parsed once; the aggregates read what that left."""
    plan = q.queries()["structure_files"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "Window" not in plan


def test_page_text_is_spread_and_guards_miss_no_fragment(spark):
    """Texts of one file take several tasks; what a pattern would take away goes, in either case of letters."""
    import re

    from pyspark.sql import functions as F

    from siftline.functions import strings as S

    assert q.queries()["page_text"](spark, SF).rdd.getNumPartitions() > 1
    texts = ["Nature News | VOLUME 12 | May x\nYOUR PRIVACY, your choice", "we and our 20 partners do. transfers to THIRD parties x. Some third parties are outside y. varying standards of data protection z. a",
             "advertising, personal,personalisation of content q. Advertising, personalisation of content q. usage analysis and social r. see Our privacy policy s. t", "for further information and to change your choices u. v\n\n", "plain\n\ntext\n", "",
             "Publisher's note a\nSpringer Nature remains b\nuse of your personal data\nto change your choices\nfor further information and to change\nCookies\nhttps://doi.org/10.1/x \nArticle https://doi.org/1\n| Volume 3 |\nkept"]
    want = []
    for t in texts:
        t = "\n".join(x for x in t.split("\n") if not re.search("|".join(S.PAGE_LINES), x, re.I))
        for fragment in S.FRAGMENTS:
            t = re.sub(fragment, " ", t, flags=re.I)
        want.append(t)
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", S.without_running_text(F.col("t"), F.lit("10.9/none")).alias("t")).collect()
    assert [r.t for r in sorted(got)] == want


@pytest.mark.parametrize("block", [3, 2048])
def test_knn_ratio_on_odd_vectors(spark, tmp_path, block, monkeypatch):
    """Copies, ties, vectors that are short, long, null or lack components, in one or many blocks, against the SQL; rows meet in blocks."""
    import random

    from siftline.operators import images as I

    r = random.Random(5)
    some = [[r.gauss(0, 1) for _ in range(64)] for _ in range(60)]
    some += [[x + r.gauss(0, 0.01) for x in some[0]], list(some[0]), list(some[0]), list(some[50]), some[50][:40], [*some[20], 9.0], None, [], [None] * 64, [*some[3][:63], None], [x and 1e18 * x for x in some[7]]]
    vectors = [(k * 25, v, k % 2) for k, v in enumerate(some)] + [(5000, some[0], None), (None, some[50], 0), (5050, [x + 0.001 for x in some[9]], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(I.ratio_matches, "__defaults__", (0.7, block))
    got = q.queries()["knn_ratio"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(q.oracle_sql()["knn_ratio"]).df()
    assert len(want) >= 2 and rows(got.toPandas()) == rows(want)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_best_ratio_is_that_of_difflib(monkeypatch):
    """Of the text's start and of all windows, also with ties, letters beyond ASCII, runs over 255 and texts in blocks; without difflib."""
    import difflib
    import random

    from siftline.operators import exact

    rng = random.Random(5)
    cases = [("ab" * 150, "xab" * 20 + "ab" * 160, 0.0), ("a", "ba", 0.0), ("abc", "", 0.0), ("é🙂a", "a🙂é🙂", 0.1), ("abcd", "abxd", 0.75), ("abcd", "abxd", 0.7)]
    for k in range(150):
        letters = "ab " if k % 3 else "abcdefgh é"
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for most in (60, 150))
        cases.append((a, b + a[: k % 40] + b[:7] if k % 4 == 0 else b, rng.choice([0.0, 0.3, 0.6])))
    want = []
    for a, b, least in cases:
        spans = {(0, 200), *((at, at + len(a)) for at in range(0, max(1, len(b) - len(a) + 1), max(1, len(a) // 4)))}
        best = max(difflib.SequenceMatcher(None, b[lo:hi], a, autojunk=False).ratio() for lo, hi in spans) if a and b else 0.0
        want.append(best if best > least else 0.0)
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    assert [exact.title_ratio.func(*(pd.Series([x]) for x in c))[0] for c in cases] == want
    monkeypatch.setattr(exact, "BLOCK", 1000)
    assert [exact.best_ratio(*c) for c in cases] == want and sum(w > 0 for w in want) > 80
