"""Registered queries of the screening operators over the driver's tables, each with its SQL.

``lineitem`` stands for measurement sheets (a supplier's or a flag's rows), ``orders`` for ordered columns and
result tables, ``documents`` and ``pages`` for article text, ``embeddings`` for image descriptors, ``labels`` for
ground truth, ``events`` for progress feeds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import roles as R
from ..functions import strings as S
from ..operators import columns as C
from ..operators import images as I
from ..operators import pairs as P
from ..operators import references as X
from ..operators import structure as A
from ..operators import upkeep as U
from ..session import cut, table
from ..sources import pages as G
from ..streaming import monitor as M
from . import review, score

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, so that it is worked out once and later readers take the columns they need."""
    import uuid

    path = f"{_shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tasks(spark: SparkSession) -> int:
    """Partitions for work that costs more than its bytes tell: several for each core, and no fewer than shuffles have."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a new local one only where Spark runs in one process."""
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or tempfile.mkdtemp(prefix="siftline-")).rstrip("/")


def _r(name: str, n: int = 6):
    return F.bround(name, n).alias(name)


def _cells(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*keys, *MEASURES).unpivot([*keys], MEASURES, "col_name", "v")


_UNPIVOT = "(select l_suppkey, l_partkey, l_returnflag, l_linestatus, col_name, v from lineitem unpivot (v for col_name in (l_quantity, l_extendedprice, l_discount, l_tax)))"


@query(f"""
select l_suppkey, col_name, count(*) as n, round_even(stddev_samp(v) / abs(avg(v)), 6) as cv, stddev_samp(v) / abs(avg(v)) < 0.5 as flagged,
  case when stddev_samp(v) / abs(avg(v)) < 0.05 then 'high' when stddev_samp(v) / abs(avg(v)) < 0.5 then 'medium' end as severity
from {_UNPIVOT} group by all having count(*) >= 3 and abs(avg(v)) >= 1e-12
""")
def col_cv(spark, sf):
    return C.coefficient_of_variation(_cells(spark, sf, "l_suppkey"), ["l_suppkey", "col_name"], 0.5).select("l_suppkey", "col_name", "n", _r("cv"), "flagged", "severity")


def _order_columns(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("double").alias("v"))
    return P.positions(o, ["o_custkey"], ["o_orderkey"])


@query("""
with d as (select o_custkey, o_orderkey::double - lag(o_orderkey::double) over (partition by o_custkey order by o_orderkey) as d from orders),
s as (select *, avg(d) over (partition by o_custkey) as step from d)
select o_custkey, count(*) as n, round_even(max(step), 6) as step, round_even(max(abs(d - step)) / max(step), 6) as deviation, max(abs(d - step)) / max(step) < 0.5 as flagged
from s group by o_custkey having count(*) >= 4 and max(step) > 1e-12
""")
def col_arithmetic(spark, sf):
    return C.arithmetic_sequence(_order_columns(spark, sf), ["o_custkey"], 0.5).where("not constant").select("o_custkey", "n", _r("step"), _r("deviation"), "flagged")


@query("""
with d as (select o_custkey, ln(o_orderkey) - lag(ln(o_orderkey)) over (partition by o_custkey order by o_orderkey) as d from orders where o_orderkey > 0),
s as (select *, avg(d) over (partition by o_custkey) as step from d)
select o_custkey, count(*) as n, round_even(exp(max(step)), 5) as ratio, round_even(max(abs(d - step)) / max(step), 4) as deviation
from s group by o_custkey having count(*) >= 4 and max(step) > 1e-12
""")
def col_geometric(spark, sf):
    a = C.arithmetic_sequence(_order_columns(spark, sf), ["o_custkey"], log=True).where("not constant")
    return a.select("o_custkey", "n", F.bround(F.exp("step"), 5).alias("ratio"), _r("deviation", 4))


@query("""
with v as (select l_orderkey, l_linenumber::double as v, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos from lineitem),
d as (select *, v - lag(v) over w as d, first_value(v) over w as f from v window w as (partition by l_orderkey order by pos)),
m as (select *, median(d) over (partition by l_orderkey) as mid from d)
select l_orderkey, count(*) as n, count(*) >= 3 and max(f) in (0, 1) and bool_and(v = f + pos - 1) as is_row_index,
  coalesce(count(*) >= 4 and (bool_and(d > 0) or bool_and(d < 0)) and max(abs(d - mid) / abs(nullif(mid, 0))) <= 0.02, false) as is_axis,
  count(*) >= 10 and count(distinct v) <= least(20, greatest(3, floor(count(*) * 0.05))) as is_category
from m group by l_orderkey
""")
def col_axis_roles(spark, sf):
    pos = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos")
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("v"), pos)
    return C.axis_roles(li.repartition(_tasks(spark), "l_orderkey"), ["l_orderkey"])  # else tasks grow to the advisory size, which sorts need many times


@query(f"""
select l_partkey, col_name, count(*) as n, count(distinct v) as distinct_values, round_even(count(distinct v) / count(*), 6) as ratio,
  count(distinct v) / count(*) < 0.3 and not (bool_and(v = floor(v)) and count(distinct v) <= 20) as flagged
from {_UNPIVOT} group by all having count(*) >= 10
""")
def col_value_recycling(spark, sf):
    return C.value_recycling(_cells(spark, sf, "l_partkey"), ["l_partkey", "col_name"]).select("l_partkey", "col_name", "n", "distinct_values", _r("ratio"), "flagged")


_DIGITS = ", ".join(f"count(*) filter (digit = {k}) as d{k}" for k in range(1, 10))
_CHI8 = " + ".join(f"(d{k} - n * log10(1 + 1.0::double / {k})) ** 2 / (n * log10(1 + 1.0::double / {k}))" for k in range(1, 10))


@query(f"""
with d as (select l_returnflag, l_linestatus, col_name, left(printf('%.10e', abs(v)), 1)::int as digit from {_UNPIVOT} where v <> 0),
c as (select l_returnflag, l_linestatus, col_name, count(*) as n, {_DIGITS} from d group by all having count(*) >= 100)
select l_returnflag, l_linestatus, col_name, n, d1, d9, round_even({_CHI8}, 4) as chi2, {_CHI8} > 15.5073 as flagged from c
""")
def col_benford(spark, sf):
    keys = ["l_returnflag", "l_linestatus", "col_name"]
    return C.benford(_cells(spark, sf, *keys[:2]), keys).select(*keys, "n", "d1", "d9", _r("chi2", 4), "flagged")


_LASTS = ", ".join(f"count(*) filter (abs(v)::bigint % 10 = {k}) as t{k}" for k in range(10))
_CHI9 = " + ".join(f"(t{k} - n / 10) ** 2 / (n / 10)" for k in range(10))


@query(f"""
with c as (select l_returnflag, l_linestatus, count(*) as n, {_LASTS} from (select l_returnflag, l_linestatus, floor(l_extendedprice) as v from lineitem)
  group by all having count(*) >= 50 and median(abs(v)) >= 10 and count(distinct v) >= 10)
select l_returnflag, l_linestatus, n, round_even({_CHI9}, 4) as chi2, {_CHI9} > 21.6660 as flagged, case when {_CHI9} > 27.8772 then 'medium' when {_CHI9} > 21.6660 then 'low' end as severity from c
""")
def col_terminal_digit(spark, sf):
    v = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.floor("l_extendedprice").cast("double").alias("v"))
    return C.terminal_digit(v, ["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus", "n", _r("chi2", 4), "flagged", "severity")


_DECIMALS = "length(rtrim(split_part(v::varchar, '.', 2), '0'))"


@query(f"""
select l_suppkey, col_name, count(*) as n, min({_DECIMALS})::int as fewest, max({_DECIMALS})::int as most, round_even(avg({_DECIMALS}), 6) as mean_decimals, min({_DECIMALS}) = max({_DECIMALS}) as flagged
from {_UNPIVOT} group by all having count(*) >= 5
""")
def col_decimal_uniformity(spark, sf):
    return C.decimal_uniformity(_cells(spark, sf, "l_suppkey"), ["l_suppkey", "col_name"]).select("l_suppkey", "col_name", "n", "fewest", "most", _r("mean_decimals"), "flagged")


@query(f"""
with p as (select l_suppkey, col_name, avg({_DECIMALS}) as m from {_UNPIVOT} group by all having count(*) >= 5)
select lower(col_name) as "column", count(*) as "groups", round_even(min(m), 6) as low, round_even(max(m), 6) as high, count(*) >= 2 and max(m) - min(m) >= 1 as flagged from p group by 1
""")
def precision_cross_group(spark, sf):
    p = C.decimal_uniformity(_cells(spark, sf, "l_suppkey"), ["l_suppkey", "col_name"])
    return C.precision_gaps(p, "col_name", 1).select("column", "groups", _r("low"), _r("high"), "flagged")


@query(f"""
with d as (select p_brand, p_size % 3 as g, p_retailprice as v, length(rtrim(split_part(p_retailprice::varchar, '.', 2), '0')) as decimals from part)
select p_brand, g, count(*) as n, case when bool_and(v = floor(v)) then 'all_integer' when bool_and(v * 2 = floor(v * 2)) then 'all_half_step' when min(decimals) = max(decimals) then 'uniform_decimals' end as pattern
from d group by all having count(*) >= 4 and max(abs(v)) > 0
""")
def col_sd_regularity(spark, sf):
    v = table(spark, sf, "part").select("p_brand", (F.col("p_size") % 3).alias("g"), F.col("p_retailprice").alias("v"))
    return C.sd_regularity(v, ["p_brand", "g"]).select("p_brand", "g", "n", "pattern")


_POS = "select l_suppkey // 5 as sheet, l_suppkey as col, {v} as v, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as pos from lineitem"


def _positions(spark, sf, value):
    li = table(spark, sf, "lineitem").select(F.expr("l_suppkey div 5").alias("sheet"), F.col("l_suppkey").alias("col"), F.col(value).alias("v"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return P.positions(li, ["col"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).select("sheet", "col", "pos", "v")


@query(f"""
with v as ({_POS.format(v='l_discount')})
select x.sheet, x.col as a, y.col as b, count(*) as n, count(*) filter (round_even(x.v, 8) = round_even(y.v, 8)) as equal, round_even(count(*) filter (round_even(x.v, 8) = round_even(y.v, 8)) / count(*), 6) as ratio
from v x join v y on x.sheet = y.sheet and x.pos = y.pos and x.col < y.col group by all having count(*) >= 3
""")
def pair_aligned_duplicates(spark, sf):
    return P.aligned_duplicates(_positions(spark, sf, "l_discount"), ["sheet"], "col").select("sheet", "a", "b", "n", "equal", _r("ratio"))


@query("""
with v as (select distinct l_suppkey // 5 as sheet, l_suppkey as col, round_even(l_quantity, 8) as v from lineitem), s as (select col, count(*) as n from v group by col)
select x.sheet, x.col as a, y.col as b, count(*) as common, round_even(count(*) / least(any_value(p.n), any_value(q.n)), 6) as share
from v x join v y on x.sheet = y.sheet and x.v = y.v and x.col < y.col join s p on p.col = x.col join s q on q.col = y.col group by x.sheet, x.col, y.col
""")
def set_overlap(spark, sf):
    return P.value_overlap(_positions(spark, sf, "l_quantity"), ["sheet"], "col").select("sheet", "a", "b", "common", _r("share"))


@query("""
select l_suppkey, count(*) as n, round_even(regr_slope(l_extendedprice, l_quantity), 3) as slope, round_even(regr_r2(l_extendedprice, l_quantity), 6) as r_squared, regr_r2(l_extendedprice, l_quantity) > 0.9999 as flagged
from lineitem group by l_suppkey having count(*) >= 50 and stddev_pop(l_quantity) > 1e-10 and stddev_pop(l_extendedprice) > 1e-10
""")
def pair_linear_dependency(spark, sf):
    a = P.linear_dependency(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return a.select("l_suppkey", "n", _r("slope", 3), _r("r_squared"), "flagged")


@query("""
with p as (select l_suppkey, l_linestatus as sheet, l_orderkey as r, l_quantity::varchar || '|' || l_discount::varchar || '|' || l_tax::varchar as print from lineitem),
f as (select l_suppkey, sheet, print, min(r) as r from p group by all)
select p.l_suppkey, f.sheet as sheet_a, p.sheet as sheet_b, count(*) as matches, min(f.r) as first_row, case when count(*) >= 5 then 'high' else 'medium' end as severity
from p join f on p.l_suppkey = f.l_suppkey and p.print = f.print and f.sheet < p.sheet group by all having count(*) >= 3
""")
def sheet_row_duplicates(spark, sf):
    return P.row_duplicates(table(spark, sf, "lineitem"), "l_linestatus", "l_orderkey", ["l_quantity", "l_discount", "l_tax"], ["l_suppkey"])


@query("""
with v as (select l_suppkey, l_linestatus as sheet, l_discount as v, row_number() over (partition by l_suppkey, l_linestatus order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as pos from lineitem)
select x.l_suppkey, x.sheet as sheet_a, 'l_discount' as column_a, y.sheet as sheet_b, 'l_discount' as column_b, count(*) as n, count(*) filter (x.v = y.v) as equal, count(*) filter (x.v = y.v) / count(*) >= 0.9 as flagged
from v x join v y on x.l_suppkey = y.l_suppkey and x.pos = y.pos and x.sheet < y.sheet group by all having count(*) >= 3 and count(distinct x.v) > 1
""")
def sheet_column_duplicates(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_linestatus", F.lit("l_discount").alias("column"), F.col("l_discount").alias("v"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    v = P.positions(li, ["l_suppkey", "l_linestatus"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return P.column_duplicates(v, ["l_suppkey"], "l_linestatus", "column").select("l_suppkey", "sheet_a", "column_a", "sheet_b", "column_b", "n", "equal", "flagged")


@query("""
select l_partkey, count(*) as n, round_even(avg(l_quantity), 2) as mean,
  round_even((round_even(avg(l_quantity) * count(*), 0)) / count(*), 2) = round_even(avg(l_quantity), 2) or round_even((round_even(avg(l_quantity) * count(*), 0) - 1) / count(*), 2) = round_even(avg(l_quantity), 2)
  or round_even((round_even(avg(l_quantity) * count(*), 0) + 1) / count(*), 2) = round_even(avg(l_quantity), 2) as possible
from lineitem group by l_partkey
""")
def grim_means(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"))
    return a.select("l_partkey", "n", _r("mean", 2), N.grim(F.col("mean"), F.col("n"), 2).alias("possible"))


def _findings(spark, sf) -> DataFrame:
    """Findings of the column tests over suppliers, as the scorer reads them; suppliers stand for bundles."""
    from ..operators import sheets as H

    li = table(spark, sf, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("pos"), *MEASURES)
    none = lambda t: F.lit(None).cast(t)
    shape = lambda df, p=None: df.where("severity is not null").select(
        F.col("l_suppkey").alias("bundle_id"), F.lit("data").alias("kind"), F.concat_ws("/", "test", "col_name").alias("ord"), "test", "severity",
        *(none("double").alias(c) for c in ("r_squared", "slope", "intercept", "overlap_ratio")), (F.col(p) if p else none("double")).alias("p_value"), none("double").alias("title_similarity"), none("string").alias("match_type"),
        none("int").alias("page_a"), none("int").alias("page_b"), none("string").alias("image_a"), none("string").alias("image_b"),
    )
    figures = cut(H.row_figures(li, ["l_suppkey"], "col_name", MEASURES))
    columns = H.column_findings(figures, ["l_suppkey"], "col_name", 0.55)
    digits = figures.select("l_suppkey", "col_name", F.col("nonzero").alias("n"), *(F.col(f"b{k}").alias(f"d{k}") for k in range(1, 10)))
    benford = C.benford_of(digits).withColumn("test", F.lit("benfords_law"))
    return shape(columns).unionByName(shape(benford, "p_value"))


def _papers(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("bundle_id"), F.lit(0).alias("total_references"))


_FOUND_SQL = f"""
xf as (select l_suppkey, test, severity, null::double as p, test || '/' || col_name as ord from single
  union all select l_suppkey, 'benfords_law', 'medium', exp(-chi / 2) * (1 + chi / 2 + (chi / 2) ** 2 / 2 + (chi / 2) ** 3 / 6), 'benfords_law/' || col_name from (select l_suppkey, col_name, {_CHI8} as chi from (select l_suppkey, col_name, count(*) as n, {_DIGITS} from (select l_suppkey, col_name, left(printf('%.10e', abs(v)), 1)::int as digit from {_UNPIVOT} where v <> 0) group by all having count(*) >= 100)) where chi > 15.5073),
xc as (select *, case when severity = 'high' and row_number() over (partition by l_suppkey, test, severity order by ord) > case test when 'arithmetic_sequence' then 8 when 'coefficient_of_variation' then 6 else 1000000 end then 'medium' else severity end as level from xf),
xd as (select l_suppkey, count(*) as n, count(*) filter (level = 'high') as h, count(*) filter (level = 'medium') as m, count(*) filter (level = 'low') as l, bool_or(test = 'coefficient_of_variation' and severity = 'high')::int + bool_or(test = 'arithmetic_sequence' and severity = 'high')::int + bool_or(test = 'geometric_sequence' and severity = 'high')::int + coalesce(bool_or(test = 'benfords_law' and p < 0.001), false)::int + (count(*) > 100)::int as fraud from xc group by 1),
xe as (select s_suppkey, coalesce(h, 0) as h, coalesce(fraud, 0) as fraud, coalesce(least(100, least(80, h * 10) + least(25, m * 4) + least(12, round_even(l * 0.5, 0)::int) + case when n > 150 then 20 when n > 80 then 12 when n > 30 then 6 else 0 end), 0)::int as data_score from supplier left join xd on l_suppkey = s_suppkey),
xg as (select *, least(100, round_even(greatest(0.65 * data_score + 0.1 * data_score, 0.95 * data_score), 0)::int + case when fraud >= 4 and h > 0 then 5 else 0 end) as s from xe),
xk as (select *, case when data_score > 60 and s <= 60 then 61 else s end::int as score from xg)
select s_suppkey as bundle_id, score, case when data_score > 60 or (score >= 60 and data_score >= 60) then '高风险' else '低风险' end as level, case when data_score > 60 or (score >= 60 and data_score >= 60) then 'data' else '' end as high_dimensions, 0 as image_score, data_score, 0 as reference_score from xk
"""


@query("score_overall")
def score_overall(spark, sf):
    return score.overall(_findings(spark, sf), _papers(spark, sf))


@query("""
with c as (select l_suppkey, col_name, stddev_samp(v) / abs(avg(v)) as cv, count(*) as n, count(distinct v) / count(*) as ratio, bool_and(v = floor(v)) and count(distinct v) <= 20 as few, count(distinct v) as dv from """ + _UNPIVOT + """ group by all),
f as (select l_suppkey, case when cv < 0.055 then 'high' else 'medium' end as severity, 'coefficient_of_variation' as test from c where cv < 0.55 and n >= 3
  union all select l_suppkey, case when (case when n >= 500 then ratio < 0.05 else ratio < 0.15 end) and not (n >= 500 and dv >= 20) then 'high' else 'medium' end, 'value_recycling' from c where n >= 10 and ratio < 0.3 and not few)
select test, severity, count(*) as n from f group by rollup(test, severity)
""")
def severity_rollup(spark, sf):
    return score.summary(_findings(spark, sf).where(F.col("test").isin("coefficient_of_variation", "value_recycling")))


@query("""
with d as (select o_custkey, count(*) filter (o_orderpriority = '1-URGENT') as h, count(*) filter (o_orderpriority = '2-HIGH') as m, count(*) filter (o_orderpriority not in ('1-URGENT', '2-HIGH')) as l from orders group by all)
select o_custkey, h as high, m as medium, l as low, least(100, least(80, h * 10) + least(25, m * 4) + least(12, round_even(l * 0.5, 0)::int) + case when h + m + l > 150 then 20 when h + m + l > 80 then 12 when h + m + l > 30 then 6 else 0 end)::int as score from d
""")
def score_dimension(spark, sf):
    p = F.col("o_orderpriority")
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(p == "1-URGENT").alias("high"), F.count_if(p == "2-HIGH").alias("medium"), F.count_if(~p.isin("1-URGENT", "2-HIGH")).alias("low"))
    return a.withColumn("score", score.dimension_score(F.col("high"), F.col("medium"), F.col("low")))


@query("""
with r as (select o_custkey, o_orderkey, case when o_orderpriority < '3' then 'high' else 'low' end as s, row_number() over (partition by o_custkey, o_orderpriority < '3' order by o_orderkey) as k from orders)
select o_custkey, count(*) filter (s = 'high' and k <= 6) as high, count(*) filter (s = 'high' and k > 6) as medium, count(*) filter (s = 'low') as low from r group by o_custkey
""")
def severity_cap(spark, sf):
    none = lambda t: F.lit(None).cast(t)
    f = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("bundle_id"), F.lit("data").alias("kind"), F.col("o_orderkey").alias("ord"), F.lit("coefficient_of_variation").alias("test"), F.when(F.col("o_orderpriority") < "3", "high").otherwise("low").alias("severity"),
        *(none("double").alias(c) for c in ("r_squared", "slope", "intercept", "overlap_ratio", "title_similarity")),
    )
    return score.capped(f).groupBy(F.col("bundle_id").alias("o_custkey")).agg(*(F.count_if(F.col("level_of") == s).alias(s) for s in ("high", "medium", "low")))


@query("""
with a as (select l_suppkey, avg(l_discount) > 0.05 as old, avg(l_tax) > 0.04 as new from lineitem group by all)
select case when old then '高风险' else '低风险' end as old_level, case when new then '高风险' else '低风险' end as new_level, count(*) as n from a group by all
""")
def level_flips(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("bundle_id")).agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    level = lambda c: F.when(c, score.HIGH).otherwise(score.LOW).alias("level")
    return score.level_flips(a.select("bundle_id", level(F.col("d") > 0.05)), a.select("bundle_id", level(F.col("t") > 0.04)))


@query("""
select case when l.quality = 1 then 'user_labeled' else 'retracted' end as label_source, count(*) as n, count(*) filter (toxic = 1) as expected_high, count(*) filter (toxic = 1 and coalesce(d.n_chars > 3000, false)) as found_high,
  round_even(avg(((toxic = 1) = coalesce(d.n_chars > 3000, false))::int), 6) as agreement
from labels l left join documents d on l.doc_id = d.doc_id group by 1
""")
def recall_by_source(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "user_labeled").otherwise("retracted").alias("label_source"), (F.col("toxic") == 1).alias("expected"))
    found = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 3000).alias("found"))
    return score.recall(labels, found, "doc_id").select("label_source", "n", "expected_high", "found_high", _r("agreement"))


@query("""
with p as (select doc_id, 'first' as pass, case when toxic = 1 then 'high' when quality = 0 then 'error' else 'low' end as result from labels
  union all select doc_id, 'second', case when doc_id % 7 = 0 then 'high' when doc_id % 11 = 0 then 'error' else 'low' end from labels
  union all select doc_id, 'judge', case when doc_id % 3 = 0 then 'low' when doc_id % 5 = 0 then 'error' else 'high' end from labels),
w as (select doc_id, max(result) filter (pass = 'first') as f, max(result) filter (pass = 'second') as s, max(result) filter (pass = 'judge') as j from p group by doc_id),
d as (select doc_id, case when f = 'high' then 'high' when f = 'low' and s = 'low' then 'low' when f = 'error' and s = 'high' and coalesce(j not in ('high', 'low'), true) then 'high' when j in ('high', 'low') then j
  when f in ('high', 'low') and s in ('high', 'low') then 'high' when f in ('high', 'low') then f when s in ('high', 'low') then s else 'error' end as final from w)
select doc_id, final, case final when 'high' then '高风险' when 'low' then '低风险' end as level from d
""")
def review_decision(spark, sf):
    d, t, q = F.col("doc_id"), F.col("toxic"), F.col("quality")
    labels = table(spark, sf, "labels")
    one = lambda name, c: labels.select("doc_id", F.lit(name).alias("pass"), c.alias("result"), F.lit("").alias("data_review"))
    first = one("first", F.when(t == 1, "high").when(q == 0, "error").otherwise("low"))
    second = one("second", F.when(d % 7 == 0, "high").when(d % 11 == 0, "error").otherwise("low"))
    judge = one("judge", F.when(d % 3 == 0, "low").when(d % 5 == 0, "error").otherwise("high"))
    return review.verdicts(first.unionByName(second).unionByName(judge), "doc_id").select("doc_id", "final", "level")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def anti_skip_done(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return U.not_done(table(spark, sf, "customer"), done, "c_custkey").select("c_custkey", "c_name")


@query("select s_suppkey, s_name from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def semi_allowlist(spark, sf):
    names = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return U.allowed(table(spark, sf, "supplier"), names, "s_nationkey").select("s_suppkey", "s_name")


@query("""
select c.c_custkey, coalesce(case when trim(o.m) <> '' then o.m end, c.c_mktsegment) as c_mktsegment from customer c
left join (select o_custkey, max(case when o_orderstatus = 'F' then o_orderpriority else ' ' end) as m from orders group by 1) o on c.c_custkey = o.o_custkey
""")
def left_override(spark, sf):
    better = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(" ")).alias("c_mktsegment"))
    return U.override(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), better, "c_custkey", ["c_mktsegment"])


@query("""
with o as (select c_nationkey as k, count(*) as customers from customer group by 1), n as (select s_nationkey as k, count(*) as suppliers from supplier group by 1)
select coalesce(o.k, n.k) as nation, coalesce(customers, 0) as customers, coalesce(suppliers, 0) as suppliers from o full join n on o.k = n.k
""")
def full_outer_keys(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full_outer").na.fill(0, ["customers", "suppliers"])


@query("""
with t as (select c_custkey, nullif(c_nationkey, 3) as fold, c_acctbal as score from customer where c_mktsegment <> 'BUILDING'), u as (select c_custkey, nullif(c_nationkey, 3) as fold, -c_acctbal as score from customer where c_acctbal < 5000 and c_nationkey <> 7)
select coalesce(u.c_custkey, t.c_custkey) as c_custkey, case when u.c_custkey is not null then u.fold else t.fold end as fold, coalesce(u.score, t.score) as score, case when u.c_custkey is null then 'kept' when t.c_custkey is null then 'inserted' else 'updated' end as action
from t full join u on t.c_custkey = u.c_custkey and t.fold is not distinct from u.fold
""")
def upsert_results(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("fold"), F.col("c_acctbal").alias("score"))
    segments = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey")
    protected = c.where("fold = 7").select("c_custkey", "fold")
    updates = c.where("score < 5000").withColumn("score", -F.col("score"))
    return U.upsert(U.allowed(c, segments, "c_custkey"), updates, ["c_custkey", "fold"], protected)


_PREFIXES = [("https://", "secure"), ("https://www.", "secure www"), ("http://", "plain"), ("http://blog.", "blog"), ("https://m.", "mobile")]


@query("""
select page_id, case when url like 'https://www.%' then 'secure www' when url like 'http://blog.%' then 'blog' when url like 'https://m.%' then 'mobile' when url like 'https://%' then 'secure' when url like 'http://%' then 'plain' end as label from pages
""")
def longest_prefix(spark, sf):
    pre = spark.createDataFrame(_PREFIXES, "prefix string, label string")
    return U.longest_prefix(table(spark, sf, "pages").select("page_id", "url"), pre, "url", "prefix", "label").select("page_id", "label")


@query("""
with there as (select distinct 'Customer#' || lpad(o_custkey::varchar, 9, '0') as name from orders where o_orderstatus = 'F' union select distinct 'C' || o_custkey from orders where o_orderstatus = 'P'),
tries as (select c_custkey, c_name as name, 0 as priority from customer union all select c_custkey, 'C' || c_custkey, 1 from customer)
select c_custkey, arg_min(t.name, priority) as name, min(priority)::int as priority from tries t join there h on h.name = t.name group by 1
""")
def candidate_slug(spark, sf):
    o = table(spark, sf, "orders")
    there = o.where("o_orderstatus = 'F'").select(F.format_string("Customer#%09d", "o_custkey").alias("name")).union(o.where("o_orderstatus = 'P'").select(F.concat(F.lit("C"), "o_custkey"))).distinct()
    return U.best_candidate(table(spark, sf, "customer"), there, "c_custkey", "name", [F.col("c_name"), F.concat(F.lit("C"), "c_custkey")])


@query("""
select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders) where rank <= 3
""")
def topk_per_group(spark, sf):
    return U.top_k(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("select o_orderkey, o_custkey from orders order by o_orderdate desc, o_orderkey limit 50 offset 100")
def page_offset(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_custkey")


@query("""
with n as (select user_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 10 as batch from events) select user_id, batch, count(*) as n, count(*) = 10 as launched from n group by all
""")
def fixed_batches(spark, sf):
    return U.batches(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 10)


@query("""
with m as (select user_id, ts, event_type = 'error' as bad, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) as run from events)
select user_id, count(*) as length, min(ts) as first from m where bad group by user_id, run having count(*) >= 2
""")
def consecutive_failures(spark, sf):
    return U.failure_runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 2)


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) where k = 1")
def last_wins(spark, sf):
    return U.latest(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("select user_id, arg_max(event_type, (ts, event_id)) as status, max(ts) as at, count(*) as steps from events group by user_id")
def progress_latest(spark, sf):
    return M.progress(table(spark, sf, "events"), "user_id")


@query("""
select event_id, user_id from events where event_type <> 'purchase' and epoch(timestamp '2024-01-31 00:00:00') - floor(epoch(ts)) > 21600 and floor(value / 10) < 2
""")
def stale_claims(spark, sf):
    claims = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", "done").otherwise("open").alias("status"), F.col("ts").alias("claimed"), F.floor(F.col("value") / 10).alias("attempts"))
    return U.stale(claims, F.lit("2024-01-31 00:00:00").cast("timestamp"), 21_600, 2).select("event_id", "user_id")


@query("""
select event_type, arg_min(event_id, ts) as first, arg_max(event_id, ts) as last, (floor(epoch(max(ts))) - floor(epoch(min(ts))))::bigint as seconds,
  round_even((arg_max(event_id, ts) - arg_min(event_id, ts)) * 3600.0::double / (floor(epoch(max(ts))) - floor(epoch(min(ts)))), 4) as per_hour from events group by 1
""")
def rate_eta(spark, sf):
    return U.rate(table(spark, sf, "events"), ["event_type"], "ts", "event_id").withColumn("per_hour", F.bround("per_hour", 4))


@query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round_even(sum(value), 2) as total from events group by 1, 2")
def tumbling(spark, sf):
    return M.tumbling(table(spark, sf, "events"), late=None).withColumn("total", F.bround("total", 2))


@query("""
with w as (select date_trunc('day', ts) - to_days(k::int) as start from events, range(0, 2) as r(k)) select start, count(*) as n from w group by 1
""")
def sliding(spark, sf):
    return M.sliding(table(spark, sf, "events"), late=None)


@query("""
with g as (select user_id, ts, coalesce(ts - lag(ts) over w >= interval '6 hours', true) as opens from events window w as (partition by user_id order by ts)),
s as (select *, sum(opens::int) over (partition by user_id order by ts) as k from g)
select user_id, min(ts) as start, max(ts) + interval '6 hours' as "end", count(*) as n from s group by user_id, k
""")
def sessions(spark, sf):
    return M.sessions(table(spark, sf, "events"), late=None)


@query("""
select time_bucket(interval '1 day', ts) as start, count(*) as n, count(*) filter (event_type = 'error') as bad, count(*) >= 50 and count(*) filter (event_type = 'error') > 0.2 * count(*) as alert from events group by 1
""")
def high_rate_monitor(spark, sf):
    return M.threshold_alerts(table(spark, sf, "events"))


@query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round_even(sum(value), 2) as total from events group by 1, 2")
def stream_tumbling(spark, sf):
    """The tumbling counts by a file stream that processes what is there and stops."""
    import uuid

    schema = table(spark, sf, "events").schema
    base = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    events = M.event_stream(spark, f"{sf}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = M.tumbling(events, late=None)
    M.run_updates(counts, f"{base}/out", f"{base}/state")
    return M.last_state(spark.read.schema(M.updates_schema(counts)).parquet(f"{base}/out/*"), ["start", "event_type"]).withColumn("total", F.bround("total", 2))


@query("select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, regexp_extract(html, '(?i)<html[^>]*\\blang=\"([^\"]*)\"', 1) as lang from pages")
def html_title(spark, sf):
    return G.titles(table(spark, sf, "pages"), "page_id", "html")


@query("""
with l as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) as href, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) as label, unnest(range(0, len(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'))))::int as ord from pages)
select page_id, ord, href, label from l
""")
def html_links(spark, sf):
    return G.links(table(spark, sf, "pages"), "page_id", "html")


@query("""
with t as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') as t from pages)
select page_id, length(trim(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))::int as n, sha256(trim(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as digest from t
""")
def html_text(spark, sf):
    return G.texts(table(spark, sf, "pages"), "page_id", "html").select("page_id", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))


@query("""
with w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as w from documents),
c as (select doc_id, len(w) as n, list_sum(list_transform(w, lambda x: length(x))) as letters, length(text) - length(replace(text, ' ', '')) as spaces, len(list_filter(w, lambda x: length(x) > 15)) as longs, length(text) as chars from w)
select doc_id, chars >= 20 and (n = 0 or letters > 20 * n or spaces < 0.04 * chars or 2 * longs > n) as garbled from c
""")
def garbled_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(S.is_garbled(F.col("text")), F.lit(False)).alias("garbled"))


@query("""
select doc_id, length(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'))::int as n, sha256(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) as key from documents
""")
def text_keys(spark, sf):
    key = S.key(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(key).alias("n"), F.sha2(key, 256).alias("key"))


@query("""
with b as (select item_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 3)) as ws from benchmark),
w as (select item_id, unnest(ws) as word from b), n as (select count(*) as n from benchmark), df as (select word, count(*) as df from w group by 1),
i as (select word, ln((n.n + 1) / df) as idf from df, n where df <= greatest(1, n.n // 10)),
d as (select doc_id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 3))) as word from documents)
, s as (select doc_id, item_id, sum(idf) as score from d join w using (word) join i using (word) group by all)
select doc_id, round_even(max(score), 4) as score from s group by doc_id
""")
def text_lookup(spark, sf):
    refs = table(spark, sf, "documents").select("doc_id", "text")
    works = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("title"))
    return X.best_works(refs, works, "doc_id", "item_id").select("doc_id", F.bround("score", 4).alias("score"))


@query("""
with v as (select vec_id, list_sum(list_transform(range(0, 63), lambda k: case when embedding[k + 1] > 0 then 1::bigint << k::int else 0 end))::bigint as h from embeddings)
select x.vec_id as query, y.vec_id as match, bit_count(xor(x.h, y.h))::int as distance from v x join v y on x.vec_id % 50 = 0 and x.vec_id <> y.vec_id where bit_count(xor(x.h, y.h)) <= 20
""")
def hamming_matches(spark, sf):
    h = table(spark, sf, "embeddings").select("vec_id", I.sign_bits(F.col("embedding"), 63).alias("h"))
    return I.hamming_matches(h.where("vec_id % 50 = 0"), h, "vec_id", "h", 20).select("query", "match", "distance")


@query("""
with p as (select q.vec_id as query, b.vec_id as match, sqrt(list_sum(list_transform(range(1, 65), lambda k: (q.embedding[k]::double - b.embedding[k]::double) ** 2))) as d from embeddings q join embeddings b on q.label = b.label and q.vec_id <> b.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query order by d, match) as k, lead(d) over (partition by query order by d, match) as d2 from p)
select query, match, round_even(d, 5) as distance from r where k = 1 and d < 0.95 * d2
""")
def knn_ratio(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("embedding", F.slice("embedding", 1, 64))
    return I.ratio_matches(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "label", 0.95).select("query", "match", _r("distance", 5))


def _atoms(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").cast("string").alias("serial"), F.concat_ws("|", "l_partkey", "l_linenumber").alias("identity"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), (F.col("l_quantity") / 49).alias("occupancy"), (F.col("l_quantity") - 3).alias("b_factor"))


@query("""
with a as (select l_suppkey as file, l_orderkey::varchar as serial, l_partkey || '|' || l_linenumber as identity, l_quantity as x, l_discount as y, l_tax as z from lineitem),
i as (select file, sum(n)::bigint as records, count(*) as "groups" from (select file, count(*) as n from a group by file, identity having count(*) > 1) group by file),
s as (select file, sum(n)::bigint as records, count(*) as "groups" from (select file, count(*) as n from a group by file, serial having count(*) > 1) group by file),
c as (select file, sum(n)::bigint as records, count(*) as "groups" from (select file, count(*) as n from a group by file, x, y, z having count(distinct identity) >= 2) group by file)
select file, 'pdb_duplicate_atom_identity' as test, records, "groups", case when records >= 10 or "groups" >= 5 then 'high' else 'medium' end as severity from i
union all select file, 'pdb_duplicate_atom_serial', records, "groups", case when records >= 10 then 'medium' else 'low' end from s
union all select file, 'pdb_duplicate_coordinates', records, "groups", case when records >= 20 or "groups" >= 10 then 'high' else 'medium' end from c
""")
def atom_duplicates(spark, sf):
    return A.duplicate_findings(_atoms(spark, sf), "file")


@query("""
with a as (select l_suppkey as file, count(*) filter (l_quantity / 49 > 1) as o, count(*) filter (l_quantity < 3) as b from lineitem group by 1)
select file, 'pdb_invalid_occupancy' as test, o as records, case when o >= 20 then 'high' else 'medium' end as severity from a where o > 0
union all select file, 'pdb_negative_bfactor', b, case when b >= 10 then 'medium' else 'low' end from a where b > 0
""")
def atom_ranges(spark, sf):
    return A.range_findings(_atoms(spark, sf), "file")


@query("""
with r as (select page_id, url, case when url not like 'https://%' then 'other prefix' end as why from pages)
select page_id, case when why is null then 'store://new/' || substring(url, 9) end as new_url, coalesce(why, '') as blocked from r
""")
def migration_plan(spark, sf):
    return U.migration_plan(table(spark, sf, "pages").select("page_id", "url"), "url", "https://", "store://new/").select("page_id", "new_url", F.array_join("blocked", ",").alias("blocked"))


@query("""
with s as (select c_custkey as k, c_acctbal as size from customer where c_mktsegment <> 'BUILDING'), t as (select c_custkey as k, case when c_nationkey < 9 then c_acctbal else 0 end as size from customer where c_acctbal < 5000)
select coalesce(s.k, t.k) as k, case when t.k is null then 'copy' when s.k is null then 'keep' when s.size = t.size then 'skip' when s.size > t.size then 'replace' else 'keep' end as action from s full join t on s.k = t.k
""")
def file_merge_plan(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("size"), "c_nationkey", "c_mktsegment")
    t = c.where("size < 5000").withColumn("size", F.when(F.col("c_nationkey") < 9, F.col("size")).otherwise(0.0))
    return U.merge_plan(c.where("c_mktsegment <> 'BUILDING'"), t, ["k"], "size").select("k", "action")


@query("""
with n as (select distinct split_part(p_name, ' ', 1) as name from part union select distinct split_part(p_name, ' ', 2) from part union select unnest(['dose', 'nodeScore', 'P value', 'tumor_volume_a', 'col_7', '12.5', 'std', 'Sample number']))
select name, name in ('dose', 'nodeScore', 'Sample number') as is_axis, name = 'P value' as is_statistic, name not in ('dose', 'nodeScore', 'P value', 'col_7', '12.5', 'std', 'Sample number') as is_measurement from n
""")
def column_roles(spark, sf):
    p = F.split(F.col("p_name"), " ")
    part = table(spark, sf, "part")
    given = spark.createDataFrame([(x,) for x in ("dose", "nodeScore", "P value", "tumor_volume_a", "col_7", "12.5", "std", "Sample number")], "name string")
    n = part.select(p[0].alias("name")).union(part.select(p[1])).union(given).distinct()
    return n.select("name", R.is_axis(F.col("name")).alias("is_axis"), R.is_statistic(F.col("name")).alias("is_statistic"), R.is_measurement_name(F.col("name")).alias("is_measurement"))


@query("""
with l as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) as href, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) as label, unnest(range(0, len(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'))))::int + 1 as number from pages)
select page_id, number::int as number, trim(regexp_replace(label || ' ' || href, '\\s+', ' ', 'g')) as text, null::varchar as doi from l
""")
def references_extracted(spark, sf):
    """Numbered references under a heading, from page texts whose list items become numbered lines."""
    items = G.links(table(spark, sf, "pages"), "page_id", "html").select("page_id", (F.col("ord") + 1).alias("n"), F.concat_ws(" ", "label", "href").alias("t"))
    listed = items.groupBy("page_id").agg(F.concat(F.lit("References\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["t"])), "\n")).alias("text"))
    return X.references(listed, "page_id", "text")


@query("""
with f as (select p_partkey, left(regexp_replace(lower(p_name || p_brand), '[^a-z0-9]+', '', 'g'), 30) as n from part where p_type = 'ECONOMY'),
t as (select p_partkey, left(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), 30) as n from part where p_type <> 'ECONOMY')
select f.p_partkey as file_id, min(t.p_partkey) as paper from f join t on length(f.n) >= 8 and length(t.n) >= 8 and left(f.n, 8) = left(t.n, 8) and (starts_with(f.n, t.n) or starts_with(t.n, f.n)) group by 1
""")
def fuzzy_title(spark, sf):
    part = table(spark, sf, "part")
    files = part.where("p_type = 'ECONOMY'").select("p_partkey", F.concat("p_name", "p_brand").alias("file"))
    papers = part.where("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("paper"), F.col("p_name").alias("title"))
    hits = U.fuzzy_names(files.select("file").distinct(), papers, "file", "title", "paper", least=8)
    return files.join(hits, "file").select(F.col("p_partkey").alias("file_id"), "paper")


@query()
def title_similarity(spark, sf):
    """Word coverage of a document's best benchmark text, or the exact ratio of the whole title where that is more."""
    from ..operators.exact import title_ratio

    docs = table(spark, sf, "documents").select("doc_id", "text")
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("title"))
    best = X.best_works(docs, items, "doc_id", "item_id")
    # few bytes, much work: adaptive plans would leave the texts in as few tasks as their bytes fill, and a join by item would gather them
    spread = lambda x: x.repartition(_tasks(spark), "doc_id")
    pairs = cut(spread(best.join(items, "item_id")).join(spread(docs).hint("merge"), "doc_id").withColumn("coverage", X.title_coverage(F.col("title"), F.col("text"))))
    open_ = pairs.where("coverage < 1").withColumn("similarity", F.greatest("coverage", title_ratio(X.normal(F.col("title")), X.normal(F.col("text")), F.col("coverage"))))
    done = pairs.where("coverage >= 1").withColumn("similarity", F.col("coverage"))
    return done.unionByName(open_).select("doc_id", "item_id", "coverage", "similarity")


@query(f"""
with d as (select l_suppkey, left(printf('%.10e', abs(l_extendedprice)), 1)::int as digit from lineitem where l_extendedprice <> 0), c as (select l_suppkey, count(*) as n, {_DIGITS} from d group by all having count(*) >= 100), x as (select l_suppkey, {_CHI8} as chi from c)
select l_suppkey, round_even(chi, 4) as chi2, round_even(exp(-chi / 2) * (1 + chi / 2 + (chi / 2) ** 2 / 2 + (chi / 2) ** 3 / 6), 6) as p from x
""")
def p_values(spark, sf):
    """p of the chi-square of each supplier's first digits, in closed form."""
    c = C.benford(_cells(spark, sf, "l_suppkey").where("col_name = 'l_extendedprice'"), ["l_suppkey"])
    return c.select("l_suppkey", _r("chi2", 4), F.bround("p_value", 6).alias("p"))


@query()
def citation_groups(spark, sf):
    """Citations of author-first lists by a fold over the sentences of a document as lines."""
    from .rule_queries import citation_lines

    lines = citation_lines(spark, sf).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines"))
    return lines.select("doc_id", F.size("lines").alias("n_lines"), F.size(X.grouped_lines(F.col("lines"))).alias("n_groups"))


@query("""
with recursive e as (select user_id, event_id, floor(epoch(ts))::bigint as s, row_number() over (partition by user_id order by floor(epoch(ts)), event_id) as i from events),
f(user_id, i, event_id, action, held, attempts) as (select user_id, i, event_id, 'claim', s, 1 from e where i = 1
  union all select e.user_id, e.i, e.event_id, case when e.s - f.held <= 21600 then 'busy' when f.attempts >= 2 then 'give up' else 'retry' end, case when e.s - f.held <= 21600 or f.attempts >= 2 then f.held else e.s end, case when e.s - f.held <= 21600 or f.attempts >= 2 then f.attempts else f.attempts + 1 end from f join e on e.user_id = f.user_id and e.i = f.i + 1)
select user_id, event_id, action from f
""")
def stream_claims(spark, sf):
    """Claims, retries and give-ups of each user's events, kept as state of a stream."""
    import uuid

    base = f"{_shared(spark)}/claims-{uuid.uuid4().hex}"
    out = M.claims(M.event_stream(spark, f"{sf}/events*.parquet", table(spark, sf, "events").schema))
    M.run_available(out, f"{base}/out", f"{base}/state")
    return spark.read.schema(out.schema).parquet(f"{base}/out")


from . import feed_queries, record_queries, rule_queries, score_queries  # noqa: E402, F401  (register their queries)

_SQL["score_overall"] = f"with {record_queries._BATTERY}, {_FOUND_SQL.strip()}"
