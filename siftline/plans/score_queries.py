"""The combined level of bundles with findings of every kind, made of ``lineitem`` rows, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import score
from .queries import query

#: One finding for each row; eight orders make a bundle, whose profile decides what kinds it mostly has. Both engines run
#: these expressions.
_BUNDLE = "cast(floor(l_orderkey / 8) as bigint)"
_PROFILE = f"{_BUNDLE} % 12"
_HASH = "cast((l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7) % 100 as int)"
_KIND = f"""case when {_PROFILE} in (0, 4) then case when {_HASH} < 80 then 'data' else 'reference' end
  when {_PROFILE} in (1, 5) then case when {_HASH} < 50 then 'image' when {_HASH} < 80 then 'data' else 'reference' end
  when {_PROFILE} = 2 then case when {_HASH} < 6 then 'splice' else 'data' end
  when {_PROFILE} in (3, 7) then case when {_HASH} < 80 then 'reference' else 'data' end
  when {_PROFILE} = 6 then 'image'
  when {_HASH} < 40 then 'data' when {_HASH} < 60 then 'image' when {_HASH} < 95 then 'reference' else 'splice' end"""
_DATA_TESTS = ("coefficient_of_variation", "arithmetic_sequence", "geometric_sequence", "cross_group_duplicate", "linear_dependency", "benfords_law", "value_recycling", "value_recycling")
_REFERENCE_TESTS = ("title_mismatch", "low_match_score", "doi_not_found", "not_found")
_FIELDS = {
    "bundle_id": _BUNDLE,
    "kind": _KIND,
    "ord": "l_orderkey * 10 + l_linenumber",
    "test": f"case {_KIND} when 'data' then case when {_PROFILE} = 4 and l_partkey % 2 = 0 then 'value_recycling' else case l_partkey % 8 "
    + " ".join(f"when {k} then '{t}'" for k, t in enumerate(_DATA_TESTS))
    + " end end when 'reference' then case l_partkey % 4 "
    + " ".join(f"when {k} then '{t}'" for k, t in enumerate(_REFERENCE_TESTS))
    + " end when 'image' then 'image_duplicate' else 'splice' end",
    "severity": f"case when {_PROFILE} in (2, 8, 10) and l_linenumber > 1 then 'low' when (l_suppkey * 3 + l_linenumber) % 10 < 3 then 'high' when (l_suppkey * 3 + l_linenumber) % 10 < 6 then 'medium' else 'low' end",
    "r_squared": "case l_linenumber % 3 when 0 then 0.999995 when 1 then 0.99995 else 0.9 end",
    "slope": "case l_partkey % 3 when 0 then 1.5 else 1.005 end",
    "intercept": "case l_suppkey % 3 when 0 then 2.0 else 0.005 end",
    "overlap_ratio": "l_quantity * 0.02",
    "p_value": f"case when {_HASH} % 4 = 0 then 0.0001 else 0.02 end",
    "title_similarity": f"{_HASH} * 0.01",
    "match_type": "case l_linenumber % 2 when 0 then 'full_duplicate' else 'part' end",
    "page_a": f"cast(case when {_PROFILE} = 6 then l_linenumber % 3 else l_linenumber end as int)",
    "page_b": f"cast(case when {_PROFILE} = 6 then 1 + l_partkey % 2 else l_partkey % 9 end as int)",
    "image_a": "'i' || cast(l_suppkey % 5 as varchar(9))",
    "image_b": "'i' || cast(5 + l_partkey % 5 - l_partkey % 7 as varchar(9))",
    "size_a": "cast(case when l_orderkey % 37 = 0 then 1000 else 5000 end as int)",
    "size_b": "5000",
    "ref_text": f"case when {_HASH} % 11 = 0 then 'short' else 'Lee K. A study of the sea, Journal of Seas, 2004' end",
    "resolved_doi": f"case when {_HASH} % 3 = 0 then '10.1/x' end",
}
_REFERENCES = "case when {b} % 5 = 0 then 0 else 20 + {b} % 30 end"


@query(f"""
with f as (select {", ".join(f"{x} as {n}" for n, x in _FIELDS.items())} from lineitem),
r as (
  select *, image_a <> image_b and not (page_a > 0 and page_a = page_b) as crosses, case
    when test = 'linear_dependency' then case when r_squared > 0.99999 then case when abs(slope - 1) < 0.01 and abs(intercept) < 0.01 then 'high' else 'medium' end else 'low' end
    when test = 'cross_group_duplicate' then case when overlap_ratio >= 0.95 then 'high' when overlap_ratio >= 0.9 then 'medium' else 'low' end
    when test in ('title_mismatch', 'low_match_score') and title_similarity < 0.5 then 'high' when test in ('title_mismatch', 'low_match_score') and title_similarity < 0.75 then 'medium' else severity end as new
  from f
),
n as (select *, row_number() over (partition by bundle_id, kind, test, new order by ord) as no from r),
c as (select *, case when kind = 'data' and new = 'high' and ((test = 'arithmetic_sequence' and no > 8) or (test = 'coefficient_of_variation' and no > 6)) then 'medium' else new end as lev from n),
d as (select *, case when kind = 'splice' then 'image' else kind end as dim, kind <> 'image' or crosses as counted, (test in ('title_mismatch', 'low_match_score') and resolved_doi is not null) or ref_text = 'short' as noise from c),
a as (
  select bundle_id, {", ".join(f"count(*) filter (counted and dim = '{k}' and lev = '{s}') as {k[0]}{s[0]}" for k in score.WEIGHTS for s in ("high", "medium", "low"))},
    count(*) filter (kind = 'splice') as splices, count(*) filter (kind = 'data') as n_data, count(*) filter (kind = 'data' and lev in ('high', 'medium')) as n_strong,
    count(*) filter (kind = 'data' and lev in ('high', 'medium') and test = 'value_recycling') as n_rec, count(*) filter (kind = 'data' and lev in ('high', 'medium') and test = 'benfords_law') as n_ben,
    count(*) filter (kind = 'reference' and lev in ('high', 'medium')) as n_ref, count(*) filter (kind = 'image' and crosses) as n_cross,
    count(*) filter (kind = 'image' and crosses and severity = 'high' and match_type = 'full_duplicate') as n_full,
    count(*) filter (kind = 'reference' and lev = 'high' and not noise) as fabricated, count(*) filter (kind = 'reference' and lev = 'high' and noise) as filtered,
    bool_or(kind = 'data' and test = 'coefficient_of_variation' and severity = 'high')::int + bool_or(kind = 'data' and test = 'arithmetic_sequence' and severity = 'high')::int + bool_or(kind = 'data' and test = 'geometric_sequence' and severity = 'high')::int
      + bool_or(kind = 'data' and test = 'cross_group_duplicate' and overlap_ratio >= 0.8)::int + bool_or(kind = 'image' and severity = 'high' and crosses)::int
      + bool_or(kind = 'data' and test = 'linear_dependency' and r_squared > 0.99999 and abs(slope - 1) < 0.01 and abs(intercept) < 0.01)::int + bool_or(kind = 'data' and test = 'benfords_law' and p_value < 0.001)::int + (count(*) filter (kind = 'data') > 100)::int as fraud
  from d group by bundle_id
),
im as (select * from f where kind = 'image' and image_a <> image_b and not (page_a > 0 and page_a = page_b)),
deg as (select bundle_id, image, count(*) as degree from (select bundle_id, unnest([image_a, image_b]) as image from im) group by all),
busy as (select bundle_id, image from deg where degree > 4 union select bundle_id, image_a from im where size_a < 2000 union select bundle_id, image_b from im where size_b < 2000),
pairs as (select distinct bundle_id, least(image_a, image_b) as x, greatest(image_a, image_b) as y from im),
calm as (select bundle_id, count(*) as pairs from pairs p where not exists (select 1 from busy b where b.bundle_id = p.bundle_id and b.image in (p.x, p.y)) group by 1),
pg as (select bundle_id, count(distinct case when page_a > 0 and page_b > 0 then least(page_a, page_b)::varchar || '|' || greatest(page_a, page_b)::varchar else least(image_a, image_b) || '|' || greatest(image_a, image_b) end) as page_pairs from im group by 1),
cp as (select pg.bundle_id, case when page_pairs <= 8 and images <= 10 and calm.pairs >= 10 and images / greatest(page_pairs, 1) <= 3 then calm.pairs else 0 end as cross_page
  from pg join (select bundle_id, count(*) as images from deg group by 1) i using (bundle_id) left join calm using (bundle_id)),
p as (select bundle_id, {_REFERENCES.format(b="bundle_id")} as total from (select distinct bundle_id from f union select distinct bundle_id + 1000000 from f where bundle_id % 50 = 0)),
e as (
  select p.bundle_id, total, {", ".join(f"coalesce({k}, 0) as {k}" for k in ("ih", "im", "il", "dh", "dm", "dl", "rh", "rm", "rl", "splices", "n_data", "n_strong", "n_rec", "n_ben", "n_ref", "n_cross", "n_full", "fabricated", "filtered", "fraud", "cross_page"))}
  from p left join a using (bundle_id) left join cp using (bundle_id)
),
{", ".join(f"s{k} as (select *, least(100, least(80, {k}h * 10) + least(25, {k}m * 4) + least(12, round_even({k}l * 0.5, 0)::int) + case when {k}h + {k}m + {k}l > 150 then 20 when {k}h + {k}m + {k}l > 80 then 12 when {k}h + {k}m + {k}l > 30 then 6 else 0 end)::int as {k}0 from {before})" for k, before in (("i", "e"), ("d", "si"), ("r", "sd")))},
g as (select *, case when splices >= 2 then greatest(i0, 56) else i0 end as i, d0 as d, r0 as r, n_data >= 15 and n_strong >= 7 and n_rec >= 3 and n_ben >= 2 and n_ref >= 4 as burden from sr),
h as (select *, greatest(i, d, r) as most, least(100, least(100, round_even(greatest(0.2::double * i + 0.65::double * d + 0.05::double * r + 0.1::double * greatest(i, d, r), 0.95::double * d, 0.85::double * i, 0.85::double * r), 0)::int) + case when fraud >= 4 and (dh > 0 or ih > 0) then 5 else 0 end) as s1 from g),
j as (select *, case when most > 60 and s1 <= 60 then 61 else s1 end as s2 from h),
k as (select *, case when ((n_cross > 0 and n_data >= 5) or cross_page >= 10 or splices >= 2) and s2 < 56 then 56 else s2 end as s3 from j),
l as (
  select *, case when burden and s3 < 61 then 61 else s3 end as score, case when total > 0 then total else rh + rm + rl end as refs,
    case when fabricated + filtered > 0 then filtered / (fabricated + filtered) else 0 end as noise_share from k
),
m as (
  select *, fabricated >= case when noise_share > 0.5 then 10 when noise_share > 0.3 then 8 else 5 end and case when refs > 0 then fabricated / refs else 0 end > 0.08 and case when refs > 0 then fabricated / refs else 0 end < 0.5 as broken,
    n_full between 4 and 30 as fulls, fraud >= 4 and i > 0 and i < 80 as frauds, score >= 60 and d >= 60 as twice, i >= 40 and d >= 10 as pictures from l
),
o as (select *, d > 60 or burden or frauds or twice as in_data, cross_page >= 10 or fulls or pictures or splices >= 2 as in_image, burden or broken as in_reference from m)
select bundle_id, score::int as score, case when in_data or in_image or in_reference then '高风险' else '低风险' end as level,
  array_to_string(list_filter([case when in_data then 'data' end, case when in_image then 'image' end, case when in_reference then 'reference' end], lambda x: x is not null), ',') as high_dimensions, i::int as image_score, d::int as data_score, r::int as reference_score
from o
""")
def score_all_kinds(spark, sf):
    """Score and level of bundles with findings on data, pictures, splices and references, and of some without any."""
    li = table(spark, sf, "lineitem")
    found = li.select(*(F.expr(x).alias(n) for n, x in _FIELDS.items()))
    for n in ("r_squared", "slope", "intercept", "overlap_ratio", "p_value", "title_similarity"):
        found = found.withColumn(n, F.col(n).cast("double"))
    bundles = li.select(F.expr(_BUNDLE).alias("bundle_id")).distinct()
    bundles = bundles.unionByName(bundles.where("bundle_id % 50 = 0").withColumn("bundle_id", F.col("bundle_id") + 1000000)).distinct()
    return score.overall(found, bundles.withColumn("total_references", F.expr(_REFERENCES.format(b="bundle_id")).cast("int")))
