"""Registered queries of rules that need more than one row or one formula: tail probabilities, look-ups that stop, citations
of several lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions import tails as T
from ..operators import references as X
from ..operators import structure as A
from ..operators import upkeep as U
from ..session import table
from . import score
from .queries import _SQL, _tasks, _written, query

#: The lower regularised beta function as its series, and the upper gamma function as the sum of its lower series.
_BETA = "exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b})) * list_sum(list_transform(range(0, 12000), lambda k: exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) - lgamma({a} + 1 + k) + lgamma({a} + 1) + k * ln({x}))))"
_GAMMA = "list_sum(list_transform(range(0, 400), lambda k: exp(k * ln({x}) + {a} * ln({x}) - {x} - lgamma({a} + k + 1))))"


def _lower_beta(a: str, b: str, x: str) -> str:
    near, far = _BETA.format(a=a, b=b, x=x), _BETA.format(a=b, b=a, x=f"(1 - {x})")
    return f"case when {x} <= 0 then 0.0 when {x} >= 1 then 1.0 when {x} > ({a} + 1) / ({a} + {b} + 2) then 1 - {far} else {near} end"


@query(f"""
with s as (
  select l_suppkey, count(*)::double as n, (avg(l_quantity) - 25.5) / (stddev_samp(l_quantity) / sqrt(count(*))) as t, corr(l_quantity, l_extendedprice) as r,
    var_samp(l_quantity) filter (l_returnflag = 'N') / var_samp(l_quantity) filter (l_returnflag <> 'N') as f,
    count(*) filter (l_returnflag = 'N') - 1.0::double as d1, count(*) filter (l_returnflag <> 'N') - 1.0::double as d2 from lineitem group by 1
),
q as (
  select l_suppkey, ln(digit + 1) as _, digit, count(*) as n from (select l_suppkey, (floor(l_extendedprice)::bigint % 7) as digit from lineitem) group by all
),
c as (select l_suppkey, sum((n - m) * (n - m) / m) as chi2 from (select *, sum(n) over (partition by l_suppkey) / 7.0::double as m from q) group by 1 having count(*) = 7),
v as (
  select l_suppkey, 't' as kind, abs(t) as x, n - 1 as df1, null::double as df2 from s union all select l_suppkey, 'r', abs(r), n - 2, null from s
  union all select l_suppkey, 'F', f, d1, d2 from s where d1 > 0 and d2 > 0 union all select l_suppkey, 'chi2', chi2, 6.0, null from c
),
b as (
  select l_suppkey, kind, case kind when 'F' then df2 / 2 when 'chi2' then df1 / 2 else df1 / 2 end as a, case kind when 'F' then df1 / 2 else 0.5::double end as b,
    case kind when 't' then df1 / (df1 + x * x) when 'r' then 1 - x * x when 'F' then df2 / (df2 + df1 * x) else x / 2 end as x from v
)
select l_suppkey, kind, round_even(least(case when kind = 'chi2' then 1 - {_GAMMA.format(a="a", x="x")} else {_lower_beta("a", "b", "x")} end, 1), 6) as p from b
""")
def recomputed_p(spark, sf):
    """p of four statistics of each supplier: t of the mean quantity, r of quantity and price, F of two variances, and
    chi-square of remainders."""
    li = table(spark, sf, "lineitem")
    n, new = F.count("*").cast("double"), F.col("l_returnflag") == "N"
    s = li.groupBy("l_suppkey").agg(
        n.alias("n"), ((F.avg("l_quantity") - 25.5) / (F.stddev_samp("l_quantity") / F.sqrt(n))).alias("t"), F.corr("l_quantity", "l_extendedprice").alias("r"),
        (F.var_samp(F.when(new, F.col("l_quantity"))) / F.var_samp(F.when(~new, F.col("l_quantity")))).alias("f"), (F.count_if(new) - 1.0).alias("d1"), (F.count_if(~new) - 1.0).alias("d2"),
    )
    q = li.groupBy("l_suppkey", (F.floor("l_extendedprice") % 7).alias("digit")).count().groupBy("l_suppkey").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("squares"), F.count("*").alias("kinds"))
    chi2 = q.where("kinds = 7").select("l_suppkey", F.lit("chi2").alias("kind"), (7.0 * F.col("squares") / F.col("n") - F.col("n")).alias("x"), F.lit(6.0).alias("df1"), F.lit(None).cast("double").alias("df2"))
    none = F.lit(None).cast("double")
    of_s = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), x.alias("x"), a.alias("df1"), b.alias("df2")) for k, x, a, b in (("t", F.col("t"), F.col("n") - 1, none), ("r", F.col("r"), F.col("n") - 2, none), ("F", F.col("f"), F.col("d1"), F.col("d2"))))))
    v = s.select("l_suppkey", of_s.alias("v")).select("l_suppkey", "v.*").where("kind <> 'F' or (df1 > 0 and df2 > 0)").unionByName(chi2)
    return v.select("l_suppkey", "kind", F.bround(T.recomputed_p(F.col("kind"), F.col("x"), F.col("df1"), F.col("df2")), 6).alias("p"))


@query("""
with r as (
  select user_id % 20 as page, event_id as number, case when event_id % 9 = 0 then '' else event_type end as text, case when event_id % 5 > 0 then '10.1/' || event_id end as doi, event_type not in ('purchase', 'signup') as failed,
    value >= 15 as valid, event_id % 100 / 100.0 as similarity, value > 12 as matched, value * 2 as score from events
),
d as (select page, number, row_number() over w as i, failed, row_number() over w - row_number() over (partition by page, failed order by number) as island from r where doi is not null window w as (partition by page order by number)),
t as (select page, number, count(*) over (partition by page, failed, island order by number) as streak, failed from d),
z as (select page, min(number) as stop from t where failed and streak >= 10 group by page),
a as (select r.*, coalesce(number >= z.stop, false) as over from r left join z using (page)),
i as (
  select page, number, over, doi, text, case when over then null
    when doi is not null and valid and not failed then case when text <> '' and similarity < 0.85 then 'title_mismatch' end
    when doi is not null then 'doi_not_found' when text <> '' and not matched then 'not_found' when text <> '' and score < 50 then 'low_match_score' end as issue from a
)
select page, number, issue, case issue when 'doi_not_found' then 'high' when 'title_mismatch' then 'medium' when 'not_found' then 'medium' when 'low_match_score' then 'low' end as severity,
  case when over then 'unverified' when doi is not null or text <> '' then 'checked' else 'skipped' end as status from i
""")
def crawled_issues(spark, sf):
    """References of crawled pages, looked up in order until ten DOIs in a row get no answer: events stand for them."""
    e = table(spark, sf, "events")
    refs = e.select(
        (F.col("user_id") % 20).alias("page"), F.col("event_id").alias("number"), F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("event_type")).alias("text"),
        F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("10.1/"), "event_id")).alias("doi"), (~F.col("event_type").isin("purchase", "signup")).alias("lookup_failed"),
        (F.col("value") >= 15).alias("doi_valid"), (F.col("event_id") % 100 / 100.0).alias("title_similarity"), (F.col("value") > 12).alias("matched"), (F.col("value") * 2).alias("match_score"),
    )
    return X.crawled_issues(refs, ["page"], "number").select("page", "number", "issue", "severity", "status")


#: Sentences of documents as lines; some begin or end as citations do, by their place.
_LINE = """case place % 7 when 0 then 'Smith, A. ' || line when 2 then line || ' (2010). Sea 12, 34-56.' when 3 then 'van Dyke ' || line when 4 then line || ' doi:' when 5 then '10.1234/x ' || line when 6 then line || ' (1999) 7' else line end"""
_LINES = rf"""
r as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\.[ \t\n\x0B\f\r]+', '.' || chr(1), 'g'), '[\x01\n]'), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') as ls from documents where text is not null),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as place from r),
m as (select doc_id, place, place + 1 as i, trim({_LINE}) as line from l),
n as (select *, regexp_matches(line, '^[A-Z][A-Za-z''`-]+,?\s+[A-Z]|^(?:van|von|de|del|della|di|da|le|la)\s+[A-Z]') as starts, regexp_matches(line, '\(\d{{4}}\)') as has_year from m),
g(doc_id, i, number, b2, b1, has_doi, has_year) as (
  select doc_id, i, 1, '', line, regexp_matches(line, '(?i)(?:doi[:\s]|https?://doi\.org/)\s*10\.\d{{4,}}/'), has_year from n where i = 1
  union all
  select doc_id, i, number + case when ends then 1 else 0 end, case when ends then '' else b1 end, line,
    case when ends then regexp_matches(line, '(?i)(?:doi[:\s]|https?://doi\.org/)\s*10\.\d{{4,}}/') else had_doi or regexp_matches(b1 || ' ' || line, '(?i)(?:doi[:\s]|https?://doi\.org/)\s*10\.\d{{4,}}/') end, has_year or (had_year and not ends)
  from (select n.*, g.number, g.b1, g.has_doi as had_doi, g.has_year as had_year, n.starts and (g.has_doi or (g.has_year and regexp_matches(g.b2 || ' ' || g.b1, '\d+\s*[-–]\s*\d+\.?\s*$'))) as ends from g join n on n.doc_id = g.doc_id and n.i = g.i + 1)
)
"""


def citation_lines(spark, sf):
    """(doc_id, place, line) of every document."""
    text = F.transform(F.split("text", r"(?<=\.)\s+|\n"), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")))
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.filter(text, lambda x: x != "")).alias("place", "line"))
    return lines.select("doc_id", "place", F.trim(F.expr(_LINE)).alias("line"))


@query(f"""
with recursive {_LINES}
select doc_id, number::int as number, count(*)::int as lines, sha256(string_agg(line, ' ' order by i)) as digest from g join n using (doc_id, i) group by doc_id, number
""")
def citation_rows(spark, sf):
    """The citations of author-first lists, in batches over the sentences of every document in order."""
    return X.citations(spark, citation_lines(spark, sf)).select("doc_id", "number", "lines", F.sha2("text", 256).alias("digest"))


_SQL["citation_groups"] = f"with recursive {_LINES} select doc_id, count(*)::int as n_lines, max(number)::int as n_groups from g group by doc_id"


#: Pieces of documents of up to 39 characters, as they are, without blanks, and blanks alone.
_PIECES = "case doc_id % 4 when 0 then left(text, cast(doc_id % 40 as int)) when 1 then left(replace(text, ' ', ''), cast(doc_id % 40 as int)) when 2 then repeat(' ', cast(doc_id % 40 as int)) else left(text, cast(20 + doc_id % 20 as int)) || repeat('x', cast(doc_id % 30 as int)) end"


@query(rf"""
with p as (select doc_id, {_PIECES} as t from documents where text is not null),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from p)
select doc_id, case when length(t) < 20 then false when len(w) = 0 then true else
  list_sum(list_transform(w, lambda x: length(x))) / len(w) > 20 or (length(t) - length(replace(t, ' ', ''))) / length(t) < 0.04 or len(list_filter(w, lambda x: length(x) > 15)) / len(w) > 0.5 end as garbled from w
""")
def garbled_pieces(spark, sf):
    """Short pieces of texts, blanks and words run together."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", S.is_garbled(F.expr(_PIECES)).alias("garbled"))


#: What a page leaves in its text, within lines and as lines, by the number of the document.
_INSERTS = (
    "Nature Reviews | Volume 12 | January 2020", "Your privacy, your choice", "We and our 200 partners store what we like on this device. ", "and transfers to third parties of all kinds. ", "some third parties are outside of the area. ",
    "with varying standards of data protection there. ", "advertising, personalisation of content and more. ", "usage analysis, and social media. ", "Article https://doi.org/10.1/own(2) ", "https://doi.org/10.1/other", "see our privacy policy. ", "Publisher’s note",
)
_INSERT = "case doc_id % 24 " + " ".join(f"when {k} then '{x}'" for k, x in enumerate(_INSERTS)) + " when 12 then chr(10) || 'x | Volume 3 | y' || chr(10) when 13 then chr(10) || 'https://doi.org/10.1/line  ' || chr(10) else '' end"
_SOILED = f"left(text, cast(300 + doc_id % 50 as int)) || {_INSERT} || substr(text, cast(301 + doc_id % 50 as int))"
_SQL_FRAGMENTS = "t"
for _fragment in S.FRAGMENTS:
    _SQL_FRAGMENTS = f"regexp_replace({_SQL_FRAGMENTS}, '(?i){_fragment}', ' ', 'g')"


@query(rf"""
with s as (select doc_id, {_SOILED} as t from documents where text is not null),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: not regexp_matches(x, '(?i){"|".join(S.PAGE_LINES)}')) as kept from s),
o as (select doc_id, regexp_replace(array_to_string(kept, chr(10)), '(?i)\bArticle\s+https?://doi\.org/10\.1/own\(2\)', ' ', 'g') as t from l),
c as (select doc_id, {_SQL_FRAGMENTS} as t from o)
select doc_id, length(t)::int as n, sha256(t) as digest from c
""")
def page_text(spark, sf):
    """Documents into which running heads, feet and notices were put, without them again."""
    clean = S.without_running_text(F.expr(_SOILED), F.lit("10.1/own(2)"))
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "text").repartition(_tasks(spark))
    found = docs.select("doc_id", F.explode(F.array(clean)).alias("t"))  # worked out once a row
    return found.select("doc_id", F.length("t").alias("n"), F.sha2(F.col("t").cast("binary"), 256).alias("digest"))


@query("""
select l_orderkey, l_linenumber, l_partkey, regexp_replace(lower(l_returnflag || l_linestatus), '[^a-z0-9]+', '', 'g') as key, length(rtrim(split_part(l_extendedprice::varchar, '.', 2), '0'))::int as decimals,
  case when l_linenumber % 2 = 0 then 5 else 7 end as small_decimals from lineitem
""")
def sql_text_functions(spark, sf):
    """The other rules called from SQL: keys of texts, and decimals of numbers that print with an exponent too."""
    from ..functions import sql

    sql.register(spark)
    li = table(spark, sf, "lineitem")
    return li.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "sift_key(l_returnflag || l_linestatus) as key", "sift_decimals(l_extendedprice) as decimals", "sift_decimals(case when l_linenumber % 2 = 0 then 0.00001d * (l_linenumber - l_linenumber + 1) else 0.0000012d end) as small_decimals")


#: Lines of structure files: records by columns and by blanks, records that are neither, and models, by the line's number.
_PLACE = "l_orderkey * 10 + l_linenumber"
_RECORD = """case when l_linenumber = 1 and l_orderkey % 40 = 0 then case when l_orderkey % 80 = 0 then 'MODEL     ' || cast(l_orderkey % 7 as varchar(9)) else 'MODEL' end
  when l_linenumber % 7 = 5 then 'HETATM ' || cast(l_orderkey as varchar(9)) || ' CA ALA A ' || cast(l_partkey as varchar(9)) || ' ' || cast(cast(l_quantity as int) as varchar(9)) || '.5 0.0 1e1 ' || cast(cast(l_linenumber as int) % 3 as varchar(9)) || ' -2'
  when l_linenumber % 7 = 6 then 'ATOM   ' || cast(l_orderkey as varchar(9)) || ' CA ALA'
  else 'ATOM  ' || lpad(cast(l_orderkey % 100000 as varchar(9)), 5, ' ') || '  CA ' || ' ALA A' || lpad(cast(l_partkey % 10000 as varchar(9)), 4, ' ') || '    ' || lpad(cast(cast(l_quantity as int) % 9 as varchar(9)) || '.000', 8, ' ') || '   0.000' || lpad(cast(cast(l_quantity as int) % 3 as varchar(9)) || '.000', 8, ' ')
    || case when l_linenumber % 7 = 3 then '            ' else lpad(cast(cast(l_linenumber as int) % 3 as varchar(9)) || '.00', 6, ' ') || lpad(cast(cast(l_quantity as int) - 2 as varchar(9)) || '.00', 6, ' ') end end"""


@query(f"""
with l as (select l_suppkey as file, l_linenumber % 7 as kind, row_number() over (partition by l_suppkey order by {_PLACE}, l_partkey, l_extendedprice, l_quantity) as place, l_orderkey, l_partkey, l_linenumber, l_quantity::int as q, {_RECORD} as t from lineitem),
m as (select *, coalesce(last_value(case when t = 'MODEL' then place::varchar when starts_with(t, 'MODEL') then (l_orderkey % 7)::varchar end ignore nulls) over (partition by file order by place), '1') as model from l),
a as (
  select file, model, kind = 6 as malformed, case when kind = 5 then l_orderkey::varchar else (l_orderkey % 100000)::varchar end as serial,
    case when kind = 5 then 'H' || l_partkey else 'A' || l_partkey % 10000 end as ident, case when kind = 5 then q + 0.5 else q % 9 end as x, case when kind = 5 then 10 else q % 3 end as z,
    case when kind <> 3 then l_linenumber % 3 end as occ, case when kind = 5 then -2 when kind <> 3 then q - 2 end as b from m where not starts_with(t, 'MODEL')
),
k as (select * from a where not malformed),
i as (select file, sum(n)::bigint as records, count(*) as g from (select file, count(*) as n from k group by file, model, ident having count(*) > 1) group by 1),
s as (select file, sum(n)::bigint as records, count(*) as g from (select file, count(*) as n from k group by file, model, serial having count(*) > 1) group by 1),
c as (select file, sum(n)::bigint as records, count(*) as g from (select file, count(*) as n from k group by file, model, x, z having count(*) > 1 and count(distinct ident) >= 2) group by 1),
r as (select file, count(*) as n, count(*) filter (occ < 0 or occ > 1) as o, count(*) filter (b < 0) as b, count(*) filter (x = 0 and z = 0) as zero from k group by 1),
w as (select file, count(*) filter (malformed) as bad, count(*) as n from a group by 1)
select file, 'pdb_malformed_atom_records' as test, bad as records, case when bad >= 5 or bad / n >= 0.05 then 'medium' else 'low' end as severity from w where bad > 0
union all select file, 'pdb_duplicate_atom_identity', records, case when records >= 10 or g >= 5 then 'high' else 'medium' end from i
union all select file, 'pdb_duplicate_atom_serial', records, case when records >= 10 then 'medium' else 'low' end from s
union all select file, 'pdb_duplicate_coordinates', records, case when records >= 20 or g >= 10 then 'high' else 'medium' end from c
union all select file, 'pdb_invalid_occupancy', o, case when o >= 20 then 'high' else 'medium' end from r where o > 0
union all select file, 'pdb_negative_bfactor', b, case when b >= 10 then 'medium' else 'low' end from r where b > 0
union all select file, 'pdb_zero_coordinates', zero, case when zero >= 10 or zero / n >= 0.01 then 'high' else 'medium' end from r where zero >= 3
""")
def structure_files(spark, sf):
    """Findings on structure files whose records stand in columns or between blanks, in several models, some of them broken:
    each supplier's lines as one file."""
    order = Window.partitionBy("file").orderBy(F.expr(_PLACE), "l_partkey", "l_extendedprice", "l_quantity")
    lines = table(spark, sf, "lineitem").withColumn("file", F.col("l_suppkey")).repartition(_tasks(spark), "file").withColumn("place", F.row_number().over(order)).select("file", "place", F.expr(_RECORD).alias("value"))
    atoms = _written(A.atoms(A.with_models(lines, "file", "place")).drop("place", "value"), "atoms")  # five aggregates read it
    found = A.duplicate_findings(atoms, "file").unionByName(A.range_findings(atoms, "file"), allowMissingColumns=True)
    return found.unionByName(A.malformed_findings(atoms, "file"), allowMissingColumns=True).select("file", "test", "records", "severity")


@query("""
with m as (select 'old/' || o_custkey as src, 'new/' || o_orderkey as dst, 'u/' || o_custkey % 400 as old_url from orders where o_orderkey % 3 = 0),
f as (
  select 'old/' || c_custkey as path, floor(abs(c_acctbal))::bigint as size, c_mktsegment as digest from customer where c_custkey % 7 > 0
  union all select 'new/' || o_orderkey, case when o_orderkey % 39 = 0 then 1 else floor(abs(c_acctbal))::bigint end, case when o_orderkey % 33 = 0 then 'other' else c_mktsegment end from orders join customer on o_custkey = c_custkey where o_orderkey % 21 > 0
),
u as (select distinct 'u/' || c_custkey as url from customer where c_nationkey = 3),
j as (select m.src, m.dst, s.size, s.path is not null as there, d.path is not null as copied, d.size = s.size and d.digest = s.digest as same, u.url is not null as used from m left join f s on s.path = m.src left join f d on d.path = m.dst left join u on u.url = m.old_url),
w as (
  select src, null as why from j union select src, 'source_missing' from j where not there union select src, 'old_url_still_referenced' from j where used
  union select src, 'dest_missing:' || dst from j where not copied union select src, 'dest_differs:' || dst from j where copied and there and not same
)
select w.src, coalesce(max(j.size), 0)::bigint as size, count(w.why) = 0 as deletable, coalesce(string_agg(distinct w.why, ',' order by w.why), '') as reasons from w join (select distinct src, size from j) j using (src) group by w.src
""")
def cleanup_plan(spark, sf):
    """Which migrated files may be removed: orders stand for copies of their customers' files."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    text = lambda start, k: F.concat(F.lit(start), k.cast("string"))
    manifest = o.where("o_orderkey % 3 = 0").select(text("old/", F.col("o_custkey")).alias("src"), text("new/", F.col("o_orderkey")).alias("dst"), text("u/", F.col("o_custkey") % 400).alias("old_url"))
    size = F.floor(F.abs("c_acctbal")).cast("long")
    copies = o.where("o_orderkey % 21 > 0").join(c, F.col("o_custkey") == F.col("c_custkey"))
    files = c.where("c_custkey % 7 > 0").select(text("old/", F.col("c_custkey")).alias("path"), size.alias("size"), F.col("c_mktsegment").alias("digest"))
    files = files.unionByName(copies.select(text("new/", F.col("o_orderkey")).alias("path"), F.when(F.col("o_orderkey") % 39 == 0, 1).otherwise(size).alias("size"), F.when(F.col("o_orderkey") % 33 == 0, "other").otherwise(F.col("c_mktsegment")).alias("digest")))
    used = c.where("c_nationkey = 3").select(text("u/", F.col("c_custkey")).alias("url"), F.lit(1).alias("n"))
    return U.cleanup_plan(manifest, files, used).withColumn("reasons", F.array_join("reasons", ","))


@query("""
with m as (select case when o_orderstatus = 'F' then 'report' else 'review' end as kind, 'p/' || o_custkey as src, 'q/' || o_orderkey as dst from orders),
f as (select 'p/' || c_custkey as path from customer where c_custkey % 4 > 0 union select 'q/' || l_orderkey from lineitem where l_linenumber = 5)
select kind, count(*) as planned, count(*) filter (src in (select path from f)) as src_exists, count(*) filter (src not in (select path from f) and dst not in (select path from f)) as missing_src, count(*) filter (dst in (select path from f)) as dst_exists from m group by 1
""")
def migration_summary(spark, sf):
    """What a migration would find: planned, with source, with neither, and there already."""
    o = table(spark, sf, "orders")
    text = lambda start, c: F.concat(F.lit(start), F.col(c).cast("string"))
    plan = o.select(F.when(F.col("o_orderstatus") == "F", "report").otherwise("review").alias("kind"), text("p/", "o_custkey").alias("src"), text("q/", "o_orderkey").alias("dst"))
    files = table(spark, sf, "customer").where("c_custkey % 4 > 0").select(text("p/", "c_custkey").alias("path")).unionByName(table(spark, sf, "lineitem").where("l_linenumber = 5").select(text("q/", "l_orderkey").alias("path")))
    return U.manifest_summary(U.migration_manifest(plan, files))


@query("""
with a as (select event_type, user_id % 9 as part, arg_min(event_id, ts) as f, arg_max(event_id, ts) as l, floor(epoch(max(ts)))::bigint - floor(epoch(min(ts)))::bigint as s from events group by all),
b as (select *, greatest(0, l - f) as since, case when part > 0 then part * 3000 end as target, greatest(0, l - f) / greatest(1, s) * 3600.0::double as per_hour from a)
select event_type, part, since, round_even(per_hour, 2) as per_hour, case when target > 0 then greatest(0, target - l) end as remaining, round_even(case when per_hour > 0 and target > 0 then greatest(0, target - l) / per_hour end, 2) as hours_left from b
""")
def rate_remaining(spark, sf):
    """Speed and time left of feeds of events, some without a target."""
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 9).alias("part"), "ts", "event_id")
    return U.remaining_time(e, ["event_type", "part"], "ts", "event_id", F.when(F.col("part") > 0, F.col("part") * 3000))


@query("""
with k as (select o_orderkey, o_custkey, o_orderdate from orders where o_orderstatus = 'O')
select o_orderkey, o_custkey, (select count(*) from k) as total from k order by o_orderdate desc, o_orderkey limit 20 offset 40
""")
def task_page(spark, sf):
    """The third page of open orders, newest first, and how many there are."""
    return U.page(table(spark, sf, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 40, 20, F.col("o_orderstatus") == "O").select("o_orderkey", "o_custkey", "total")


@query("""
with l as (select doc_id, case when doc_id % 2 = 0 then 'retracted' else 'user_labeled' end as source, doc_id % 2 = 0 or quality = 1 as expected, toxic = 1 or doc_id % 5 > 0 as found, doc_id % 7 > 0 as there from labels)
select 'retracted recall' as name, 100.0::double * count(*) filter (there and found) / count(*) as percent, 100 * count(*) filter (there and found) / count(*) > 70 as met from l where source = 'retracted'
union all select 'user agreement', 100.0::double * count(*) filter (expected = (there and found)) / count(*), count(*) filter (expected = (there and found)) = count(*) from l where source = 'user_labeled'
union all select 'high rate', 100.0::double * count(*) filter (doc_id % 6 = 0) / count(*), 100 * count(*) filter (doc_id % 6 = 0) / count(*) between 15 and 20 from documents
""")
def constraint_check(spark, sf):
    """Recall, agreement and the share of high levels against what a release has to meet."""
    labels = table(spark, sf, "labels")
    known = labels.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "retracted").otherwise("user_labeled").alias("label_source"), ((F.col("doc_id") % 2 == 0) | (F.col("quality") == 1)).alias("expected"))
    found = labels.where("doc_id % 7 > 0").select("doc_id", ((F.col("toxic") == 1) | (F.col("doc_id") % 5 > 0)).alias("found"))
    return score.constraints(known, found, "doc_id", table(spark, sf, "documents").select((F.col("doc_id") % 6 == 0).alias("is_high"))).withColumn("percent", F.col("percent").cast("double"))
