"""Registered queries of the data source of bundles, of tolerant answers, and of feeds with state and late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as J
from ..session import table
from ..sources import bundle_source as BS
from ..streaming import monitor as M
from .queries import _shared, _tasks, query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


@query("select 'lang=' || lang as bundle_id, doc_id, coalesce(source, '') as source, n_chars, sha256(coalesce(text, '')) as digest from documents")
def bundle_cells(spark, sf):
    """Documents written as CSV files, one bundle for each language, and read again by ranges of 256 kB: their texts hold
    line breaks, commas and quotes."""
    root = _folder(spark, "bundles")
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text", "lang")
    docs.write.partitionBy("lang").option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root)
    cells = BS.bundle_cells(spark, root, 256 << 10, "bundle_id string, file string, row_idx int, col_idx int, raw string").where("row_idx > 0")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    cells = cells.withColumn("raw", F.when(F.col("col_idx") == 3, digest(F.col("raw"))).otherwise(F.col("raw")))  # so that texts aren't sorted and shuffled
    one = lambda k: F.max(F.when(F.col("col_idx") == k, F.col("raw")))
    rows = cells.groupBy("bundle_id", "file", "row_idx").agg(one(0).cast("long").alias("doc_id"), F.coalesce(one(1), F.lit("")).alias("source"), one(2).cast("long").alias("n_chars"), F.coalesce(one(3), digest(F.lit(""))).alias("digest"))
    return rows.select("bundle_id", "doc_id", "source", "n_chars", "digest")


#: A review's answer about each event, with the event's own JSON as unescaped text: in a fence, among prose, with quotes in
#: front of commas, with line ends, as valid JSON, cut off, and with a result that isn't one.
_ANSWERS = """case event_id % 8
  when 0 then 'So:' || chr(10) || '```json' || chr(10) || '{' || chr(10) || '  "doi": "10.1/' || event_id || '",' || chr(10) || '  "result": "低风险",' || chr(10) || '  "data_review": "' || event_type || ' has "' || props || '", as told",' || chr(10) || '  "reason": ""' || chr(10) || '}' || chr(10) || '```'
  when 1 then 'It is {"result": "高风险", "trigger": "' || props || '", "verdict": "建议高风险", "reason": "x"} and that is {all}'
  when 2 then '{"result":"高风险","reason":"said "yes", then "' || event_type || '"."}'
  when 3 then '{"result": "低风险", "image_review": "two' || chr(10) || 'lines of "' || value || '"", "verdict": "v"}'
  when 4 then '{"result": "低风险", "reason": "as \\"' || event_type || '\\" says", "ref_review": "{' || value || '}"}'
  when 5 then '```json' || chr(10) || '{"doi": "d", "result": "高风险", "methodology_review": "' || props || ' was cut'
  when 6 then '{"result": "unsure", "reason": "' || props || '"}'
  else 'no answer, ' || event_type end"""
_KEYS = "|".join(J.REVIEW_FIELDS)
_FIELD = rf'"(?:{_KEYS})"\s*:\s*"'


@query(rf"""
with a as (select event_id, {_ANSWERS} as t from events),
b as (select event_id, regexp_extract_all(t, '"({_KEYS})"\s*:\s*"', 1) as names, regexp_split_to_array(t, '{_FIELD}')[2:] as pieces from a),
c as (select event_id, unnest(names) as name, unnest(pieces) as piece, unnest(range(len(names))) = len(names) - 1 as last from b where len(names) > 0),
d as (select event_id, name, case when last then regexp_replace(rtrim(regexp_replace(piece, '(?s)(```\s*|\}} and that is .*)$', '', 'g'), chr(10) || ' '), '\s*\}}$', '') else piece end as piece from c),
e as (select event_id, name, replace(regexp_replace(rtrim(piece, ', ' || chr(10)), '"$', ''), chr(92) || '"', '"') as value from d),
f as (select event_id, map_from_entries(list((name, value))) as m from e group by event_id)
select event_id, {", ".join(f"coalesce(m['{n}'], '') as {n}" for n in J.REVIEW_FIELDS if n not in ("result", "verdict"))}, m['result'] as result,
  coalesce(m['verdict'], case m['result'] when '高风险' then '建议高风险' else '建议低风险' end) as verdict from f where m['result'] in ('高风险', '低风险')
""")
def tolerant_answers(spark, sf):
    """The fields of reviews whose texts hold unescaped quotes and braces: the state goes over quotes here, the SQL looks
    for the names of the fields."""
    found = F.filter(F.array(J.review_fields(F.expr(_ANSWERS))), lambda r: r.isNotNull())  # worked out once a row
    return table(spark, sf, "events").repartition(_tasks(spark)).select("event_id", F.inline(found))


@query("""
with recursive w as (select epoch_ms(max(ts)) - 3600000 as w from events),
e as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by epoch_us(ts), event_id) as i from events, w where epoch_us(ts) // 1000 <= w.w),
f(user_id, i, event_id, action, us, held, attempts) as (
  select user_id, i, event_id, 'claim', us, us, 1 from e where i = 1
  union all
  select user_id, i, event_id, case when fresh then 'claim' when us - held <= 21600000000 then 'busy' when attempts >= 2 then 'give up' else 'retry' end, us,
    case when fresh or (us - held > 21600000000 and attempts < 2) then us else held end, case when fresh then 1 when us - held > 21600000000 and attempts < 2 then attempts + 1 else attempts end
  from (select e.user_id, e.i, e.event_id, e.us, f.held, f.attempts, e.us - f.held > 21600000000 + 259200000000 as fresh from f join e on e.user_id = f.user_id and e.i = f.i + 1)
)
select user_id, event_id, action, us from f
union all select user_id, event_id, 'stale', us + 21600000000 from f, w where action in ('claim', 'retry') and (us + 21600000000) // 1000 + 1 <= w.w
""")
def stream_claim_timers(spark, sf):
    """Claims that go stale by a timer of the stream's state, for all events that the watermark has passed."""
    base = _folder(spark, "claim-timers")
    out = M.claims_with_timers(M.event_stream(M.with_state_store(spark), f"{sf}/events*.parquet", table(spark, sf, "events").schema))
    M.run_available(out, f"{base}/out", f"{base}/state")
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def _stages(spark, sf, late: bool) -> list[DataFrame]:
    """Events in four stages by their number; with ``late``, one in eleven arrives a stage after its neighbours."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    most = e.agg(F.max("event_id")).first()[0] or 0
    stage = F.floor(F.col("event_id") * 4 / (most + 1)).cast("int")
    stage = F.least(stage + (F.col("event_id") % 11 == 3).cast("int"), F.lit(3)) if late else stage
    staged = e.withColumn("stage", stage)
    return [staged.where(F.col("stage") == k).drop("stage") for k in range(4)]


_STAGED = """
s as (select *, least(event_id * 4 // (select max(event_id) + 1 from events) + case when event_id % 11 = 3 then 1 else 0 end, 3)::int as stage, date_trunc('day', ts) as start from events),
k as (select unnest(range(4))::int as stage),
w as (select k.stage, coalesce(max(epoch_ms(s.ts)) - 86400000, 0) as mark from k left join s on s.stage < k.stage group by 1),
last as (select max(epoch_ms(ts)) - 86400000 as mark from s),
j as (select s.*, epoch_ms(start) + 86400000 <= w.mark as dropped from s join w using (stage))
"""


@query(f"""
with {_STAGED}
select 'window' as kind, -1 as stage, start, event_type, count(*) as n from j, last where not dropped and epoch_ms(start) + 86400000 <= last.mark group by all
union all select 'late', stage, start, event_type, count(*) from j where dropped group by all
""")
def stream_late_windows(spark, sf):
    """Daily counts of a feed that arrives in four stages with late rows: the windows that the stream has closed, and
    the rows that came after their window was closed, by stage."""
    base, stages = _folder(spark, "late"), _stages(spark, sf, late=True)
    counts = lambda e: M.tumbling(e, late="1 day").drop("total")
    marks = M.run_staged(M.with_state_store(spark), stages, counts, base)
    closed = spark.read.schema("start timestamp, event_type string, n long").parquet(f"{base}/out").select(F.lit("window").alias("kind"), F.lit(-1).alias("stage"), "start", "event_type", "n")
    return closed.unionByName(M.late_rows(stages, marks, "1 day").withColumn("kind", F.lit("late")))


@query("""
with g as (select user_id, ts, coalesce(ts - lag(ts) over w >= interval '6 hours', true) as opens from events window w as (partition by user_id order by ts)),
s as (select *, sum(opens::int) over (partition by user_id order by ts) as k from g),
z as (select user_id, min(ts) as start, max(ts) + interval '6 hours' as "end", count(*) as n from s group by user_id, k)
select user_id, start, "end", n from z where epoch_ms("end") <= (select max(epoch_ms(ts)) - 3600000 from events)
""")
def stream_sessions(spark, sf):
    """Sessions of users on a feed of four stages: those that no later row can prolong."""
    base = _folder(spark, "sessions")
    M.run_staged(M.with_state_store(spark), _stages(spark, sf, late=False), M.sessions, base)
    return spark.read.schema("user_id long, start timestamp, end timestamp, n long").parquet(f"{base}/out")


_RUNNING = """
w as (select user_id % 4 as feed, date_trunc('day', ts) as start, count(*) as n, count(*) filter (event_type = 'error') as bad from events group by all),
r as (select *, sum(n) over u::bigint as run_n, sum(bad) over u::bigint as run_bad from w window u as (partition by feed order by start)),
o as (select *, run_n >= 50 and run_bad > 0.18 * run_n as over from r)
select feed, start, n, bad, run_n, run_bad, over, over and sum(over::int) over (partition by feed order by start) = 1 as first from o
"""


@query(f"with {_RUNNING}")
def running_rate(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return M.running_rate(e, F.col("user_id") % 4, F.col("event_type") == "error", most=0.18)


@query(f"select * from (with {_RUNNING}) where epoch_ms(start) + 86400000 <= (select max(epoch_ms(ts)) - 3600000 from events)")
def stream_running_rate(spark, sf):
    """The running rate of four feeds, kept over the stages of a stream, for the windows that it has closed."""
    base = _folder(spark, "rate")
    rate = lambda e: M.running_rate(e, F.col("user_id") % 4, F.col("event_type") == "error", most=0.18)
    M.run_staged(M.with_state_store(spark), _stages(spark, sf, late=False), rate, base)
    return spark.read.schema(M._RATE).parquet(f"{base}/out")
