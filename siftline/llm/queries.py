"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, conversation, exact_dedup, fingerprint, language, mixing, near_dedup, packing, quality, secrets, token_files, toxicity, url_filter
from .common import read

#: Rules of the URL query: (verdict, host and path).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Runs of ornaments from which on the URL query's listing takes a page.
LISTED_MARKS = 20


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts; see exact_dedup.exact_groups for nulls and ties."""
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text; see quality.score_quality."""
    return quality.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of every text and its edited text; see fingerprint.winnowing_report."""
    return fingerprint.winnowing_report(read(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies; see near_dedup.near_groups."""
    return near_dedup.near_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by rules and a listing made from the pages' content; see url_filter.judge_urls."""
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.content_listing(pages, LISTED_MARKS), URL_RULES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text; see toxicity.score_toxicity."""
    return toxicity.toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.5)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 ids; see packing.pack_pieces."""
    return packing.best_fit_packing(read(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text; see secrets.scan_secrets."""
    return secrets.scan_secrets(read(spark, sf_dir, "documents")).drop("kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of every document; see mixing.mix."""
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to token files and read back; see token_files."""
    return token_files.token_file_digest(read(spark, sf_dir, "documents"), end_id=2)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation; see conversation.repaired for nulls and ties."""
    return conversation.conversation_report(read(spark, sf_dir, "conversations"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text; see language.label_languages."""
    return language.language_report(read(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and centroid of every kept vector; see centroids.cluster."""
    return centroids.cluster_report(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces that corpus_pipeline.run makes of the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
with t as (select doc_id, sha256({_LOWER}) as text_sha256 from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""

_OP4 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, list_distinct(list_transform(range(1, 2 + greatest(len(ws) - 5, 0)), lambda i: array_to_string(ws[i:i + 4], ' '))) as sh
  from w where len(ws) > 0
),
g as (select doc_id, len(sh) as n, unnest(sh) as sh from s),
pairs as (
  select a.doc_id as a, b.doc_id as b from g a join g b on a.sh = b.sh and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach(a, b) as (select doc_id, doc_id from w union select r.a, p.b from reach r join pairs p on r.b = p.a),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select w.doc_id, coalesce(len(s.sh), 0)::bigint as n_shingles, component_id, w.doc_id = component_id as kept
from w join c using (doc_id) left join s using (doc_id)
"""

_OP5 = rf"""
with p as (
  select page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
    '&' || coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '') as query
  from pages
),
c as (
  select *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || case when regexp_replace(regexp_replace(query, '&(utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') = '' then ''
       else '?' || regexp_replace(regexp_replace(query, '&(utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') end as canonical
  from p
),
listed as (select distinct canonical from c where len(regexp_extract_all(html, '[%#*$]{{3}}')) >= {LISTED_MARKS} and url like '%://%'),
rules(verdict, rule, name, start) as (values
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
fit as (
  select c.page_id, c.url, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as verdict
  from c join rules r on (c.host = r.name or c.host like '%.' || r.name) and starts_with(c.path, r.start) group by c.page_id, c.url
)
select c.page_id, c.host, c.path, fit.rule, coalesce(fit.verdict, case when listed.canonical is not null then 'block' else 'allow' end) as verdict
from c left join fit on c.page_id is not distinct from fit.page_id and c.url is not distinct from fit.url left join listed on listed.canonical = c.canonical
"""

_OP11 = rf"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations
),
c as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::bigint)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, case when x % 2 = 1 then 3988292384::bigint else 0::bigint end))), 4294967295::bigint) % 20 as kind
  from k
),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from c where kind <> 0
),
n0 as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d),
n as (
  select *, row_number() over (partition by conv_id, role, text order by i) as nth, regexp_extract(text, '(?s)^.*([^\x20\x09-\x0D])', 1) as last_char
  from n0
),
f as (
  select conv_id, i, turn, role, text, case when substr(role, 1, 1) in ('s', 'u', 'a') then substr(role, 1, 1) else '' end as initial,
    substr(lag(role) over (partition by conv_id order by i), 1, 1) || substr(role, 1, 1) as pair,
    case when last_char = '' then 'blank' when nth > 1 then 'duplicate' when last_char not in ('.', '!', '?') then 'truncated' else '' end as fault
  from n
),
ins(q, letters, goal, lines) as (values
  (0, '', 0, ''), (0, 'I', 2, chr(10) || 'user:'), (0, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, '', 1, ''), (1, 'I', 2, chr(10) || 'user:'), (1, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, '', 2, ''), (2, 'I', 3, chr(10) || 'assistant:'), (2, 'II', 2, chr(10) || 'assistant:' || chr(10) || 'user:'),
  (3, '', 3, ''), (3, 'I', 2, chr(10) || 'user:'), (3, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:')),
op(letter, price) as (values ('D', 3), ('R', 2), ('K', 0)),
v as (
  select distinct conv_id, 0::bigint as i, 0 as q, {{'cost': 0, 'audit': '', 'lines': ''}} as best from f
  union all
  select conv_id, i, q, min(best) from (
    select f.conv_id, f.i,
      case when op.letter = 'D' then ins.goal when op.letter = 'R' then (case when ins.goal = 2 then 3 else 2 end) else (case f.initial when 's' then 1 when 'u' then 2 else 3 end) end as q,
      {{'cost': v.best.cost + 2 * length(ins.letters) + op.price + case when f.fault = 'truncated' and op.letter <> 'D' then 1 else 0 end,
        'audit': v.best.audit || ins.letters || op.letter,
        'lines': v.best.lines || ins.lines || case op.letter when 'D' then '' when 'K' then chr(10) || f.role || ':' || f.text else chr(10) || case when ins.goal = 2 then 'assistant' else 'user' end || ':' || f.text end}} as best
    from v join f on f.conv_id is not distinct from v.conv_id and f.i = v.i + 1 join ins on ins.q = v.q cross join op
    where op.letter = 'D' or (f.fault not in ('blank', 'duplicate') and (op.letter = 'R'
      or (f.initial = 's' and ins.goal = 0) or (f.initial = 'u' and ins.goal in (0, 1, 3)) or (f.initial = 'a' and ins.goal = 2)))
  ) group by conv_id, i, q
),
e as (
  select v.conv_id, min({{'cost': v.best.cost + 2 * length(ins.letters), 'audit': v.best.audit || ins.letters, 'lines': v.best.lines || ins.lines}}) as best
  from v join (select conv_id, max(i) as i from f group by conv_id) m on m.conv_id is not distinct from v.conv_id and m.i = v.i
  join ins on ins.q = v.q and (ins.goal = 3 or (ins.goal = 0 and ins.letters = '')) group by v.conv_id
),
g as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal from f group by conv_id
)
select k.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(e.best.cost, 0)::bigint as cost, coalesce(e.best.audit, '') as audit, sha256(substr(coalesce(e.best.lines, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) k left join g on g.conv_id is not distinct from k.conv_id left join e on e.conv_id is not distinct from k.conv_id
"""


def _op13(k: int = 16, rounds: int = 3) -> str:
    assigned = lambda n: f"""
a{n} as (
  select r, vec_id, v, arg_min(c, (d, c)) as c, min(d) as d from (
    select kept.r, kept.vec_id, kept.v, c{n}.c, list_sum(list_transform(list_zip(kept.v, c{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from kept cross join c{n}
  ) group by r, vec_id, v
)"""  # noqa: E731
    moved = lambda n: f"""
c{n + 1} as (
  select c{n}.c, coalesce(m.v, c{n}.v) as v from c{n} left join (
    select c, list(x order by i) as v from (
      select c, i, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::bigint as x
      from (select c, unnest(v) as x, unnest(range(len(v))) as i from a{n}) group by c, i
    ) group by c
  ) m using (c)
)"""  # noqa: E731
    steps = ",".join(assigned(n) + "," + moved(n) for n in range(rounds)) + "," + assigned(rounds)
    return f"""
with kept as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
),
c0 as (select row_number() over (order by sha256('1:' || vec_id) nulls last, v) - 1 as c, v from kept qualify c < {k}),{steps},
s as (select c, sum(d)::bigint as total from a{rounds} group by c)
select a.vec_id, a.c::integer as cluster, a.d as distance, s.total as cluster_inertia, (select sum(total) from s)::bigint as inertia, sha256(array_to_string(z.v, ',')) as centroid_sha256
from a{rounds} a join s using (c) join c{rounds} z using (c)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_exact_dedup, op2_quality, op3_fingerprints, op4_near_dedup, op5_url_filter, op6_toxicity, op7_packing, op8_secrets, op9_mixing, op10_token_files, op11_conversation_repair, op12_language_id, op13_centroid_clusters, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op4_near_dedup": _OP4, "op5_url_filter": _OP5, "op11_conversation_repair": _OP11, "op13_centroid_clusters": _op13()}
