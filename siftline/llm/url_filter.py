"""URL filters: host and path rules, then a blocked Bloom filter before an exact join with the listed URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Query parameters that don't tell pages apart.
TRACKING = "utm_[^=&]*|ref|fbclid|gclid"
#: A block is eight 64-bit words; a URL sets one bit in each.
WORDS, BITS_PER_URL = 8, 16


def host(url: Column | str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return common.lower_az(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column | str) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column | str) -> Column:
    """Host without ``www.`` and default port, path without a final slash, query without tracking; no scheme
    or fragment."""
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_replace(F.concat(F.lit("&"), F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))), f"&({TRACKING})=[^&]*", "")
    query = F.regexp_replace(F.regexp_replace(query, r"^&+", ""), r"^(?=.)", "?")
    return F.concat(name, F.regexp_replace(path(url), r"/+$", ""), query)


def rule_of(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. A rule is (verdict, "host/path")."""
    which = verdict = F.lit(None).cast("string")
    for say, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(slash + rest)
        which, verdict = F.when(fits, F.lit(rule)).otherwise(which), F.when(fits, F.lit(say)).otherwise(verdict)
    return which, verdict


def _with_bits(df: DataFrame, key: str, n_blocks: int) -> DataFrame:
    shift = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h, {6 * k}) & 63 as int))").alias(f"_b{k}") for k in range(WORDS)]
    return df.withColumn("_h", F.xxhash64(F.lit(2), key)).select("*", F.pmod(F.xxhash64(F.lit(1), key), F.lit(n_blocks)).alias("_block"), *shift).drop("_h")


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0 .. w7), a row for each block that holds anything. ``listed`` has distinct ``canonical``."""
    return _with_bits(listed, "canonical", n_blocks).groupBy(F.col("_block").alias("block")).agg(*(F.bit_or(f"_b{k}").alias(f"w{k}") for k in range(WORDS)))


def content_listing(pages: DataFrame, marks: int = 20) -> DataFrame:
    """(url) of the pages whose HTML bears ``marks`` or more runs of three ornaments (``%%%``, ``###``, ``***``,
    ``$$$``): a listing made from content, whatever the address. Null HTML bears none."""
    return pages.where(F.regexp_count("html", F.lit(r"[%#*$]{3}")) >= marks).select("url")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], broadcast_bytes: int = 8 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url), which is read once.

    The longest fitting rule decides; other URLs are blocked if their canonical form is in ``listed`` (url) and
    allowed if not. The filter sends only possible hits to the exact join, which removes false positives. The
    filter and the listing are broadcast while their sizes, known from sums, are at most ``broadcast_bytes``; beyond
    that the joins shuffle on the block and on the URL, and rows that need no look-up are dealt evenly. Null or
    malformed URLs have an empty host and path, fit no rule and are allowed; repeated rows are judged each.
    """
    listed = common.cut(listed.where(F.col("url").contains("://")).select(canonical_url("url").alias("canonical")).distinct())
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("canonical") + 16), F.lit(0))).first()
    n_blocks = max(1, -(-n * BITS_PER_URL // (64 * WORDS)))
    filter_, found = bloom_filter(listed, n_blocks), listed.select(F.col("canonical").alias("listed_url"))
    if n_blocks * (8 * WORDS + 8) <= broadcast_bytes:
        filter_ = F.broadcast(filter_)
    if size <= broadcast_bytes:
        found = F.broadcast(found)
    seen = pages.select("page_id", "url", host("url").alias("host"), path("url").alias("path"))
    which, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("rule", which.cast("string")).withColumn("ruled", verdict)
    asks = F.col("ruled").isNull() & F.col("url").contains("://")
    spread = F.xxhash64("page_id", "url")
    seen = _with_bits(seen.withColumn("asks", asks).withColumn("canonical", F.when(asks, canonical_url("url"))), "canonical", n_blocks)
    seen = seen.withColumn("_block", F.when(F.col("asks"), F.col("_block")).otherwise(F.lit(-1) - F.shiftrightunsigned(spread, 1)))
    may = F.col("w0").isNotNull()
    for k in range(WORDS):
        may = may & ((F.col(f"w{k}").bitwiseAND(F.col(f"_b{k}"))) != 0)
    probed = seen.join(filter_, seen["_block"] == filter_["block"], "left").select("page_id", "host", "path", "rule", "ruled", F.when(may, F.col("canonical")).otherwise(F.concat(F.lit("?"), spread.cast("string"))).alias("looked_up"))
    hits = probed.join(found, probed["looked_up"] == found["listed_url"], "left")
    return hits.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed_url").isNotNull(), "block").otherwise("allow")).alias("verdict"))
