"""Crawled pages: text, links, JSON-LD authors and reference items by regular expressions, without a parser UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S

_LD = "array<struct<`@type`:string,author:array<struct<name:string,affiliation:array<struct<name:string>>>>,headline:string>>"


def texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, S.html_text(F.col(html)).alias("text"))


def titles(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_extract(html, r'(?i)<html[^>]*\blang="([^"]*)"', 1).alias("lang"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, href, label) of each link, in order."""
    pattern = F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>')
    both = F.arrays_zip(F.regexp_extract_all(html, pattern, 1).alias("href"), F.regexp_extract_all(html, pattern, 2).alias("label"))
    return pages.select(key, F.posexplode(both).alias("ord", "l")).select(key, "ord", "l.href", "l.label")


def authors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, name, affiliation) from JSON-LD blocks; pages without any give no row."""
    block = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), 1)
    parsed = pages.select(key, F.explode(block).alias("b")).select(key, F.explode(F.from_json(F.when(F.trim("b").startswith("["), F.col("b")).otherwise(F.concat(F.lit("["), "b", F.lit("]"))), _LD)).alias("j"))
    people = parsed.select(key, F.explode("j.author").alias("a"))
    return people.select(key, F.trim("a.name").alias("name"), F.explode_outer("a.affiliation.name").alias("affiliation"))


def reference_items(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, number, doi, text) of list items that carry a DOI or a counter."""
    item = F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*(?:data-doi|data-counter)[^>]*>.*?</li>"), 0)
    rows = pages.select(key, F.posexplode(item).alias("ord", "item"))
    doi = F.regexp_extract("item", r'data-doi="([^"]*)"', 1)
    number = F.regexp_extract("item", r'data-counter="(\d+)', 1).try_cast("int")
    return rows.select(key, F.coalesce(number, F.col("ord") + 1).alias("number"), F.coalesce(F.nullif(doi, F.lit("")), S.doi(F.col("item"))).alias("doi"), S.html_text(F.col("item")).alias("text"))
