"""The number and text rules as SQL functions of a session, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Digits after the point of a number as it prints, trailing zeros left out; with an exponent, as written out in full.
_DECIMALS = """case when v is null then null
  when contains(cast(v as string), 'E') then cast(greatest(0, length(rtrim('0', regexp_extract(cast(v as string), '[.]([0-9]+)', 1))) - coalesce(try_cast(regexp_extract(cast(v as string), 'E(-?[0-9]+)$', 1) as int), 0)) as int)
  when contains(cast(v as string), '.') then length(rtrim('0', substring_index(cast(v as string), '.', -1))) else 0 end"""

#: name, parameters, result, body
FUNCTIONS = (
    ("sift_decimals", "v double", "int", _DECIMALS),
    ("sift_grim", "mean double, n bigint", "boolean", "exists(array(-1, 0, 1), d -> bround((bround(mean * n, 0) + d) / n, 2) = bround(mean, 2))"),
    ("sift_key", "t string", "string", "regexp_replace(lower(t), '[^a-z0-9]+', '')"),
    ("sift_dimension_score", "high bigint, medium bigint, low bigint", "int", "cast(least(100, least(80, high * 10) + least(25, medium * 4) + least(12, cast(bround(low * 0.5, 0) as int)) + case when high + medium + low > 150 then 20 when high + medium + low > 80 then 12 when high + medium + low > 30 then 6 else 0 end) as int)"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to this session, as temporary ones; Catalyst inlines their bodies."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    return [f[0] for f in FUNCTIONS]
