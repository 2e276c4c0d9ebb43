"""Document fingerprints by winnowing, with DataFrame functions only.

Every k-gram of a text's UTF-8 bytes has a rolling hash (a cyclic polynomial with a stride of ``UNIT`` bytes): as the
gram moves on by a unit its hash is turned, the unit that leaves is taken out and the one that comes is put in. Of
each window of ``WINDOW`` grams the smallest hash is kept, the rightmost on ties, with its position. Texts that share
``K + WINDOW - 1`` bytes share a fingerprint.

A text is cut into blocks of ``BLOCK`` positions. A block hashes the unit at each of its positions once, and those that
its windows reach into the next block, as columns; a unit enters the ``K / UNIT`` grams that hold it. Window minima are
found by widening: the minimum of 4n grams is that of four neighbours of n. So the work is done by compiled
projections, whatever the text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Blocks have more than 100 columns at each step, so that Spark compiles each projection in parts, not as one method.
K, UNIT, WINDOW, BLOCK = 12, 4, 32, 128
#: Bytes that a block's windows reach over.
REACH = BLOCK + WINDOW + K - 2
#: Each step takes the least of so many neighbours; together they make a window.
STEPS = (4, 4, 2)
_LOW = 255  # low bits of a hash that hold 255 minus the place in the block, so that ties go right
#: Parts of the range of an id that has many rows.
PIECES = 64


def _turned(name: str, bits: int) -> str:
    return f"(shiftleft({name}, {bits}) | shiftrightunsigned({name}, {64 - bits}))" if bits else name


def _block_minima(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """For blocks (bytes, block, n_grams) the packed (position, hash) of the minima of windows that start in them."""
    span, parts = BLOCK + WINDOW - 1, K // UNIT
    # grams and windows in this block, counted from its start; a text with fewer grams than a window has one window
    grams, windows = F.col("n_grams") - F.col("block") * BLOCK, F.greatest(F.col("n_grams") - (WINDOW - 1), F.least("n_grams", F.lit(1))) - F.col("block") * BLOCK
    kept = [*keep, "block", "grams", "windows"]
    units = blocks.select(*keep, "block", grams.alias("grams"), windows.alias("windows"), *(F.expr(f"xxhash64(substring(bytes, {j + 1}, {UNIT}))").alias(f"u{j}") for j in range(span + K - UNIT)))
    gram = lambda j: " ^ ".join(_turned(f"u{j + UNIT * k}", parts - 1 - k) for k in range(parts))
    # past the end stands the largest number, not null: minima of columns that can't be null cost far less
    step = units.select(*kept, *(F.expr(f"if({j} < grams, (({gram(j)}) | {_LOW}L) ^ {j}L, {2**63 - 1}L)").alias(f"m{j}") for j in range(span)))
    size = 1
    for many in STEPS:
        span -= (many - 1) * size
        step = step.select(*kept, *(F.least(*(f"m{j + k * size}" for k in range(many))).alias(f"m{j}") for j in range(span)))
        size *= many
    # to (position << 32 | upper half of the hash); windows that would reach over the end have none
    packed = [F.expr(f"if({j} < windows, shiftleft(block * {BLOCK}L + {_LOW}L - (m{j} & {_LOW}L), 32) | shiftrightunsigned(m{j}, 32), null)") for j in range(BLOCK)]
    return step.select(*keep, "block", F.array_except(F.array(*packed), F.array(F.lit(None).cast("long"))).alias("minima"))


def block_minima(texts: DataFrame, keys: list[str], text_col: str = "text", since: str | None = None) -> DataFrame:
    """(keys, block, minima) of the blocks of each row of ``texts``, from block ``since`` on where a column is named."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = texts.select(*keys, raw.alias("raw"), (F.col(since) if since else F.lit(0)).alias("first")).withColumn("n_bytes", F.octet_length("raw"))
    rows = rows.withColumn("n_grams", F.when(F.col("n_bytes") > 0, F.greatest(F.col("n_bytes") - (K - 1), F.lit(1))).otherwise(0))
    last = f"greatest(cast(ceil((n_grams - {WINDOW - 1}) / {BLOCK}) as int), 1) - 1"
    blocks = rows.select(*keys, "raw", "n_grams", F.explode(F.expr(f"if(first > {last}, cast(array() as array<int>), sequence(first, {last}))")).alias("block"))
    return _block_minima(blocks.select(*keys, "n_grams", "block", F.expr(f"substring(raw, block * {BLOCK} + 1, {REACH})").alias("bytes")), keys)


def _joined(minima: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(minima)))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and ``fingerprint``: packed (position << 32 | 32-bit hash) in order of position, for each row of
    ``texts``. Keys must tell rows apart. Null text has an empty fingerprint, like the empty text; a text shorter
    than a gram is one gram. Where ``texts`` is already partitioned by one of the keys nothing is shuffled.
    """
    return block_minima(texts, keys, text_col).groupBy(*keys).agg(_joined(F.collect_list("minima")).alias("fingerprint"))


def hashes(fingerprint: Column | str) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two sets of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every).cast("double")


def written(fingerprint: Column | str) -> Column:
    """``position:hash`` in hex, joined by spaces."""
    one = lambda v: F.concat(F.lower(F.hex(F.shiftrightunsigned(v, 32))), F.lit(":"), F.lower(F.hex(v.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))))
    return F.array_join(F.transform(fingerprint, one), " ")


def _below(bounds: list[int], value: Column) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``; looked up in two steps, so that many cost little."""
    if not bounds:
        return F.lit(0)
    array = lambda some: F.array(*(F.lit(x).cast("long") for x in some))
    wide = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    full = F.size(F.filter(array([x[-1] for x in parts]), lambda b: b <= value))  # parts that lie below as a whole
    rest = F.coalesce(F.size(F.filter(F.get(F.array(*map(array, parts)), full), lambda b: b <= value)), F.lit(0))
    return F.least(full * wide + F.greatest(rest, F.lit(0)), F.lit(len(bounds)))


def _ranges(docs: DataFrame, ranges: int | None, range_bytes: int) -> Column:
    """A number for ``doc_id`` and ``h`` that grows with them and deals the rows into about even ranges: as many as
    shuffle partitions, or more, so that each has about ``range_bytes`` of text. An id with more rows than a range, and
    the missing id, are parted by ``h``."""
    total, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = ranges or max(common.partitions(docs), -(-(size or 0) // range_bytes))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else None
    hot = [r.doc_id for r in docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") * n > max(total, 1_000)).collect()]  # fewer than n
    bounds = sorted({*(cuts or []), *hot, *(x + 1 for x in hot if x < 2**63 - 1)})
    piece = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63)).cast("long")), 58)
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_below(bounds, F.col("doc_id")))
    return part.cast("long") * PIECES + F.when(F.col("doc_id").isNull() | F.col("doc_id").isin(hot), piece).otherwise(F.lit(0).cast("long"))


def winnowing_report(docs: DataFrame, ranges: int | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    The edited text has its last quarter of code points replaced by the first as many of the next document,
    ascending by doc_id, the first after the last. Null text counts as empty; null ids come first; rows that
    repeat an id are ordered by a hash of their text. A range of ids is one window; its last document finds the
    next range's first one as an extra row, so texts are shuffled once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    docs = docs.withColumn("part", _ranges(docs, ranges, range_bytes))
    firsts = docs.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    turn = Window.orderBy("part")  # a row for each range
    last_part = F.max("part").over(Window.partitionBy())
    guests = firsts.withColumn("host", F.coalesce(F.lag("part").over(turn), last_part)).select(F.col("first.doc_id").alias("g_id"), F.col("first.h").alias("g_h"), "host")
    guest_rows = docs.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h"))).select("doc_id", "text", "h", F.col("host").alias("part"), F.lit(1).alias("guest"))
    rows = docs.select("doc_id", "text", "h", "part", F.lit(0).alias("guest")).unionByName(guest_rows)
    order = Window.partitionBy("part").orderBy("guest", "doc_id", "h")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring("next_text", F.lit(1), quarter))
    rows = rows.select("part", "place", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(F.col("guest") == 0, edited).alias("edited"), F.expr("octet_length(substring(text, 1, length(text) - cast(floor(length(text) / 4) as int)))").alias("same"))
    # a block whose windows stay within what both texts begin with has the same minima in both
    since = F.when(F.col("guest") == 1, 0).otherwise(F.greatest(F.floor((F.col("same") - REACH) / BLOCK) + 1, F.lit(0))).cast("int")
    rows = rows.withColumn("since", since).withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    keys = ["part", "place", "guest", "doc_id", "n_chars", "sha", "since"]
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text"), F.lit(0).alias("first")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"), F.col("since").alias("first")))).alias("t"))
    found = block_minima(both.select(*keys, "t.which", "t.text", "t.first"), [*keys, "which"], since="first")
    own, other = F.col("which") == 0, (F.col("which") == 1) | (F.col("block") < F.col("since"))
    pairs = found.groupBy("part", "place").agg(*(F.first(c).alias(c) for c in keys[2:6]), *(_joined(F.collect_list(F.when(c, F.col("minima")))).alias(name) for c, name in ((own, "own"), (other, "other"))))
    pairs = pairs.withColumn("edited_sha256", F.lower(F.hex("sha")))
    pairs = pairs.withColumn("own_set", hashes("own"))
    along = Window.partitionBy("part").orderBy("place")
    pairs = pairs.withColumn("next_set", F.lead("own_set").over(along)).where("guest = 0")
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written("own").alias("fingerprint"),
        written("other").alias("edited_fingerprint"),
        likeness(F.col("own_set"), hashes("other")).alias("near_edited"),
        likeness(F.col("own_set"), F.col("next_set")).alias("near_next"),
    )
