"""JSON in a model's answer, also where quotes within its texts aren't escaped.

A text is taken apart at its quotes, and a state goes over them: the brackets that are open, whether a string is open,
and whether that string is a key. A quote within a string closes it only if what follows could follow there: a colon
behind a key; a closing bracket, or a comma and another key, behind a value of an object; a comma or a closing
bracket behind a value of an array. Any other quote belongs to the text and is escaped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of a review, and what its result may be with the verdict that goes with it.
REVIEW_FIELDS = ("doi", "result", "trigger", "image_review", "data_review", "ref_review", "methodology_review", "verdict", "reason")
RESULTS = (("高风险", "建议高风险"), ("低风险", "建议低风险"))

_BLANK = " \t\r\n"
_SCHEMA = "struct<out: string, stack: string, inside: boolean, key: boolean, done: boolean>"


def _stack(stack: Column, between: Column) -> Column:
    """The open brackets after a text outside strings; ``-`` once the first one is closed."""
    signs = F.split(F.regexp_replace(between, r"[^\[\]{}]", ""), "")
    step = lambda s, c: F.when((s == "-") | (c == ""), s).when(c.isin("{", "["), F.concat(s, c)).when(F.length(s) <= 1, "-").otherwise(F.left(s, F.length(s) - 1))
    return F.aggregate(signs, stack, step)


def _end(between: Column, stack: Column) -> Column:
    """A text outside strings up to the bracket that closes the first one."""
    signs = F.split(between, "")
    state = F.struct(F.lit("").alias("out"), stack.alias("stack"))

    def step(a, c):
        after = _stack(a["stack"], c)
        return F.struct(F.when(a["stack"] == "-", a["out"]).otherwise(F.concat(a["out"], c)).alias("out"), after.alias("stack"))

    return F.aggregate(signs, state, step, lambda a: a["out"])


def _plain(piece: Column) -> Column:
    """A piece of a string, with line ends and tabs as JSON has them."""
    for sign, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        piece = F.replace(piece, F.lit(sign), F.lit(code))
    return piece


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repaired_json(text: Column) -> Column:
    """The first JSON object in ``text``, with the quotes within its strings escaped, what is open at the end closed,
    and no comma behind a last string.

    One pass over the quotes; a text without a brace, or null, gives null. What is escaped already stays as it is.
    Whether the rest is JSON isn't judged here.
    """
    return _with(F.split(F.regexp_extract(text, r"(?s)(\{.*)", 1), '"', -1), _repaired)


def _quotes(pieces: Column) -> Column:
    """For each quote: the piece behind it, whether it is escaped, the sign before it, and what may end there."""

    def one(k: Column) -> Column:
        return _with(F.struct(F.get(pieces, k).alias("before"), F.get(pieces, k + 1).alias("after"), F.ltrim(F.coalesce(F.get(pieces, k + 3), F.lit("")), F.lit(_BLANK)).alias("later"), (k == F.size(pieces) - 2).alias("last")), told)

    def told(p: Column) -> Column:
        after = p["after"]
        bare_comma = after.rlike(r"^\s*,\s*$")
        return F.struct(
            after.alias("after"),
            (F.length(F.regexp_extract(p["before"], r"(\\*)$", 1)) % 2 == 1).alias("escaped"),
            F.right(F.rtrim(p["before"], F.lit(_BLANK)), F.lit(1)).alias("sign"),
            after.rlike(r"^\s*:").alias("key_ends"),
            (after.rlike(r"^\s*,?\s*\}") | (bare_comma & (p["last"] | p["later"].startswith(":")))).alias("object_ends"),
            (after.rlike(r"^\s*\]|^\s*,\s*[-\dtfn{\[\]]") | bare_comma).alias("array_ends"),
        )

    return F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(0), F.size(pieces) - 2), one))


def _repaired(pieces: Column) -> Column:
    first = F.get(pieces, F.lit(0))
    start = _with(_stack(F.lit(""), first), lambda stack: F.struct(_end(first, F.lit("")).alias("out"), stack.alias("stack"), F.lit(False).alias("inside"), F.lit(False).alias("key"), (stack == "-").alias("done")).cast(_SCHEMA))

    def step(a: Column, q: Column) -> Column:
        state = lambda out, stack, inside, key, done: F.struct(out.alias("out"), stack.alias("stack"), inside.alias("inside"), key.alias("key"), done.alias("done")).cast(_SCHEMA)
        top, yes, no = F.right(a["stack"], F.lit(1)), F.lit(True), F.lit(False)
        closes = ~q["escaped"] & F.when(a["key"], q["key_ends"]).when(top == "{", q["object_ends"]).when(top == "[", q["array_ends"]).otherwise(True)
        opened = state(F.concat(a["out"], F.lit('"'), _plain(q["after"])), a["stack"], yes, (top == "{") & (q["sign"] != ":"), no)
        closed = _with(_stack(a["stack"], q["after"]), lambda stack: state(F.concat(a["out"], F.lit('"'), F.when(stack == "-", _end(q["after"], a["stack"])).otherwise(q["after"])), stack, no, no, stack == "-"))
        inner = state(F.concat(a["out"], F.when(q["escaped"], F.lit('"')).otherwise(F.lit('\\"')), _plain(q["after"])), a["stack"], yes, a["key"], no)
        return F.when(a["done"], a).when(~a["inside"], opened).when(closes, closed).otherwise(inner)

    none = F.expr("cast(array() as array<struct<after: string, escaped: boolean, sign: string, key_ends: boolean, object_ends: boolean, array_ends: boolean>>)")
    whole = F.aggregate(F.coalesce(_quotes(pieces), none), start, step, lambda a: F.when(a["done"], a["out"]).otherwise(_closed(a)))
    return F.regexp_replace(F.nullif(whole, F.lit("")), r'(?<!\\)"\s*,(\s*[}\]])', '"$1')  # a comma behind the last string


def _closed(a: Column) -> Column:
    """An object that a text's end cut off, with what is open closed."""
    cut = F.when(a["inside"], F.concat(a["out"], F.lit('"'))).otherwise(F.rtrim(a["out"], F.lit("," + _BLANK)))
    return F.when(a["stack"] != "", F.concat(cut, F.reverse(F.translate(a["stack"], "{[", "}]"))))


def _valid(text: Column) -> Column:
    return _with(text, lambda t: F.when(F.try_parse_json(t).isNotNull(), t))


def json_in(text: Column) -> Column:
    """The JSON object in a model's answer: in a fence, else from the first brace to the last, else the first object
    that is whole once inner quotes are escaped, in the fence before the rest; null where there is none."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?)\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(_valid(fenced), _valid(braces), _valid(repaired_json(fenced)), _valid(repaired_json(text)))


def review_fields(text: Column) -> Column:
    """The fields of a review in a model's answer, all of them texts: those that are missing are empty, but the verdict
    follows the result. Null where no object is found or its result is none of the two."""
    return _with(F.from_json(json_in(text), "map<string,string>"), _review)


def _review(found: Column) -> Column:
    field = lambda n: F.coalesce(F.element_at(found, n), F.lit(""))
    result = F.element_at(found, "result")
    verdict = F.element_at(F.create_map(*(F.lit(x) for pair in RESULTS for x in pair)), result)
    fields = [F.coalesce(F.element_at(found, "verdict"), verdict).alias(n) if n == "verdict" else field(n).alias(n) for n in REVIEW_FIELDS]
    return F.when(result.isin(*(r for r, _ in RESULTS)), F.struct(*fields))
