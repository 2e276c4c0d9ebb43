"""Secret scans: certain patterns, and weak candidates that count only beside complementary parts.

A credential often comes in parts: an access identifier, a secret, an endpoint. A weak candidate for one part
(a login, a mixed token, a URL) is reported only if a part of another kind, weak or certain, lies within
``scope`` code points and doesn't overlap it. A token in the path of a URL confirms no URL, nor the other way round. What stands in a URL's
query, fragment or credentials is a part of its own. A text's parts are searched by sorted starts and ends, so a
text with many parts makes no pairs.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 or more characters
LOGIN = re.compile(r"""(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}""", re.I | re.A)
MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?:endpoint|host)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::\d+)?""", re.I | re.A)
#: Kinds in the order of the report; the first three are certain. The second item is the part they stand for.
KINDS = (("assign", "secret"), ("access", "access"), ("hex", "secret"), ("weak_access", "access"), ("weak_secret", "secret"), ("endpoint", "endpoint"))
PARTS = ("access", "secret", "endpoint")
_ASSIGN_WORDS, _LOGIN_WORDS, _END_WORDS = (b"passw", b"secret", b"token", b"api"), (b"user", b"login", b"client", b"account", b"access"), (b"http", b"endpoint", b"host")
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True


def _long_runs(texts: list[bytes], least: int) -> set[int]:
    """Texts that hold a run of ``least`` or more token characters."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", "u1")
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _RUN[flat]]).view("i1")))
    starts = edges[0::2][edges[1::2] - edges[0::2] >= least] if len(edges) else edges
    ends = np.cumsum([len(x) + 1 for x in texts])
    return set(np.searchsorted(ends, starts, side="right").tolist())


def _is_mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and len(set(token)) >= 10


def scan(text: str, low: bytes, runs: bool) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, ordered by start, then kind. ``low``: the text's bytes, lower-cased."""
    found = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in low:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if runs:
        found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted(found, key=lambda x: x[1])
    starts = [x[1] for x in base]
    furthest = np.maximum.accumulate([x[2] for x in base]) if base else ()

    def free(m: re.Match) -> bool:
        k = np.searchsorted(starts, m.end()) if starts else 0
        return not k or furthest[k - 1] <= m.start()

    if any(w in low for w in _LOGIN_WORDS):
        found += [(3, m.start(), m.end()) for m in LOGIN.finditer(text) if free(m)]
    if runs:
        found += [(4, m.start(), m.end()) for m in MIXED.finditer(text) if _is_mixed(m[0]) and free(m)]
    if any(w in low for w in _END_WORDS):
        found += [(5, m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def _own(url: str) -> list[tuple[int, int]]:
    """Where parts of their own stand in a URL: its credentials, and its query and fragment."""
    begin = url.find("://") + 3
    if begin < 3:
        return []
    path = min((k for k in map(url.find, "/?#", (begin,) * 3) if k >= 0), default=len(url))
    query = min((k for k in map(url.find, "?#", (begin,) * 2) if k >= 0), default=len(url))
    at = url.rfind("@", begin, path)
    return ([(begin, at)] if at >= 0 else []) + ([(query, len(url))] if query < len(url) else [])


def linked(spans: list[tuple[int, int, int]], text: str, scope: int) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the certain spans and of the weak ones beside a disjoint part of another kind."""
    if all(k < 3 for k, _, _ in spans):
        return spans
    others = [s for s in spans if s[0] != 5]
    at = [s[1] for s in others]
    inside, path = set(), set()
    for k, a, b in spans:
        if k == 5:
            path.update(s for s in others[bisect_left(at, a) : bisect_left(at, b)] if s[0] == 4)
        for low, high in _own(text[a:b]) if k == 5 else ():
            held = [s for s in others[bisect_left(at, a + low) : bisect_left(at, a + high)] if s[2] <= a + high]
            if held:
                inside.update([(k, a, b), *held])

    path -= inside
    apart = [s for s in spans if s not in path]
    starts, ends = ({p: sorted(s[c] for s in spans if KINDS[s[0]][1] == p) for p in PARTS} for c in (1, 2))
    apart_starts, apart_ends = ({p: sorted(s[c] for s in apart if KINDS[s[0]][1] == p) for p in PARTS} for c in (1, 2))

    def beside(k: int, a: int, b: int) -> bool:
        for p in PARTS:
            if p != KINDS[k][1] and not (p == "endpoint" and (k, a, b) in path):
                low, high = (apart_ends[p], apart_starts[p]) if k == 5 else (ends[p], starts[p])
                before, after = bisect_right(low, a), bisect_left(high, b)
                if (before and low[before - 1] >= a - scope) or (after < len(high) and high[after] <= b + scope):
                    return True
        return False

    return [s for s in spans if s[0] < 3 or s in inside or beside(*s)]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and the parts kept.

    Null text counts as empty; texts without a find have the digest of the empty string and empty spans;
    repeated rows are scanned each. Weak candidates that overlap a certain one are dropped; certain ones stay.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, kept array<struct<start:int,kind:int,end:int>>"
    part = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            raw = [x.encode() for x in texts]
            runs = _long_runs(raw, 20)
            spans = [scan(t, b.lower(), k in runs) for k, (t, b) in enumerate(zip(texts, raw))]
            kept = [sorted(linked(x, t, scope), key=lambda s: (s[1], s[0], s[2])) for x, t in zip(spans, texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    *(pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in range(3)),
                    pa.array([hashlib.sha256(_written([s for s in x if s[0] < 3]).encode()).hexdigest() for x in spans]),
                    pa.array([_written(x) for x in kept], pa.string()),
                    pa.array([[{"start": a, "kind": k, "end": b} for k, a, b in x] for x in kept], part),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "kept"],
            )

    return docs.select("doc_id", "text").mapInArrow(find, schema)
