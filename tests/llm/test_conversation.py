"""Repair of conversations against all edits tried out, and its promises on nulls, ties, long and odd conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from siftline.llm import common, conversation, queries

from ..conftest import SF


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        letters = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not letters else "duplicate" if (role, text) in seen else None if letters[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _best(rows):
    """(cost, audit, lines) of the best of all edits with up to three inserts in each gap."""
    faults, gaps = _faults(rows), [g for n in range(4) for g in itertools.product(("user", "assistant"), repeat=n)]
    choices = []
    for (_, role, text), fault in zip(rows, faults):
        more = fault == "truncated"
        own = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", more, f"{role}:{text}"), ("R", 2 + more, f"user:{text}"), ("R", 2 + more, f"assistant:{text}")]
        choices.append(own)
    best = None
    for edits in itertools.product(*choices):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(c for _, c, _ in edits) + 2 * sum(map(len, inserts))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for k, gap in enumerate(inserts):
                audit += "I" * len(gap)
                lines += [f"{r}:" for r in gap]
                if k < len(edits):
                    audit += edits[k][0]
                    lines += [edits[k][2]] if edits[k][2] is not None else []
            if re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def _repaired(rows, held=conversation.HELD):
    repair, out = conversation.Repair(held), []
    for (turn, role, text), fault in zip(rows, _faults(rows)):
        out += repair.push((turn, fault, role, text))
    return [*out, *repair.end()]


def _random(rng, n):
    return [(k, rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rng.choice(["yes.", "no", " ", "why?", "go on", ""])) for k in range(n)]


def _cost(edits):
    return sum({"K": 0, "R": 2, "D": 3, "I": 2}[e[0]] + (e[2] == "truncated" and e[0] != "D") for e in edits)


def test_cheapest_edits_against_all(spark):
    rng = random.Random(4)
    for _ in range(60):
        rows = _random(rng, rng.randrange(0, 3))
        edits = _repaired(rows)
        cost, audit, lines = _best(rows)
        assert (_cost(edits), "".join(e[0] for e in edits)) == (cost, audit), rows
        assert [f"{e[4]}:{e[5]}" for e in edits if e[4] is not None] == lines


def _by_strings(rows):
    """Cost and audit by whole strings for each state: a plain dynamic program that keeps every tied string."""
    step = {0: 2, 1: 2, 2: 3, 3: 2}

    def grown(states):
        out = dict(states)
        for _ in range(3):
            for q, found in list(out.items()):
                out[step[q]] = out.get(step[q], set()) | {(c + 2, a + "I") for c, a in found}
        return {q: {x for x in found if x[0] <= min(found)[0]} for q, found in out.items()}

    states = {0: {(0, "")}}
    for (_, role, _), fault in zip(rows, _faults(rows)):
        new = {}
        for q, found in grown(states).items():
            more = fault == "truncated"
            goes = [("D", q, 3)]
            if fault not in ("blank", "duplicate"):
                goes.append(("R", step[q], 2 + more))
                if role[:1] == "s" and q == 0:
                    goes.append(("K", 1, more))
                if role[:1] == {2: "u", 3: "a"}[step[q]]:
                    goes.append(("K", step[q], more))
            for letter, to, price in goes:
                new.setdefault(to, set()).update((c + price, a + letter) for c, a in found)
        states = {q: {x for x in found if x[0] <= min(found)[0]} for q, found in new.items()}
    return min(x for q, found in grown(states).items() if q in (0, 3) for x in found)


@pytest.mark.parametrize("held", [conversation.HELD, 200])
def test_longer_conversations_against_all_tied_strings(held):
    rng = random.Random(5)
    for n in [4, 5, 6, 7, 8] * 12:
        rows = _random(rng, n)
        edits = _repaired(rows, held)
        assert (_cost(edits), "".join(e[0] for e in edits)) == _by_strings(rows), rows
        assert [e[5] for e in edits if e[0] != "I"] == [r[2] for r in rows]


def test_edits_leave_as_soon_as_survivors_meet():
    repair, most, out = conversation.Repair(), 0, 0
    for k in range(3000):
        out += len(list(repair.push((k, None, "user" if k % 2 == 0 else "assistant", f"row {k}."))))
        most = max(most, len(repair.layers))
    assert most < 10 and out > 2980


def test_rows_that_stay_open_wait_in_a_file():
    rows = [(k, "tool", f"{k} {'x' * 100}.") for k in range(500)]
    repair = conversation.Repair(held=4096)
    out = [e for turn, role, text in rows for e in repair.push((turn, None, role, text))]
    assert not out and repair.waiting.filed > 400 and repair.waiting.bytes <= 4096
    edits = list(repair.end())
    assert [e[5] for e in edits if e[0] != "I"] == [r[2] for r in rows] and _cost(edits) == 1000
    assert repair.waiting.file is None and "".join(e[0] for e in edits) == "R" * 500


def test_report_on_odd_rows(spark):
    rows = [(None, None, None, None, 1), (None, 3, "user", "a.", 2), (1, 2, None, "b", 3), (1, None, "assistant", "c.", 4), (1, 2, None, "b", 5), (2, 5, "", "d.", 6), (3, 1, "system", "x" * 100_000 + ".", 7), (3, 2, "user", "q?", 8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault int").repartition(3)
    got = {r.conv_id: r for r in conversation.conversation_report(df).collect()}
    assert set(got) == {None, 1, 2, 3} and len(got) == 4
    con = duckdb.connect()
    pdf = df.drop("fault").toPandas()
    con.register("plain", pdf)
    con.execute("create view conversations as select case when isnan(conv_id) then null else conv_id::bigint end as conv_id, case when isnan(turn) then null else turn::bigint end as turn, role, text from plain")
    found = con.sql(queries.oracle_sql()["op11_conversation_repair"])
    for r in found.fetchall():
        want = dict(zip(found.columns, r))
        assert got[want["conv_id"]].asDict() == want
    none = conversation.conversation_report(df.limit(0))
    assert none.count() == 0 and none.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_conversation_without_rows_left(spark):
    lost = next(k for k in range(1000) if __import__("zlib").crc32(f"{k}:0".encode()) % 20 == 0)
    row, = conversation.conversation_report(spark.createDataFrame([(lost, 0, "user", "hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert row == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_rows_follow_the_grammar(spark):
    df = conversation.repaired(common.read(spark, SF, "conversations"))
    by = {}
    for r in df.collect():
        by.setdefault(r.conv_id, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.step)
        assert [r.step for r in rows] == list(range(len(rows)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in rows if r.role is not None))
