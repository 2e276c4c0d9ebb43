"""Streams with state: claims with timers, late rows, sessions and running rates, over several batches."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siftline.session import importable
from siftline.streaming import monitor as M

START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _events(spark, rows):
    return spark.createDataFrame([(k, START + timedelta(hours=h), user, kind, 1.0) for k, (h, user, kind) in enumerate(rows)], EVENTS)


@pytest.fixture()
def stateful(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield M.with_state_store(importable(spark))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _claims(spark, base, stages):
    out = []
    M.run_staged(spark, stages, lambda e: M.claims_with_timers(e, late="1 hour"), base)
    for r in spark.read.parquet(f"{base}/out").collect():
        out.append((r.us // 3_600_000_000 - int(START.timestamp()) // 3600, r.user_id, r.event_id, r.action))
    return sorted(out)


def test_claims_reopen_without_a_new_event(stateful, tmp_path):
    hours = [(0, 1, "a"), (1, 1, "a"), (7, 1, "a"), (8, 1, "a"), (20, 1, "a"), (0, 2, "a"), (200, 9, "a")]
    got = _claims(stateful, str(tmp_path), [_events(stateful, hours)])
    assert got == [(0, 1, 0, "claim"), (0, 2, 5, "claim"), (1, 1, 1, "busy"), (6, 1, 0, "stale"), (6, 2, 5, "stale"), (7, 1, 2, "retry"), (8, 1, 3, "busy"), (13, 1, 2, "stale"), (20, 1, 4, "give up")]


def test_claims_forget_a_key_and_leave_no_state(stateful, tmp_path):
    hours = [(0, 1, "a"), (7, 1, "a"), (14, 1, "a"), (90, 1, "a"), (91, 1, "a"), (400, 9, "a")]
    got = _claims(stateful, str(tmp_path), [_events(stateful, hours)])
    assert [x[3] for x in got if x[1] == 1] == ["claim", "stale", "retry", "stale", "give up", "claim", "busy", "stale"]
    store = stateful.read.format("statestore").option("stateVarName", "claim").load(f"{tmp_path}/state")
    assert store.count() == 0  # the last event only waits


def test_claims_do_not_depend_on_batches_or_order(stateful, tmp_path):
    hours = [(h * 1.37, h % 5, "a") for h in range(120)] + [(h * 0.1, 7, "a") for h in range(300)] + [(500, 9, "a")]
    rows = _events(stateful, hours)
    whole = _claims(stateful, f"{tmp_path}/a", [rows.orderBy(F.desc("event_id"))])
    parts = _claims(stateful, f"{tmp_path}/b", [rows.where("ts < '2024-01-03'"), rows.where("ts >= '2024-01-03' and ts < '2024-01-05'"), rows.where("ts >= '2024-01-05'")])
    assert whole == parts and len(whole) > 400


def test_late_rows_are_dropped_and_counted(stateful, tmp_path):
    first = _events(stateful, [(h, 1, "a") for h in range(0, 100, 2)])
    second = _events(stateful, [(1, 1, "a"), (5, 1, "b"), (70, 1, "a"), (99, 1, "a"), (200, 1, "a")])
    third = _events(stateful, [(100, 1, "a"), (150, 1, "a"), (190, 1, "a"), (400, 1, "a")])
    stages = [first, second, third]
    marks = M.run_staged(stateful, stages, lambda e: M.tumbling(e, late="1 day").drop("total"), str(tmp_path))
    day = lambda h: int((START + timedelta(hours=h)).timestamp() * 1000)
    assert marks == [0, day(98 - 24), day(200 - 24)]
    late = sorted((r.stage, r.event_type, (r.start - START).days, r.n) for r in M.late_rows(stages, marks, "1 day").collect())
    assert late == [(1, "a", 0, 1), (1, "a", 2, 1), (1, "b", 0, 1), (2, "a", 4, 1), (2, "a", 6, 1)]
    closed = {((r.start - START).days, r.event_type): r.n for r in stateful.read.parquet(f"{tmp_path}/out").collect()}
    assert closed == {(0, "a"): 12, (1, "a"): 12, (2, "a"): 12, (3, "a"): 12, (4, "a"): 3, (7, "a"): 1, (8, "a"): 1}


def test_running_rate_of_stream_and_batch_agree(stateful, tmp_path):
    rows = _events(stateful, [(h, h % 3, "error" if h > 150 and h % 2 else "ok") for h in range(480)])
    rate = lambda e: M.running_rate(e, F.col("user_id"), F.col("event_type") == "error", most=0.1, least=40)
    M.run_staged(stateful, [rows.where(f"event_id % 480 between {a} and {a + 119}") for a in range(0, 480, 120)], rate, str(tmp_path))
    stream = sorted(stateful.read.parquet(f"{tmp_path}/out").collect())
    batch = sorted(rate(rows).select(stream[0].__fields__).collect())
    assert stream == [r for r in batch if r.start < START + timedelta(days=19)] and len(batch) == 60
    assert sum(r["first"] for r in stream) == 3 and any(r.over and not r["first"] for r in stream)
    assert all(not r.over for r in stream if r.run_n < 40)


class _State:
    """A state of one key in memory that counts how often it is asked."""

    calls = 0

    def __init__(self):
        self.kept = {}

    def __getattr__(self, name):
        _State.calls += 1
        return {"exists": lambda: () in self.kept, "get": lambda: self.kept.get(()), "update": lambda v: self.kept.update({(): v}), "clear": self.kept.clear, "keys": lambda: iter(self.kept), "containsKey": self.kept.__contains__, "getValue": self.kept.get, "updateValue": self.kept.__setitem__, "removeKey": self.kept.pop}[name]


class _Handle(_State):
    def __init__(self):
        self.timers, self.getMapState, self.getValueState = set(), lambda *a: _State(), lambda *a: _State()

    def registerTimer(self, ms):
        _State.calls += 1
        self.timers.add(ms)


class _At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_claims_ask_the_state_by_pieces_not_by_events(monkeypatch):
    """3,000 events of one key in mixed order and four batches: the rows of a fold over all, few calls of the state."""
    monkeypatch.setattr(M.Claims, "RUN", 500, raising=False)
    monkeypatch.setattr(M.Claims, "PIECE", 100, raising=False)
    stale, forget, step = 60_000_000, 300_000_000, 700_123
    times = {k: (k + 2_000 * (k > 1_500)) * step for k in range(3_000)}
    want, at, id_, attempts, open_ = [], None, None, 0, False
    for k, now in times.items():
        if open_ and now > at + stale:
            want.append((id_, "stale", at + stale))
            open_ = False
        if at is not None and now > at + stale + forget:
            at, attempts = None, 0
        action = "busy" if open_ else "give up" if attempts >= 2 else "retry" if attempts else "claim"
        if action in ("claim", "retry"):
            at, id_, attempts, open_ = now, k, attempts + 1, True
        want.append((k, action, now))
    handle, claims = _Handle(), M.Claims(60, 2, 300)
    claims.init(handle)
    _State.calls, got = 0, []
    for batch in range(5):
        ids = sorted((k for k in times if min(k + 40 * (k % 3), 2_999) // 750 == batch), key=lambda k: k * 7_919 % 3_000)
        mark = (times[750 * (batch + 1) - 81] if batch < 4 else 10**12) // 1000
        got += list(claims.handleInputRows((1,), iter([Row(us=times[k], event_id=k) for k in ids]), _At(mark)))
        while due := sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(due[0])
            got += list(claims.handleExpiredTimer((1,), type("Now", (), {"getCurrentWatermarkInMs": lambda self: mark})(), _At(due[0])))
    assert [(r.event_id, r.action, r.us) for r in got] == want and {"claim", "retry", "give up", "busy", "stale"} == {a for _, a, _ in want}
    assert not handle.timers and not claims.waiting.kept and not claims.claim.kept
    assert _State.calls < 400


def test_tolerant_answers_take_several_tasks(spark):
    """Answers cost far more than their bytes tell: one small file isn't left to one task."""
    from siftline.plans import queries as q

    import __spark_entry__ as entry

    assert "tolerant_answers" in entry.queries() and q.queries()["tolerant_answers"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
