"""Progress and monitoring feeds on Structured Streaming; each function works on a batch or a stream."""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def threshold_alerts(events: DataFrame, width: str = "1 day", bad: str = "error", most: float = 0.2, least: int = 50, late: str | None = None) -> DataFrame:
    """Windows whose share of ``bad`` events passes ``most``, once there are ``least`` events."""
    e = events.withWatermark("ts", late) if late else events  # on a stream it ends the state of windows that are over
    a = e.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == bad).alias("bad"))
    return a.select(F.col("w.start").alias("start"), "n", "bad", ((F.col("n") >= least) & (F.col("bad") > most * F.col("n"))).alias("alert"))


def soon_after(events: DataFrame, first: str, then: str, within: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, first_id, then_id) of each two events of a user of which ``then`` follows ``first`` within a time: a
    join of two streams, whose state the watermarks bound."""
    a = events.where(F.col("event_type") == first).select(F.col("user_id").alias("a_user"), F.col("event_id").alias("first_id"), F.col("ts").alias("a_ts")).withWatermark("a_ts", late)
    b = events.where(F.col("event_type") == then).select(F.col("user_id").alias("b_user"), F.col("event_id").alias("then_id"), F.col("ts").alias("b_ts")).withWatermark("b_ts", late)
    return a.join(b, F.expr(f"a_user = b_user and b_ts >= a_ts and b_ts <= a_ts + interval {within}")).select(F.col("a_user").alias("user_id"), "first_id", "then_id")


def raised_floor(windows: DataFrame, key: list[str], start: int = 50, step: int = 25, most: int = 200) -> DataFrame:
    """(key, start, n, bad, alert, floor): a supervisor's least sample size, raised by a step after each alert, and
    alerts told again with it. A fold over each key's windows in order of time; a key has as many as there are days."""
    state = F.struct(F.expr("cast(array() as array<struct<start:timestamp,n:bigint,bad:bigint,alert:boolean,floor:int>>)").alias("done"), F.lit(start).alias("floor"))

    def fold(a, w):
        alert = (w["n"] >= a["floor"]) & (w["bad"] * 5 > w["n"])
        row = F.struct(w["start"].alias("start"), w["n"].alias("n"), w["bad"].alias("bad"), alert.alias("alert"), a["floor"].alias("floor"))
        return F.struct(F.concat(a["done"], F.array(row)).alias("done"), F.when(alert, F.least(a["floor"] + step, F.lit(most))).otherwise(a["floor"]).alias("floor"))

    rows = windows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "n", "bad"))).alias("w"))
    return rows.select(*key, F.inline(F.aggregate("w", state, fold, lambda a: a["done"])))


def progress(events: DataFrame, key: str) -> DataFrame:
    """The latest status of each key."""
    return events.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"), F.count("*").alias("steps"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def updates_schema(counts: DataFrame):
    return StructType([*counts.schema.fields, StructField("_batch", LongType())])


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, then stop; each batch leaves the groups that it changed, with its number ``_batch``.

    A batch has a folder of its own, so one that is run again after a failure replaces what it left.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/{batch}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_state(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each group, from the updates of all batches."""
    others = [c for c in updates.columns if c not in (*keys, "_batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("s")).select(*keys, *(F.col(f"s.{c}") for c in others))


def claims(events: DataFrame, stale_seconds: int = 21_600, most_attempts: int = 2) -> DataFrame:
    """(user_id, event_id, action) of each event, in order of time within a batch: claim, retry after a stale claim, busy, or give up.

    A stream keeps for each key when it was claimed and how often: two numbers a key.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        import numpy as np
        import pandas as pd

        at, attempts = state.get if state.exists else (None, 0)
        # a key's events may come in several frames, in any order: two numbers an event until all are there
        seen = [(f.ts.astype("int64").to_numpy() // 10**9, f.event_id.to_numpy()) for f in frames]
        seconds, ids = (np.concatenate(x) for x in zip(*seen)) if seen else ((), ())
        order = np.lexsort((ids, seconds))
        for low in range(0, len(order), 10_000):
            rows = []
            for k in order[low : low + 10_000].tolist():
                ts, event = int(seconds[k]), ids[k]
                if at is not None and ts - at <= stale_seconds:
                    action = "busy"
                elif attempts >= most_attempts:
                    action = "give up"
                else:
                    action, at, attempts = ("claim" if attempts == 0 else "retry"), ts, attempts + 1
                rows.append((key[0], event, action))
            yield pd.DataFrame(rows, columns=["user_id", "event_id", "action"])
        if at is not None:
            state.update((at, attempts))

    return events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, action string", "at long, attempts int", "append", GroupStateTimeout.NoTimeout
    )


def with_state_store(spark: SparkSession) -> SparkSession:
    """State with timers needs the store that keeps it on disk; set for the session where another one is."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Claims(StatefulProcessor):
    """Claims on a key in order of event time, whatever the order in which its events arrive.

    Events wait in the state in runs, sorted by time and kept in pieces, until the watermark has passed them; the runs are
    then merged piece by piece. A claim is held for ``stale`` seconds, then reopens without any new event. A key whose
    last claim is over for ``forget`` seconds more leaves no state behind. One timer for each key and batch tells of the
    earliest thing to come, so the calls of the state store grow with keys and pieces, not with events. Times are
    microseconds; timers have milliseconds.
    """

    #: Events that are sorted at a time, and events of a piece; a merge holds a piece of each run.
    RUN, PIECE = 1 << 18, 1 << 10

    def __init__(self, stale: int, most_attempts: int, forget: int):
        self.stale, self.most, self.forget = stale * 1_000_000, most_attempts, forget * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "run int, piece int", "us array<long>, id array<long>")
        self.runs = handle.getValueState("runs", "runs array<struct<run: int, piece: int, pieces: int, first: long>>")
        self.claim = handle.getValueState("claim", "at long, id long, attempts int, open boolean")

    def known_runs(self) -> list[list[int]]:
        """The runs that wait: number, first piece that is left, number of pieces, time of the first event."""
        found = self.runs.get()
        return [list(r) for r in found[0]] if found else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events, runs, new = ((row.us, row.event_id) for row in rows), self.known_runs(), []
        while run := sorted(itertools.islice(events, self.RUN)):
            no = (runs[-1][0] + 1) if runs else 0
            pieces = range(0, len(run), self.PIECE)
            for piece, low in enumerate(pieces):
                us, ids = zip(*run[low : low + self.PIECE])
                self.waiting.updateValue((no, piece), (list(us), list(ids)))
            runs.append([no, 0, len(pieces), run[0][0]])
            new.append(run[0][0])
        if new:
            self.runs.update(([tuple(r) for r in runs],))
            self.handle.registerTimer(min(new) // 1000)
        yield from ()

    def due(self, run: list[int], mark: int) -> Iterator[tuple[int, int]]:
        """The events of a run up to a time; they leave the state, and ``run`` tells what is left."""
        while run[1] < run[2]:
            us, ids = self.waiting.getValue((run[0], run[1]))
            n = bisect.bisect_right(us, mark)
            yield from zip(us[:n], ids[:n])
            if n < len(us):
                self.waiting.updateValue((run[0], run[1]), (list(us[n:]), list(ids[n:])))
                run[3] = us[n]
                return
            self.waiting.removeKey((run[0], run[1]))
            run[1] += 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        passed = lambda us: us // 1000 + 1 <= mark
        at, id_, attempts, open_ = before = self.claim.get() or (None, None, 0, False)
        runs = self.known_runs()
        ready = [run for run in runs if run[3] // 1000 <= mark]
        for now, event in heapq.merge(*(self.due(run, mark * 1000 + 999) for run in ready)):
            if open_ and now > at + self.stale:
                open_ = False
                yield self.row(key, id_, "stale", at + self.stale)
            if at is not None and now > at + self.stale + self.forget:
                at, id_, attempts = None, None, 0
            if open_:
                action = "busy"
            elif attempts >= self.most:
                action = "give up"
            else:
                action = "claim" if attempts == 0 else "retry"
                at, id_, attempts, open_ = now, event, attempts + 1, True
            yield self.row(key, event, action, now)
        if open_ and passed(at + self.stale):
            open_ = False
            yield self.row(key, id_, "stale", at + self.stale)
        if at is not None and passed(at + self.stale + self.forget):
            at = None
        if at is None:
            self.claim.clear()
        elif (at, id_, attempts, open_) != tuple(before):
            self.claim.update((at, id_, attempts, open_))
        left = [tuple(run) for run in runs if run[1] < run[2]]
        if ready:
            self.runs.update((left,)) if left else self.runs.clear()
        coming = [run[3] // 1000 for run in left]
        if at is not None:
            coming.append((at + self.stale + (0 if open_ else self.forget)) // 1000 + 1)
        if coming:
            self.handle.registerTimer(min(coming))

    def row(self, key, event: int, action: str, us: int) -> Row:
        return Row(user_id=key[0], event_id=event, action=action, us=us)

    def close(self) -> None:
        pass


def claims_with_timers(events: DataFrame, stale_seconds: int = 21_600, most_attempts: int = 2, forget_seconds: int = 259_200, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, action, us): what becomes of each event that the watermark has passed (claim, retry, busy, give
    up), and ``stale`` with the claim's event when a claim reopens by itself; us are microseconds since 1970.

    Events later than ``late`` behind the newest are dropped, as the watermark says. A key's state is its waiting events
    and one claim, and is gone ``forget_seconds`` after the last claim went stale. A hot key's events are sorted in runs
    of 262,144, and a piece of 1,024 of each run is in memory while they are dealt with.
    """
    at = F.col("ts").cast("timestamp")
    e = events.select("user_id", "event_id", F.unix_micros(at).alias("us"), at.alias("ts")).withWatermark("ts", late)
    return e.groupBy("user_id").transformWithState(Claims(stale_seconds, most_attempts, forget_seconds), "user_id long, event_id long, action string, us long", "Append", "EventTime")


def run_staged(spark: SparkSession, stages: list[DataFrame], build: Callable[[DataFrame], DataFrame], base: str) -> list[int]:
    """Let ``stages`` arrive one after another in a folder below ``base``, run ``build`` over the file stream after each, and
    write what it appends to ``base``/out. Returns the watermark that held when each stage was read, in milliseconds.

    Every run goes on from the state that the one before it left. All stages need the same columns.
    """
    watermarks = []
    for rows in stages:
        rows.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        query = build(stream).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        read = next((p for p in query.recentProgress if p.numInputRows), None)
        told = read.eventTime.get("watermark") if read else None
        watermarks.append(int(datetime.fromisoformat(told.replace("Z", "+00:00")).timestamp() * 1000) if told else 0)
    return watermarks


def late_rows(stages: list[DataFrame], watermarks: list[int], width: str) -> DataFrame:
    """Counts (stage, start, event_type, n) of the rows whose window the watermark had closed when their stage was read:
    what a windowed aggregate drops without a word."""
    found = None
    for k, (rows, watermark) in enumerate(zip(stages, watermarks)):
        w = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
        w = w.where(F.col("w.end") <= F.timestamp_millis(F.lit(watermark))).select(F.lit(k).alias("stage"), F.col("w.start").alias("start"), "event_type", "n")
        found = w if found is None else found.unionByName(w)
    return found


class RunningRate(StatefulProcessor):
    """Sums over a feed's windows in order of time: (n, bad) so far, and whether the feed has been told of."""

    def __init__(self, most: float, least: int):
        self.most, self.least = most, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, bad long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, bad, told = self.sums.get() if self.sums.exists() else (0, 0, False)
        for row in sorted(rows, key=lambda r: r.start):  # windows that closed in this batch: a few
            n, bad = n + row.n, bad + row.bad
            over = n >= self.least and bad > self.most * n
            yield Row(feed=key[0], start=row.start, n=row.n, bad=row.bad, run_n=n, run_bad=bad, over=over, first=over and not told)
            told = told or over
        self.sums.update((n, bad, told))

    def close(self) -> None:
        pass


_RATE = "feed long, start timestamp, n long, bad long, run_n long, run_bad long, over boolean, first boolean"


def running_rate(events: DataFrame, feed: Column, bad: Column, width: str = "1 day", most: float = 0.2, least: int = 50, late: str = "1 hour") -> DataFrame:
    """(feed, start, n, bad, run_n, run_bad, over, first) of each window: the rate of ``bad`` rows over all windows of a
    feed so far, whether it is over ``most`` once there are ``least`` rows, and the first window where it is.

    A stream adds up closed windows in a state of three numbers for each feed; windows close in order, so what the
    stream appends is what a batch finds. A batch has all windows.
    """
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = e.groupBy(F.window("ts", width).alias("w"), feed.alias("feed")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    w = w.select("feed", F.col("w.start").alias("start"), F.window_time("w").alias("closed"), "n", "bad")
    if events.isStreaming:
        return w.groupBy("feed").transformWithState(RunningRate(most, least), _RATE, "Append", "None")
    upto = Window.partitionBy("feed").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    sums = w.drop("closed").withColumn("run_n", F.sum("n").over(upto)).withColumn("run_bad", F.sum("bad").over(upto))
    sums = sums.withColumn("over", (F.col("run_n") >= least) & (F.col("run_bad") > most * F.col("run_n")))
    return sums.withColumn("first", F.col("over") & (F.sum(F.col("over").cast("int")).over(upto) == 1))
