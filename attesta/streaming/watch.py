"""Runs watched over event time: heartbeats while a run is silent, and the status of a run
that ended or fell silent for good - as a batch, and as a stateful stream with timers.

Both give (key, at, kind, status). A 'heartbeat' is due every ``beat`` seconds after an
event unless the next one is there by then. A terminal event gives an 'ended' row with its
own status. A run whose next event is more than ``stale`` seconds away is given up at that
point ('stale'), as completed with warnings if a report was written by then and as timed
out otherwise. What follows the end of a run is ignored. Events of one time are taken in
the order of their ids; events without a key or a time are left out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

BEAT_SECONDS, STALE_SECONDS = 15, 600
#: The names of final events, and the statuses of runs that were given up.
TERMINAL = ("completed", "failed", "cancelled")
REPORTED, TIMED_OUT = "completed_with_warnings", "failed_timeout"
#: Events that say that a run's report was written.
REPORTS = ("report",)
_SECOND = 1_000_000


def known(events: DataFrame, key: str) -> DataFrame:
    return events.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")


def watched(events: DataFrame, key: str, until: Column, beat: int = BEAT_SECONDS, stale: int = STALE_SECONDS, ends: tuple[str, ...] = TERMINAL, reports: tuple[str, ...] = REPORTS) -> DataFrame:
    """The rows of all events (key, ts, event_id, event_type) up to ``until``, a timestamp
    that may be a column of the events. Windows run along the events of a run; a run holds
    at most stale / beat heartbeats an event."""
    w = Window.partitionBy("key").orderBy("us", "event_id")
    timed = events.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.unix_micros(until.cast("timestamp")).alias("until")).filter(F.col("us") <= F.col("until"))
    final = F.col("event_type").isin(*ends)
    timed = timed.withColumn("next", F.lead("us").over(w)).withColumn("given_up", F.coalesce("next", "until") - F.col("us") > stale * _SECOND)
    over = F.coalesce(final, F.lit(False)) | F.col("given_up")
    before = F.sum(over.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    reported = F.max(F.coalesce(F.col("event_type").isin(*reports), F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    lines = timed.withColumns({"before": F.coalesce(before, F.lit(0)), "reported": reported}).filter("before = 0")
    last = F.least(F.coalesce(F.col("next") - 1, F.col("until")), F.col("us") + stale * _SECOND - 1)
    beats = F.floor((last - F.col("us")) / (beat * _SECOND)).cast("int")
    row = lambda at, kind, status: F.struct(at.alias("us"), F.lit(kind).alias("kind"), status.cast("string").alias("status"))
    silent = F.when(F.coalesce(final, F.lit(False)) | (beats < 1), F.array()).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(beats, F.lit(1))), lambda i: row(F.col("us") + i.cast("long") * (beat * _SECOND), "heartbeat", F.lit(None))))
    given_up = row(F.col("us") + stale * _SECOND, "stale", F.when(F.col("reported"), REPORTED).otherwise(TIMED_OUT))
    end = F.when(final, F.array(row(F.col("us"), "ended", F.col("event_type")))).when(F.col("given_up"), F.array(given_up)).otherwise(F.array())
    found = lines.select("key", F.inline(F.concat(silent, end)))
    return found.select(F.col("key").alias(key), F.timestamp_micros("us").alias("at"), "kind", "status")


class Watch(StatefulProcessor):
    """Holds back events until the watermark has passed them, so that the order in which
    they arrive doesn't count, and asks to be called at the next point that matters."""

    def __init__(self, key: str, beat: int, stale: int, ends: tuple[str, ...], reports: tuple[str, ...]) -> None:
        self.key, self.beat, self.stale, self.ends, self.reports = key, beat * _SECOND, stale * _SECOND, ends, reports

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last bigint, beats bigint, reported boolean, over boolean, timer bigint")
        self.waiting = handle.getListState("waiting", "us bigint, event_id bigint, event_type string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run = self.run.get() if self.run.exists() else (None, 0, False, False, None)
        fresh = [] if run[3] else [
            (int(us), int(event_id), event_type)
            for part in rows
            for us, event_id, event_type in zip(part["ts"].astype("datetime64[us]").astype("int64"), part["event_id"], part["event_type"])
        ]
        yield from self._advance(key, run, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, self.run.get()[:4] + (None,), [], timerValues)

    def _advance(self, key, run, fresh, timerValues) -> Iterator[pd.DataFrame]:
        last, beats, reported, over, timer = run
        if over:
            return
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted([*(self.waiting.get() if self.waiting.exists() else []), *fresh], key=lambda e: e[:2])
        out: list[tuple[int, str, str | None]] = []

        def silence(end: int) -> None:
            """Heartbeats before ``end``, and the end of a run that was silent too long."""
            nonlocal beats, over
            while (at := last + (beats + 1) * self.beat) < min(end, last + self.stale):
                beats += 1
                out.append((at, "heartbeat", None))
            if end - last > self.stale:
                over = True
                out.append((last + self.stale, "stale", REPORTED if reported else TIMED_OUT))

        done = 0
        while not over and done < len(waiting) and waiting[done][0] <= until:
            us, _, event_type = waiting[done]
            if last is not None:
                silence(us)
            if not over:
                last, beats, reported = us, 0, reported or event_type in self.reports
                if event_type in self.ends:
                    over = True
                    out.append((us, "ended", event_type))
            done += 1
        if not over and last is not None:
            while (at := last + (beats + 1) * self.beat) <= until and at < last + self.stale:
                beats += 1
                out.append((at, "heartbeat", None))
            silence(until)
        waiting = [] if over else waiting[done:]
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        due = [] if over else [us for us, _, _ in waiting[:1]] + ([] if last is None else [min(last + (beats + 1) * self.beat, last + self.stale + 1)])
        wanted = -(-min(due) // 1000) if due else None
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.run.update((last, beats, reported, over, wanted))
        if out:
            yield pd.DataFrame({self.key: [key[0]] * len(out), "at": pd.to_datetime([at for at, _, _ in out], unit="us"), "kind": [k for _, k, _ in out], "status": [s for _, _, s in out]})

    def close(self) -> None:
        pass


def watch_stream(events: DataFrame, key: str, late: str = "10 minutes", beat: int = BEAT_SECONDS, stale: int = STALE_SECONDS, ends: tuple[str, ...] = TERMINAL, reports: tuple[str, ...] = REPORTS) -> DataFrame:
    """The same rows from a stream, once its watermark has passed them; events more than
    ``late`` behind are dropped. State is a run's last event, its waiting events and one
    timer, and for an ended run a single row; it survives restarts in the query's checkpoint. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass) and a session in UTC."""
    timed = known(events, key).withWatermark("ts", late)
    schema = StructType([StructField(key, events.schema[key].dataType), StructField("at", TimestampType()), StructField("kind", StringType()), StructField("status", StringType())])
    return timed.groupBy(key).transformWithStateInPandas(Watch(key, beat, stale, ends, reports), schema, "Append", "EventTime")


def recovered(runs: DataFrame, events: DataFrame, now: Column, key: str = "run_id", seconds: int = STALE_SECONDS) -> DataFrame:
    """(key, previous_status, new_status, had_report, last_event_at, error) of the running
    ``runs`` (key, status, has_report) whose last event is more than ``seconds`` before
    ``now`` (a column of the runs or a literal), or that have no event with a time."""
    last = events.groupBy(key).agg(F.max("ts").alias("last_event_at"))
    running = runs.filter("status = 'running'").join(last, key, "left")
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_event_at").cast("timestamp"))
    had = F.coalesce(F.col("has_report"), F.lit(False))
    error = F.when(~had, f"no event for more than {seconds} s")
    stale = running.filter(F.coalesce(idle > seconds * _SECOND, F.lit(True)))
    return stale.select(key, F.col("status").alias("previous_status"), F.when(had, REPORTED).otherwise(TIMED_OUT).alias("new_status"), had.alias("had_report"), "last_event_at", error.alias("error"))
