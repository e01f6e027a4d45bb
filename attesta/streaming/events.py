"""Run events: canonical form, replay, staleness, status counts - in batch, and the same
expressions on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest detail that an event keeps.
DETAIL = 2000
STALE_SECONDS = 600
#: Keys that no event shows, and the characters of its summary.
STRIPPED = ("stdout", "stderr", "traceback", "full_output")
SUMMARY = 200
#: Events that a replay goes back at most, over all runs.
BUFFER = 1000


def canonical(events: DataFrame, payload: str = "props", limit: int = DETAIL) -> DataFrame:
    """Events with their payload cut to ``limit`` characters and a flag where it was cut.
    Works on batches and streams alike."""
    return events.select("event_id", "ts", "user_id", "event_type", F.substring(payload, 1, limit).alias("detail"), (F.coalesce(F.length(payload), F.lit(0)) > limit).alias("truncated"))


def contract(events: DataFrame, payload: str = "payload", limit: int = SUMMARY, stripped: tuple[str, ...] = STRIPPED) -> tuple[DataFrame, DataFrame]:
    """Events whose JSON ``payload`` keeps to what may be shown, and the texts that were too
    long for it. The payload's forbidden keys go, its detail is cut to ``limit`` characters
    and given as summary too, and events gain log_ref, detail, summary and a map of the other
    keys. A longer detail is a row (log_ref, text) of the second table, and so is the detail
    of a failed event that names no log; a log is named by step and event_id, so a replay
    writes the same names. A payload that is no JSON object has no keys. No aggregates:
    both are projections, on batches and streams alike."""
    keys = F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>"))
    raw = events.withColumn("_keys", F.map_filter(keys, lambda k, _: ~k.isin(*stripped)))
    text = F.coalesce(F.try_element_at("_keys", F.lit("detail")), F.lit(""))
    step = F.coalesce(F.try_element_at("_keys", F.lit("key")), F.try_element_at("_keys", F.lit("step")), F.lit("unknown"))
    raw = raw.withColumns({"_text": text, "_named": F.try_element_at("_keys", F.lit("log_ref"))})
    failed = F.coalesce(F.try_element_at("_keys", F.lit("status")) == "failed", F.lit(False)) & F.col("_named").isNull() & (F.col("_text") != "")
    spills = (F.length("_text") > limit) | failed
    raw = raw.withColumn("log_ref", F.when(spills, F.concat(F.lit("logs/"), step, F.lit("_"), F.col("event_id").cast("string"), F.lit(".log"))).otherwise(F.col("_named")))
    rest = F.map_filter("_keys", lambda k, _: ~k.isin("detail", "summary", "log_ref"))
    cut = F.substring("_text", 1, limit)
    shown = raw.withColumns({"detail": cut, "summary": cut, "other": rest}).drop(payload, "_keys", "_text", "_named")
    return shown, raw.filter(spills).select("log_ref", F.col("_text").alias("text"))


def replay(events: DataFrame, after: int | str, run_col: str | None = None, run: object = None, buffer: int = BUFFER) -> DataFrame:
    """The buffered events with ids beyond ``after``, of one run if it is named. The buffer
    holds the last events of all runs; an id that is no integer replays nothing."""
    text = str(after)
    if not text.lstrip("-").isdigit():
        return events.limit(0)
    kept = events.orderBy(F.desc("event_id")).limit(buffer)
    kept = kept.filter(F.col("event_id") > int(text))
    return kept.filter(F.col(run_col) == run) if run_col else kept


def staleness(events: DataFrame, keys: list[str], now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """(keys, last_event_at, n_events, stale): whether a run's last event is older than
    ``seconds``; a run without a readable time is stale."""
    last = events.groupBy(*keys).agg(F.max("ts").alias("last_event_at"), F.count("*").alias("n_events"))
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_event_at").cast("timestamp"))
    return last.withColumn("stale", F.coalesce(idle > seconds * 1_000_000, F.lit(True)))


def status_counts(events: DataFrame) -> DataFrame:
    """(event_type, n), in batch and in update mode on a stream alike."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def status_users(events: DataFrame) -> DataFrame:
    """(event_type, users): distinct users, exactly and so in batch only."""
    return events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total): event-time windows; on a stream the watermark
    drops events later than ``late``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counts = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): stretches without a pause of ``gap``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counts = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def heartbeat_gaps(events: DataFrame, key: str = "user_id", seconds: int = 15) -> DataFrame:
    """(key, n_gaps, longest): pauses between events that call for a heartbeat."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    pause = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1_000_000
    gaps = events.select(key, pause.alias("pause")).filter(F.col("pause") > seconds)
    return gaps.groupBy(key).agg(F.count("*").alias("n_gaps"), F.max("pause").alias("longest"))


def read_stream(spark, path: str, schema) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def write_latest(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends finished windows to a folder, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
