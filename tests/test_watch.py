"""Run events as a stream with state against the batch, and event payloads."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attesta.operators import offsets
from attesta.streaming import events, watch

START = datetime(2024, 1, 1)
TABLE = "run string, ts timestamp, event_id long, event_type string"


def plain(rows, until, beat, stale):
    """The rule, event by event."""
    out = []
    for run in {r[0] for r in rows if r[0] is not None}:
        last, reported, over = None, False, False
        for ts, _, kind in sorted((r[1], r[2], r[3]) for r in rows if r[0] == run and r[1] is not None and r[1] <= until):
            if over:
                break
            if last is not None:
                over = quiet(out, run, last, ts, False, reported, beat, stale)
            if not over:
                last, reported = ts, reported or kind == "report"
                if kind in watch.TERMINAL:
                    over = True
                    out.append((run, ts, "ended", kind))
        if not over and last is not None:
            quiet(out, run, last, until, True, reported, beat, stale)
    return sorted(out, key=str)


def quiet(out, run, last, end, closed, reported, beat, stale):
    at = last + timedelta(seconds=beat)
    while at < last + timedelta(seconds=stale) and (at < end or closed and at == end):
        out.append((run, at, "heartbeat", None))
        at += timedelta(seconds=beat)
    if end - last > timedelta(seconds=stale):
        out.append((run, last + timedelta(seconds=stale), "stale", watch.REPORTED if reported else watch.TIMED_OUT))
        return True
    return False


@pytest.fixture(scope="module")
def log():
    draw = random.Random(5)
    rows, n = [], 0
    for run in range(12):
        at = START + timedelta(seconds=draw.randint(0, 100))
        for _ in range(draw.randint(3, 40)):
            rows.append((f"r{run}", at, n, draw.choice(["step"] * 14 + ["report", "completed"])))
            n += 1
            at += timedelta(seconds=draw.choice([0, 3, 15, 15, 20, 47, 47, 100] + [600, 601] * (run % 3 == 0)), microseconds=draw.choice([0, 1, 999]))
    rows += [(None, START, n, "step"), ("r1", None, n + 1, "step"), ("r20", START, n + 2, "step")]
    return rows


def listed(df):
    return sorted((tuple(r) for r in df.select("run", "at", "kind", "status").collect()), key=str)


def test_batch_against_plain_rule(spark, log):
    for until in (START + timedelta(seconds=400), START + timedelta(hours=3)):
        got = listed(watch.watched(spark.createDataFrame(log, TABLE), "run", F.lit(until)))
        assert got == plain(log, until, 15, 600)
        assert {"heartbeat", "stale", "ended"} == {r[2] for r in got} or until < START + timedelta(hours=1)
    assert watch.watched(spark.createDataFrame([], TABLE), "run", F.lit(START)).count() == 0


def test_stream_with_restart_against_plain_rule(spark, log, tmp_path):
    """Files in order of time but shuffled inside two minutes; the query stops half-way and
    goes on from its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    draw = random.Random(1)
    order = sorted(log, key=lambda r: (r[1] or START) + timedelta(seconds=draw.uniform(0, 110)))
    parts = [order[i::1][: len(order) // 6 + 1] for i in range(0, len(order), len(order) // 6 + 1)]
    source, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def add(rows):
        spark.createDataFrame(rows, TABLE).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(TABLE).option("maxFilesPerTrigger", 1).parquet(source)
        found = watch.watch_stream(stream, "run", "2 minutes")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for rows in parts[:3]:
        add(rows)
    run()
    half = spark.read.parquet(out).count()
    for rows in parts[3:]:
        add(rows)
    run()
    until = max(r[1] for r in log if r[0] and r[1]) - timedelta(minutes=2)
    until -= timedelta(microseconds=until.microsecond % 1000)
    got = listed(spark.read.parquet(out))
    assert got == plain(log, until, 15, 600)
    assert 0 < half < len(got)


def test_recovered(spark):
    runs = spark.createDataFrame([("a", "running", True), ("b", "running", False), ("c", "running", None), ("d", "completed", False), ("e", "running", True), ("f", "running", True)], "run_id string, status string, has_report boolean")
    e = spark.createDataFrame([("a", START), ("b", START), ("e", START + timedelta(seconds=1)), ("f", None), (None, START)], "run_id string, ts timestamp")
    got = {r.run_id: r for r in watch.recovered(runs, e, F.lit(START + timedelta(seconds=601))).collect()}
    assert {k: r.new_status for k, r in got.items()} == {"a": watch.REPORTED, "b": watch.TIMED_OUT, "c": watch.TIMED_OUT, "f": watch.REPORTED}
    assert got["a"].error is None and got["c"].last_event_at is None and "600" in got["b"].error


def test_contract(spark):
    rows = [
        {"detail": "x" * 201, "stdout": "secret", "step": "s1", "other": {"a": 1}},
        {"detail": "short", "status": "failed"},
        {"detail": "short", "status": "failed", "log_ref": "own.log", "full_output": "y"},
        {"status": "failed", "detail": ""},
        {"detail": None, "summary": "old", "key": "k", "step": "s"},
    ]
    texts = [json.dumps(r) for r in rows] + ["no json", None, "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "event_id long, payload string").withColumn("detail", F.lit("clash"))
    shown, logs = events.contract(df)
    got = {r.event_id: r for r in shown.collect()}
    assert len(got) == len(texts)
    assert [got[i].log_ref for i in range(8)] == ["logs/s1_0.log", "logs/unknown_1.log", "own.log", None, None, None, None, None]
    assert got[0].detail == got[0].summary == "x" * 200 and got[0].other == {"step": "s1", "other": '{"a":1}'}
    assert got[2].other == {"status": "failed"} and got[4].detail == "" and got[5].other == {}
    assert {(r.log_ref, r.text) for r in logs.collect()} == {("logs/s1_0.log", "x" * 201), ("logs/unknown_1.log", "short")}


def test_offset_pairs_against_all_pairs(spark):
    draw = random.Random(3)
    rows = [(s, r, draw.randint(0, 9)) for s in "ab" for r in draw.sample(range(-40, 400), 150)] + [("a", None, 1), ("b", 401, None), ("b", 402, 7)]
    got = sorted((tuple(r) for r in offsets.offset_pairs(spark.createDataFrame(rows, "s string, row int, v long"), ["s"], "v", 13).collect()), key=str)
    want = sorted(((s, r, q - r, v, w) for s, r, v in rows for t, q, w in rows if s == t and r is not None and q is not None and 1 <= q - r <= 13), key=str)
    assert got == want and len(want) > 1000
