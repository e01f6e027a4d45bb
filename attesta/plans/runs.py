"""Run-event queries on the events table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators.findings import latest
from attesta.plans.sheets import read
from attesta.streaming import events as ops
from attesta.streaming import watch


def _stale(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    clock = e.agg(F.max("ts").alias("now"))
    return ops.staleness(e.crossJoin(F.broadcast(clock)), ["user_id", "now"], F.col("now")).select("user_id", "last_event_at", "n_events", "stale")


def _latest_run(spark, sf_dir):
    """Each customer with the latest of its orders, if any."""
    last = latest(read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return read(spark, sf_dir, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")


def _watched(spark, sf_dir):
    """Users as runs: half-hour heartbeats, given up after four hours; a purchase ends one."""
    e = read(spark, sf_dir, "events")
    clock = e.agg(F.max("ts").alias("now"))
    return watch.watched(e.crossJoin(F.broadcast(clock)), "user_id", F.col("now"), 1800, 14_400, ("purchase",), ("signup",))


def _recovered(spark, sf_dir):
    """Customers as runs, some without an event; a run with a finished order has a report."""
    e = read(spark, sf_dir, "events").withColumnRenamed("user_id", "run_id")
    reports = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("run_id"), F.lit(True).alias("has_report")).distinct()
    runs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'completed' ELSE 'running' END").alias("status"))
    clock = e.agg(F.max("ts").alias("now"))
    return watch.recovered(runs.join(reports, "run_id", "left").crossJoin(F.broadcast(clock)), e, F.col("now"), seconds=7200)


def _logged(spark, sf_dir):
    """Documents as the details of progress events; every seventh failed."""
    fields = {"detail": F.col("text"), "stdout": F.col("source"), "traceback": F.lit("x"), "key": F.col("lang"), "status": F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("done"), "log_ref": F.when(F.col("doc_id") % 14 == 0, "kept.log")}
    docs = read(spark, sf_dir, "documents")
    return ops.contract(docs.select(F.col("doc_id").alias("event_id"), F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("payload")))


def _contract(spark, sf_dir):
    return _logged(spark, sf_dir)[0].select("event_id", "detail", "summary", "log_ref", F.array_join(F.array_sort(F.map_keys("other")), ",").alias("other"))


QUERIES = {
    "event_canonical": lambda s, d: ops.canonical(read(s, d, "events"), limit=8),
    "event_replay": lambda s, d: ops.replay(read(s, d, "events"), 100, buffer=1000),
    "stale_runs": _stale,
    "status_metrics": lambda s, d: ops.status_counts(read(s, d, "events")).join(ops.status_users(read(s, d, "events")), "event_type"),
    "event_windows": lambda s, d: ops.tumbling(read(s, d, "events")).withColumn("total", F.round("total", 4)),
    "event_sessions": lambda s, d: ops.sessions(read(s, d, "events"), "6 hours"),
    "heartbeat_gaps": lambda s, d: ops.heartbeat_gaps(read(s, d, "events"), seconds=3600),
    "latest_run_join": _latest_run,
    "watched_runs": _watched,
    "recovered_runs": _recovered,
    "event_contract": _contract,
    "event_logs": lambda s, d: _logged(s, d)[1].select("log_ref", F.sha2("text", 256).alias("text_sha")),
}

SQL = {
    "event_canonical": "SELECT event_id, ts, user_id, event_type, substr(props, 1, 8) AS detail, coalesce(length(props), 0) > 8 AS truncated FROM events",
    "event_replay": "SELECT * FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 1000) WHERE event_id > 100",
    "stale_runs": "SELECT user_id, max(ts) AS last_event_at, count(*) AS n_events, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) > 600 * 1000000 AS stale FROM events GROUP BY user_id",
    "status_metrics": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        n AS (SELECT user_id, ts, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM n GROUP BY user_id, s""",
    "heartbeat_gaps": """WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000 AS pause FROM events)
        SELECT user_id, count(*) AS n_gaps, max(pause) AS longest FROM g WHERE pause > 3600 GROUP BY user_id""",
    "latest_run_join": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
        SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN r ON c_custkey = o_custkey AND rn = 1""",
    "watched_runs": """WITH RECURSIVE e AS (
            SELECT user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, (SELECT epoch_us(max(ts)) FROM events) AS clock
            FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
        alive AS (
            SELECT user_id, i, event_type, us, clock, event_type = 'signup' AS reported FROM e WHERE i = 1
            UNION ALL
            SELECT e.user_id, e.i, e.event_type, e.us, e.clock, a.reported OR e.event_type = 'signup'
            FROM alive a JOIN e ON e.user_id = a.user_id AND e.i = a.i + 1 WHERE a.event_type <> 'purchase' AND e.us - a.us <= 14400000000),
        met AS (SELECT a.*, n.us AS later FROM alive a LEFT JOIN e n ON n.user_id = a.user_id AND n.i = a.i + 1)
        SELECT user_id, make_timestamp(us + k * 1800000000) AS at, 'heartbeat' AS kind, NULL AS status
        FROM met, range(1, 8) t(k) WHERE event_type <> 'purchase' AND CASE WHEN later IS NULL THEN us + k * 1800000000 <= clock ELSE us + k * 1800000000 < later END
        UNION ALL SELECT user_id, make_timestamp(us), 'ended', event_type FROM met WHERE event_type = 'purchase'
        UNION ALL SELECT user_id, make_timestamp(us + 14400000000), 'stale', CASE WHEN reported THEN 'completed_with_warnings' ELSE 'failed_timeout' END
        FROM met WHERE event_type <> 'purchase' AND coalesce(later, clock) - us > 14400000000""",
    "recovered_runs": """WITH l AS (SELECT user_id, max(ts) AS last_event_at FROM events GROUP BY user_id),
        f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
        SELECT c_custkey AS run_id, 'running' AS previous_status, CASE WHEN o_custkey IS NULL THEN 'failed_timeout' ELSE 'completed_with_warnings' END AS new_status, o_custkey IS NOT NULL AS had_report,
               last_event_at, CASE WHEN o_custkey IS NULL THEN 'no event for more than 7200 s' END AS error
        FROM customer LEFT JOIN l ON user_id = c_custkey LEFT JOIN f ON o_custkey = c_custkey
        WHERE c_custkey % 3 <> 0 AND (last_event_at IS NULL OR (SELECT max(ts) FROM events) - last_event_at > INTERVAL 7200 SECOND)""",
    "event_contract": """SELECT doc_id AS event_id, coalesce(substr(text, 1, 200), '') AS detail, coalesce(substr(text, 1, 200), '') AS summary,
            CASE WHEN length(text) > 200 OR doc_id % 7 = 0 AND doc_id % 14 <> 0 AND text <> '' THEN 'logs/' || coalesce(lang, 'unknown') || '_' || doc_id || '.log' WHEN doc_id % 14 = 0 THEN 'kept.log' END AS log_ref,
            CASE WHEN lang IS NULL THEN 'status' ELSE 'key,status' END AS other FROM documents""",
    "event_logs": """SELECT 'logs/' || coalesce(lang, 'unknown') || '_' || doc_id || '.log' AS log_ref, sha256(text) AS text_sha FROM documents
        WHERE length(text) > 200 OR doc_id % 7 = 0 AND doc_id % 14 <> 0 AND text <> ''""",
}
