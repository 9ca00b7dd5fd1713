"""Queries: streams over the events table, run to its end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from snapledger.plans.registry import query
from snapledger.streaming import monitor


def _events(x):
    schema = x.spark.read.parquet(f"{x.sf_dir}/events.parquet").schema
    folder, _, _ = f"{x.sf_dir}/events.parquet".rpartition("/")
    return x.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _drain(x, stream, mode, key=None):
    base = x.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not x.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="streams")
    return monitor.drain(stream, f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}", mode, key)


@query("X02_hourly_levels", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS level, count(*) AS n FROM events GROUP BY ALL", ctes=False)
def _(x):
    e = _events(x).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("level"))
    t = _drain(x, monitor.events_by_window(e), "update", ["start", "level"])
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "level", "n")


@query("X03_alerts_on_change", """, l AS (SELECT user_id AS host, ts, event_type AS status, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type), 'OK') AS before FROM events)
SELECT host, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, before, status FROM l WHERE before <> status""")
def _(x):
    e = _events(x).select(F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    t = _drain(x, monitor.alerts_on_change(e), "append")
    return t.select("host", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "before", "status")


@query("X05_run_states", ", e AS (SELECT user_id AS run_id, ts, CASE WHEN event_type = 'purchase' THEN 'end' ELSE 'start' END AS kind, event_type AS status FROM events) SELECT run_id, strftime(min(ts), '%Y-%m-%d') AS started, coalesce(max(status) FILTER (kind = 'end'), 'RUNNING') AS status FROM e GROUP BY run_id")
def _(x):
    e = _events(x).select(F.col("user_id").alias("run_id"), "ts", F.when(F.col("event_type") == "purchase", "end").otherwise("start").alias("kind"), F.col("event_type").alias("status"))
    t = _drain(x, monitor.run_states(e), "update", ["run_id"])
    return t.select("run_id", F.date_format("started", "yyyy-MM-dd").alias("started"), "status")


@query("X07_fresh_entries", ", l AS (SELECT user_id AS path, max(ts) AS ts FROM events GROUP BY 1) SELECT path FROM l WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY")
def _(x):
    e = x.spark.read.parquet(f"{x.sf_dir}/events.parquet").select(F.col("user_id").alias("path"), "ts", "event_id")
    return monitor.fresh(e, "2024-01-20 00:00:00", seconds=10 * 86400).select("path")
