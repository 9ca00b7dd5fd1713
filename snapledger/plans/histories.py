"""Queries: run history, status and their stream twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.operators import history, status
from snapledger.plans.registry import query
from snapledger.sources.fixtures import AS_OF, PHASES, table

_T = f"TIMESTAMP '{AS_OF}'"
_GB = "1073741824.0::DOUBLE"


@query("R01_recent_runs", f"SELECT run_id, snapshot_name, status, duration_sec, round(duration_sec / 60.0::DOUBLE, 2) AS minutes, round(bytes_uploaded / {_GB}, 2) AS gb FROM backup_run WHERE started_at >= {_T} - INTERVAL 30 DAY")
def _(x):
    return history.recent(x.runs, AS_OF)


@query("R02_newest_runs", f"SELECT run_id, snapshot_name, status, strftime(started_at, '%d.%m.%Y %H:%M') AS started, round(bytes_uploaded / {_GB}, 2) AS gb FROM backup_run ORDER BY started_at DESC, run_id DESC LIMIT 20")
def _(x):
    return history.newest(x.runs, 20)


@query("R03_failed_runs", f"SELECT run_id, snapshot_name, substr(error_message, 1, 50) AS error FROM backup_run WHERE status = 'FAILED' AND started_at >= {_T} - INTERVAL 7 DAY")
def _(x):
    return history.failed(x.runs, AS_OF)


@query("L02_newest_failures", f"SELECT run_id, snapshot_name, substr(error_message, 1, 50) AS error FROM backup_run WHERE status = 'FAILED' AND started_at >= {_T} - INTERVAL 7 DAY ORDER BY started_at DESC, run_id DESC LIMIT 20")
def _(x):
    return history.failed(x.runs, AS_OF, n=20)


@query(
    "R04_performance",
    f"SELECT count(*) AS total, sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END)::BIGINT AS success, sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END)::BIGINT AS failed, round(avg(duration_sec) / 60, 2) AS avg_minutes, round(sum(bytes_uploaded)::DOUBLE / {_GB}, 2) AS gb, sum(gap_backfill_mode)::BIGINT AS gap_backfills FROM backup_run WHERE started_at >= {_T} - INTERVAL 30 DAY",
)
def _(x):
    return history.performance(x.runs, AS_OF)


_LIST = "[" + ", ".join(f"'{p}'" for p in PHASES) + "]"


@query(
    "R05_phase_stats",
    f"SELECT phase_name, count(*) AS n, sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END)::BIGINT AS failed, round(avg(duration_sec), 1) AS avg_sec, max(duration_sec) AS max_sec, list_position({_LIST}, phase_name)::BIGINT AS seq FROM backup_phase WHERE run_id IN (SELECT run_id FROM backup_run WHERE started_at >= {_T} - INTERVAL 30 DAY) GROUP BY phase_name",
)
def _(x):
    return history.phase_stats(x.phases, x.runs, AS_OF, PHASES)


@query("R06_current_run", f"SELECT run_id, snapshot_name, datediff('second', started_at, {_T}) - CASE WHEN started_at > {_T} THEN 0 ELSE CASE WHEN (epoch_us(started_at) % 1000000) > 0 THEN 1 ELSE 0 END END AS elapsed_sec FROM backup_run WHERE status = 'RUNNING' ORDER BY started_at DESC, run_id DESC LIMIT 1")
def _(x):
    return history.current(x.runs, AS_OF)


@query("J16_latest_phases", ", r AS (SELECT run_id, snapshot_name FROM backup_run ORDER BY started_at DESC, run_id DESC LIMIT 1) SELECT p.run_id, snapshot_name, phase_name, p.p::BIGINT AS p, p.status, duration_sec FROM backup_phase p JOIN r ON p.run_id = r.run_id")
def _(x):
    return history.latest_phases(x.runs, x.phases)


@query("R07_last_success", f"SELECT run_id, snapshot_name, ((epoch_us({_T}) - epoch_us(started_at)) // 3600000000)::BIGINT AS age_hours FROM backup_run WHERE status = 'SUCCESS' ORDER BY started_at DESC, run_id DESC LIMIT 1")
def _(x):
    return history.last_success(x.runs, AS_OF)


@query("A16_daily_trend", "SELECT strftime(started_at, '%Y-%m-%d') AS day, count(*) AS n, sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END)::BIGINT AS success, sum(bytes_uploaded)::BIGINT AS bytes, round(avg(duration_sec), 2) AS avg_sec FROM backup_run GROUP BY 1")
def _(x):
    return history.trend(x.runs)


@query("A17_status_share", "SELECT status, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS share FROM backup_run GROUP BY status")
def _(x):
    return history.share(x.runs, "status")


@query("A18_gap_kpis", f", g AS (SELECT run_id, count(*) AS gaps FROM gap_backfill GROUP BY run_id) SELECT sum(gaps)::BIGINT AS gaps, round(avg(coalesce(gaps, 0)), 4) AS avg_gaps, count(*) AS runs FROM backup_run r LEFT JOIN g ON r.run_id = g.run_id WHERE started_at >= {_T} - INTERVAL 30 DAY")
def _(x):
    return history.gap_kpis(x.runs, x.gaps, AS_OF)


@query("R12_orphan_phases", "SELECT id, run_id FROM backup_phase WHERE run_id NOT IN (SELECT run_id FROM backup_run WHERE run_id % 10 <> 3)")
def _(x):
    return history.orphans(x.phases, x.runs.filter("run_id % 10 <> 3"), "run_id").select("id", "run_id")


@query("R12_counts_by_status", "SELECT status, gap_backfill_mode, count(*) AS n FROM backup_run WHERE snapshot_name LIKE 'snap-1%' GROUP BY ALL")
def _(x):
    return x.runs.filter("snapshot_name LIKE 'snap-1%'").groupBy("status", "gap_backfill_mode").agg(F.count(F.lit(1)).alias("n"))


@query("R13_gap_events", "SELECT g.id, g.gap_snapshot_name, r.status, g.bytes_uploaded FROM gap_backfill g JOIN backup_run r ON g.run_id = r.run_id")
def _(x):
    return x.gaps.join(x.runs.select("run_id", "status"), "run_id").select("id", "gap_snapshot_name", "status", "bytes_uploaded")


@query("R14_purge_preview", f"SELECT status, count(*) AS n, strftime(min(started_at), '%Y-%m-%d') AS oldest FROM backup_run WHERE started_at < {_T} - INTERVAL 14 DAY GROUP BY status")
def _(x):
    old = x.runs.filter(F.expr(f"started_at < TIMESTAMP_NTZ '{AS_OF}' - INTERVAL 14 DAY"))
    return old.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("started_at"), "yyyy-MM-dd").alias("oldest"))


@query("W06_latest_per_snapshot", "SELECT snapshot_name, arg_max(run_id, (started_at, run_id)) AS run_id, arg_max(status, (started_at, run_id)) AS status FROM backup_run GROUP BY snapshot_name")
def _(x):
    return history.latest_state(x.runs.select("snapshot_name", "run_id", "status", "started_at"), "snapshot_name", ["started_at", "run_id"]).select("snapshot_name", "run_id", "status")


_CODE = "CASE status WHEN 'FAILED' THEN 2 WHEN 'RUNNING' THEN 1 ELSE 0 END"


def _code():
    return F.when(F.col("status") == "FAILED", 2).when(F.col("status") == "RUNNING", 1).otherwise(0)


@query("R10_severity", f"SELECT snapshot_name AS host, max({_CODE})::BIGINT AS worst, count(*) FILTER ({_CODE} > 0) AS n_bad, CASE max({_CODE}) WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'OK' END AS overall FROM backup_run GROUP BY 1")
def _(x):
    return status.severity(x.runs.select(F.col("snapshot_name").alias("host"), _code().alias("status")))


@query(
    "R09_roll_up",
    """, c AS (SELECT run_id, run_id % 3 AS sync, CASE run_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'ok' END AS job, run_id % 5 // 4 AS failed FROM backup_run)
SELECT run_id, CASE WHEN sync = 2 OR job = 'failed' THEN 'CRITICAL' WHEN failed > 0 THEN 'WARNING' WHEN job = 'running' THEN 'RUNNING' WHEN sync = 1 THEN 'WARNING' ELSE 'OK' END AS status, CASE WHEN sync = 2 OR job = 'failed' THEN 2 WHEN failed > 0 OR sync = 1 THEN 1 ELSE 0 END AS code FROM c""",
)
def _(x):
    r = F.col("run_id")
    job = F.when(r % 4 == 0, "failed").when(r % 4 == 1, "running").otherwise("ok")
    s, c = status.roll_up(r % 3, job, F.floor(r % 5 / 4))
    return x.runs.select("run_id", s.alias("status"), c.alias("code"))


_CHANGES = """, l AS (SELECT snapshot_name AS host, run_id, CASE WHEN status = 'SUCCESS' THEN 'OK' ELSE status END AS status, lag(CASE WHEN status = 'SUCCESS' THEN 'OK' ELSE status END) OVER (PARTITION BY snapshot_name ORDER BY started_at, run_id) AS before FROM backup_run)
SELECT host, run_id, status, before FROM l WHERE coalesce(before <> status, status <> 'OK')"""


@query("W05_status_changes", _CHANGES)
def _(x):
    t = x.runs.select(F.col("snapshot_name").alias("host"), "run_id", "started_at", F.when(F.col("status") == "SUCCESS", "OK").otherwise(F.col("status")).alias("status"))
    return status.changes(t, "host", ["started_at", "run_id"]).select("host", "run_id", "status", "before")


_RULES = [("aborted", "error", 30), ("success", "purchase", 20), ("skipped", "click", 20), ("started", "signup", 20)]


@query(
    "R11_log_state",
    """, e AS (SELECT user_id AS host, event_type AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events)
SELECT host, CASE WHEN bool_or(line = 'error' AND back <= 30) THEN 'aborted' WHEN bool_or(line = 'purchase' AND back <= 20) THEN 'success' WHEN bool_or(line = 'click' AND back <= 20) THEN 'skipped' WHEN bool_or(line = 'signup' AND back <= 20) THEN 'started' ELSE 'unknown' END AS state FROM e WHERE back <= 30 GROUP BY host""",
)
def _(x):
    e = table(x.spark, x.sf_dir, "events").select(F.col("user_id").alias("host"), F.col("event_type").alias("line"), F.col("event_id").alias("n"))
    return status.log_state(e, _RULES)


@query("S14_log_tail", ", t AS (SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 200) SELECT event_type, count(*) AS n FROM t GROUP BY event_type")
def _(x):
    tail = table(x.spark, x.sf_dir, "events").orderBy(F.desc("event_id")).limit(200)
    return tail.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("P08_log_predicates", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup') AND regexp_matches(props, '[0-9]')", ctes=False)
def _(x):
    return table(x.spark, x.sf_dir, "events").filter(F.col("event_type").isin("error", "signup") & F.regexp_like("props", F.lit("[0-9]"))).select("event_id", "event_type")


@query("R08_age_check", "SELECT snapshot_name, CASE WHEN s IS NULL THEN 'WARNING' WHEN s <> m THEN 'CRITICAL' ELSE 'OK' END AS state FROM (SELECT snapshot_name, max(run_id) AS m, max(run_id) FILTER (status = 'SUCCESS') AS s FROM backup_run GROUP BY snapshot_name)")
def _(x):
    t = x.runs.groupBy("snapshot_name").agg(F.max("run_id").alias("m"), F.max(F.when(F.col("status") == "SUCCESS", F.col("run_id"))).alias("s"))
    return t.select("snapshot_name", status.age_check(F.col("m"), F.col("s")).alias("state"))


@query(
    "R15_explain_services",
    """, v AS (SELECT run_id // 7 AS host, 'svc' || run_id % 7 AS service, CASE WHEN run_id % 6 = 0 THEN 'failed' WHEN run_id % 6 = 1 THEN 'inactive' WHEN run_id % 6 = 2 THEN 'blocked' ELSE 'ok' END AS status FROM backup_run)
SELECT host, coalesce(string_agg(CASE WHEN status = 'failed' THEN service END, ', ' ORDER BY service), '') AS failed, coalesce(string_agg(CASE WHEN status = 'inactive' THEN service END, ', ' ORDER BY service), '') AS inactive, count(*) FILTER (status = 'blocked') AS n_blocked FROM v GROUP BY host""",
)
def _(x):
    r = F.col("run_id")
    v = x.runs.select(F.expr("run_id div 7").alias("host"), F.concat(F.lit("svc"), r % 7).alias("service"), F.when(r % 6 == 0, "failed").when(r % 6 == 1, "inactive").when(r % 6 == 2, "blocked").otherwise("ok").alias("status"))
    return status.explain(v)


@query("A13_conditional_counts", "SELECT status, sum(CASE WHEN duration_sec > 3000 THEN 1 ELSE 0 END)::BIGINT AS slow, sum(CASE WHEN gap_backfill_mode = 1 THEN 1 ELSE 0 END)::BIGINT AS gaps FROM backup_run GROUP BY status")
def _(x):
    return x.runs.groupBy("status").agg(F.sum((F.coalesce("duration_sec", F.lit(0)) > 3000).cast("long")).alias("slow"), F.sum((F.col("gap_backfill_mode") == 1).cast("long")).alias("gaps"))


@query("F25_success_rate", "SELECT snapshot_name, printf('%.1f%%', round_even(count(*) FILTER (status = 'SUCCESS') * 100.0::DOUBLE / count(*), 1)) AS rate FROM backup_run GROUP BY snapshot_name")
def _(x):
    t = x.runs.groupBy("snapshot_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "SUCCESS").alias("s"))
    return t.select("snapshot_name", F.format_string("%.1f%%", F.bround(F.col("s") * 100.0 / F.col("n"), 1)).alias("rate"))


@query(
    "F23_log_fields",
    """, l AS (SELECT run_id, CASE run_id % 3 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'YELLOW' ELSE 'RED' END AS c FROM backup_run) SELECT run_id, CASE WHEN run_id % 2 = 0 THEN '2024-01-02 03:04:05' END AS at, c AS gate,
CASE WHEN run_id % 5 <> 0 THEN c END AS nas, c AS nas_av, CASE WHEN run_id % 7 = 0 THEN 'ALARM' WHEN run_id % 7 = 1 THEN 'OK' END AS honeyfiles FROM l""",
)
def _(x):
    r = F.col("run_id")
    c = F.when(r % 3 == 0, "GREEN").when(r % 3 == 1, "YELLOW").otherwise("RED")
    line = F.concat(
        F.when(r % 2 == 0, "2024-01-02 03:04:05 ").otherwise(""), F.lit("SAFETY-GATE: "), c, F.when(r % 5 != 0, F.concat(F.lit(" | nas: "), c)).otherwise(""), F.lit(" | nas-av: "), c,
        F.when(r % 7 == 0, " Honeyfile-ALARM").when(r % 7 == 1, " Honeyfiles: none touched").otherwise(""),
    )
    return x.runs.select("run_id", F.inline(F.array(status.log_fields(line))))


@query("P10_backfilled_runs", "SELECT count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'FAILED') AS failed FROM backup_run WHERE gap_backfill_mode = 1")
def _(x):
    named = x.runs.withColumn("name", F.concat(F.when(F.col("gap_backfill_mode") == 1, "backfill-").otherwise("run-"), "run_id"))
    return history.backfilled(named, "name")
