"""Run history: listings, statistics, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GB = float(1024**3)


def since(as_of: str, days: int) -> Column:
    return F.expr(f"started_at >= TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAY")


def _gb(c: str) -> Column:
    return F.round(F.col(c) / F.lit(GB), 2)


def recent(runs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return runs.filter(since(as_of, days)).select("run_id", "snapshot_name", "status", "duration_sec", F.round(F.col("duration_sec") / 60.0, 2).alias("minutes"), _gb("bytes_uploaded").alias("gb"))


def newest(runs: DataFrame, n: int) -> DataFrame:
    t = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)
    return t.select("run_id", "snapshot_name", "status", F.date_format("started_at", "dd.MM.yyyy HH:mm").alias("started"), _gb("bytes_uploaded").alias("gb"))


def failed(runs: DataFrame, as_of: str, days: int = 7, n: int | None = None) -> DataFrame:
    t = runs.filter((F.col("status") == "FAILED") & since(as_of, days))
    t = t.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n) if n else t
    return t.select("run_id", "snapshot_name", F.substring("error_message", 1, 50).alias("error"))


def performance(runs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    one = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s.lower())
    return runs.filter(since(as_of, days)).agg(
        F.count(F.lit(1)).alias("total"), one("SUCCESS"), one("FAILED"), F.round(F.avg("duration_sec") / 60, 2).alias("avg_minutes"),
        F.round(F.sum("bytes_uploaded") / F.lit(GB), 2).alias("gb"), F.sum("gap_backfill_mode").alias("gap_backfills"),
    )


def phase_stats(phases: DataFrame, runs: DataFrame, as_of: str, order: tuple[str, ...], days: int = 30) -> DataFrame:
    """By phase, numbered in the declared order."""
    t = phases.join(runs.filter(since(as_of, days)).select("run_id"), "run_id", "left_semi").groupBy("phase_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == "FAILED").cast("long")).alias("failed"), F.round(F.avg("duration_sec"), 1).alias("avg_sec"), F.max("duration_sec").alias("max_sec")
    )
    return t.withColumn("seq", F.array_position(F.array(*[F.lit(p) for p in order]), F.col("phase_name")))


def current(runs: DataFrame, as_of: str) -> DataFrame:
    last = runs.filter("status = 'RUNNING'").orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)
    return last.select("run_id", "snapshot_name", F.expr(f"timestampdiff(SECOND, started_at, TIMESTAMP_NTZ '{as_of}')").alias("elapsed_sec"))


def latest_phases(runs: DataFrame, phases: DataFrame) -> DataFrame:
    last = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1).select("run_id", "snapshot_name")
    return phases.join(F.broadcast(last), "run_id").select("run_id", "snapshot_name", "phase_name", F.col("p").cast("long").alias("p"), phases["status"], "duration_sec")


def last_success(runs: DataFrame, as_of: str) -> DataFrame:
    t = runs.filter("status = 'SUCCESS'").agg(F.max_by(F.struct("run_id", "snapshot_name", "started_at"), F.struct("started_at", "run_id")).alias("r"))
    return t.select("r.run_id", "r.snapshot_name", F.expr(f"timestampdiff(HOUR, r.started_at, TIMESTAMP_NTZ '{as_of}')").alias("age_hours"))


def trend(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.date_format("started_at", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == "SUCCESS").cast("long")).alias("success"), F.sum("bytes_uploaded").alias("bytes"), F.round(F.avg("duration_sec"), 2).alias("avg_sec")
    )


def share(runs: DataFrame, by: str) -> DataFrame:
    """Rows by value and their share of all in percent."""
    t = runs.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


def gap_kpis(runs: DataFrame, gaps: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    per = gaps.groupBy("run_id").agg(F.count(F.lit(1)).alias("gaps"))
    t = runs.filter(since(as_of, days)).join(per, "run_id", "left")
    return t.agg(F.sum("gaps").alias("gaps"), F.round(F.avg(F.coalesce("gaps", F.lit(0))), 4).alias("avg_gaps"), F.count(F.lit(1)).alias("runs"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose key ``parent`` does not have (a violated foreign key)."""
    return child.join(parent.select(key), key, "left_anti")


def latest_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key: append-only events folded into a state."""
    cols = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")


def backfilled(runs: DataFrame, name: str, prefix: str = "backfill-") -> DataFrame:
    """Of the runs whose ``name`` begins with ``prefix``: how many, how many successful and failed."""
    t = runs.filter(F.startswith(name, F.lit(prefix)))
    return t.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "SUCCESS").alias("success"), F.count_if(F.col("status") == "FAILED").alias("failed"))
