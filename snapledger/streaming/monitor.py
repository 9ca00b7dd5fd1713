"""Streams over logs and states."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def alerts_on_change(states: DataFrame) -> DataFrame:
    """Of a stream (host, ts, status), the rows whose status differs from the host's last one; a first row counts unless OK."""

    def step(key: tuple, batches, state: GroupState):
        (last,) = state.get if state.exists else ("OK",)
        # a host's rows come in pieces of no order: those of one trigger are sorted together
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "status"], kind="stable", ignore_index=True)
        before = pdf["status"].shift(1)
        before.iloc[0] = last
        changed = pdf[before != pdf["status"]]
        state.update((pdf["status"].iloc[-1],))
        yield pd.DataFrame({"host": key[0], "ts": changed["ts"], "before": before[changed.index], "status": changed["status"]})

    return states.select("host", "ts", "status").groupBy("host").applyInPandasWithState(
        step, f"host {dict(states.dtypes)['host']}, ts {dict(states.dtypes)['ts']}, before string, status string", "last string", "append", GroupStateTimeout.NoTimeout
    )


def events_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by level and event-time window, late rows up to ``late`` included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "level").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "level", "n")


def run_states(events: DataFrame) -> DataFrame:
    """State of each run from its start and end events: RUNNING until an end arrives."""
    t = events.groupBy("run_id").agg(F.min("ts").alias("started"), F.max(F.when(F.col("kind") == "end", F.col("ts"))).alias("finished"), F.max(F.when(F.col("kind") == "end", F.col("status"))).alias("status"))
    return t.select("run_id", "started", "finished", F.coalesce("status", F.lit("RUNNING")).alias("status"))


def drain(stream: DataFrame, folder: str, mode: str, key: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is available; its results are written as Parquet below ``folder``, its offsets kept there too.

    In update mode a row of ``key`` counts as its last trigger left it. Nothing is held by the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/trigger={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).option("basePath", f"{folder}/rows").option("recursiveFileLookup", False).parquet(f"{folder}/rows/*")
    if mode != "update":
        return rows.drop("trigger")
    rest = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "trigger").alias("r")).select(*key, "r.*")


def keep_running(stream: DataFrame, folder: str, write, every: str = "15 minutes", mode: str = "update"):
    """Start a stream that works every so often and goes on where it stopped: offsets and state are kept under ``folder``."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/offsets").trigger(processingTime=every).foreachBatch(write).start()


def fresh(entries: DataFrame, now: str, key: str = "path", seconds: int = 3600) -> DataFrame:
    """Of cached rows (key, ts, ...), the last of each key, if it is not older than ``seconds`` at ``now``."""
    rest = [c for c in entries.columns if c != key]
    last = entries.groupBy(key).agg(F.max_by(F.struct(*rest), "ts").alias("r")).select(key, "r.*")
    return last.filter(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= seconds * 1_000_000)
