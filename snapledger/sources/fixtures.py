"""The ledger's tables derived from the driver's parquet tables, for Spark and as SQL for DuckDB.

``Ledger`` gives DataFrames; ``WITH`` holds the same tables as common table expressions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SNAPSHOTS = ("2024-01-01-000000", "2024-01-08-000000", "2024-01-15-000000", "2024-01-22-000000", "2024-01-29-000000")
ROOT = "/B/_snapshots"
AS_OF = "2024-01-31 00:00:00"
PHASES = ("manifest", "upload", "retention", "verify", "index")

_VALUES = ", ".join(f"({k}, '{s}')" for k, s in enumerate(SNAPSHOTS))

WITH = f"""WITH snap(k, snapshot) AS (VALUES {_VALUES}),
doc AS (SELECT doc_id, lang, source, n_chars, sha256(text) AS sha, sha256(concat(text, '#v2')) AS sha2nd FROM documents),
dino AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN min(doc_id) OVER (PARTITION BY sha) ELSE doc_id END AS ino0 FROM doc),
manifest_item AS (SELECT s.snapshot, d.doc_id AS ord, 'file' AS type,
  concat(d.source, '/', d.lang, '/doc_', CAST(d.doc_id AS VARCHAR), '.txt') AS relpath, '.txt' AS ext,
  CAST(d.n_chars + CASE WHEN d.doc_id % 17 = 0 AND s.k >= 2 THEN 3 ELSE 0 END AS BIGINT) AS size,
  CAST(1704067200 + d.doc_id * 60 + CASE WHEN d.doc_id % 17 = 0 AND s.k >= 2 THEN 86400 ELSE 0 END
    + CASE WHEN d.doc_id % 19 = 0 AND s.k >= 3 THEN 3600 ELSE 0 END AS DOUBLE) AS mtime,
  CASE WHEN d.doc_id % 17 = 0 AND s.k >= 2 THEN d.sha2nd ELSE d.sha END AS sha256,
  CAST(2049 AS BIGINT) AS dev, CAST(CASE WHEN d.doc_id % 17 = 0 AND s.k >= 2 THEN d.doc_id + 1000000 ELSE d.ino0 END AS BIGINT) AS ino
  FROM dino d CROSS JOIN snap s
  WHERE s.k >= CASE WHEN d.doc_id % 10 < 6 THEN 0 ELSE d.doc_id % 10 - 5 END AND s.k < CASE WHEN d.doc_id % 13 = 0 THEN 3 ELSE 99 END),
holder AS (SELECT sha256, snapshot, relpath, size, mtime, dev, ino, ext, ord,
  CAST(row_number() OVER (PARTITION BY sha256 ORDER BY snapshot, ord, relpath) - 1 AS BIGINT) AS pos FROM manifest_item),
content_node AS (SELECT sha256, anchor_path, size, rn, CASE WHEN rn % 37 = 0 THEN NULL ELSE 1000000 + rn END AS fileid,
  CASE WHEN rn % 31 = 0 THEN NULL ELSE substr(sha256, 1, 16) END AS remote_hash
  FROM (SELECT sha256, size, concat('{ROOT}/', snapshot, '/', relpath) AS anchor_path, CAST('0x' || substr(sha256, 1, 12) AS BIGINT) AS rn FROM holder WHERE pos = 0) t),
remote_object AS (
  SELECT anchor_path AS path, CASE WHEN rn % 43 = 0 THEN 6000000 + rn ELSE 1000000 + rn END AS fileid,
    CASE WHEN rn % 47 = 0 THEN concat('ffff', substr(sha256, 5, 12)) ELSE substr(sha256, 1, 16) END AS hash,
    CASE WHEN rn % 53 = 0 THEN size + 1 ELSE size END AS size FROM content_node WHERE rn % 41 <> 0
  UNION ALL SELECT concat('{ROOT}/2024-01-15-000000/stray_', CAST(rn AS VARCHAR), '.bin'), -rn, 'stray', 1 FROM content_node WHERE rn % 59 = 0
  UNION ALL SELECT concat('{ROOT}/', snapshot, '/', relpath, '.meta.json'), -1000000000000000 - ord * 10 - CAST(substr(snapshot, 10, 1) AS BIGINT), 'stub', 200 FROM holder WHERE pos > 0
  UNION ALL SELECT concat('{ROOT}/', snapshot, '/.upload_complete'), 30000000 + k, 'marker', 10 FROM snap WHERE k <> 3),
stub AS (SELECT h.snapshot, h.relpath, CASE WHEN hn % 23 = 0 THEN concat('dead', substr(h.sha256, 5)) WHEN hn % 7 = 0 THEN upper(h.sha256) ELSE h.sha256 END AS sha256,
  CASE WHEN hn % 29 = 0 THEN concat(n.anchor_path, '.old') ELSE n.anchor_path END AS anchor_path, n.fileid, h.size, h.mtime,
  concat('{ROOT}/', h.snapshot, '/', h.relpath, '.meta.json') AS stub_path
  FROM (SELECT *, ord * 5 + pos AS hn FROM holder WHERE pos > 0) h JOIN content_node n ON n.sha256 = h.sha256),
backup_run AS (SELECT event_id AS run_id, concat('snap-', CAST(user_id AS VARCHAR)) AS snapshot_name,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RUNNING' ELSE 'SUCCESS' END AS status, ts AS started_at,
  CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(floor(value * 60) AS BIGINT) END AS duration_sec,
  CAST(floor(value * 10000000) AS BIGINT) AS bytes_uploaded, CAST(floor(value * 7) AS BIGINT) AS files_uploaded,
  CAST(CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS BIGINT) AS gap_backfill_mode,
  CASE WHEN event_type = 'error' THEN props ELSE NULL END AS error_message FROM events),
phase_name(p, phase_name) AS (VALUES {", ".join(f"({k}, '{p}')" for k, p in enumerate(PHASES))}),
backup_phase AS (SELECT run_id * 10 + p AS id, run_id, phase_name, p,
  CASE WHEN status = 'FAILED' AND p = run_id % 5 THEN 'FAILED' WHEN status = 'RUNNING' AND p = 4 THEN 'RUNNING' ELSE 'SUCCESS' END AS status,
  CASE WHEN status = 'RUNNING' AND p = 4 THEN NULL ELSE (coalesce(duration_sec, 100) * (p + 1)) // 15 END AS duration_sec, files_uploaded // (p + 1) AS files_processed
  FROM backup_run CROSS JOIN phase_name),
gap_backfill AS (SELECT run_id AS id, run_id, snapshot_name AS gap_snapshot_name, started_at AS backfilled_at, bytes_uploaded FROM backup_run WHERE gap_backfill_mode = 1)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


class Ledger:
    """Lazy tables of the ledger at ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(SNAPSHOTS)), "k int, snapshot string")

    @cached_property
    def items(self) -> DataFrame:
        d = table(self.spark, self.sf_dir, "documents")
        d = d.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("sha"), F.sha2(F.concat("text", F.lit("#v2")), 256).alias("sha2nd"))
        least = d.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
        i, k = F.col("doc_id"), F.col("k")
        edited, touched = (i % 17 == 0) & (k >= 2), (i % 19 == 0) & (k >= 3)
        return (
            d.join(least, "sha").crossJoin(F.broadcast(self.snapshots))
            .filter((k >= F.when(i % 10 < 6, 0).otherwise(i % 10 - 5)) & (k < F.when(i % 13 == 0, 3).otherwise(99)))
            .select(
                "snapshot", i.alias("ord"), F.lit("file").alias("type"),
                text(F.col("source"), "/", F.col("lang"), "/doc_", i, ".txt").alias("relpath"), F.lit(".txt").alias("ext"),
                (F.col("n_chars") + F.when(edited, 3).otherwise(0)).cast("long").alias("size"),
                (F.lit(1704067200) + i * 60 + F.when(edited, 86400).otherwise(0) + F.when(touched, 3600).otherwise(0)).cast("double").alias("mtime"),
                F.when(edited, F.col("sha2nd")).otherwise(F.col("sha")).alias("sha256"),
                F.lit(2049).cast("long").alias("dev"),
                F.when(edited, i + 1000000).when(i % 2 == 0, F.col("first_id")).otherwise(i).cast("long").alias("ino"),
            )
        )

    def manifest(self, k: int) -> DataFrame:
        return self.items.filter(F.col("snapshot") == SNAPSHOTS[k])

    @cached_property
    def holders(self) -> DataFrame:
        pos = F.row_number().over(Window.partitionBy("sha256").orderBy("snapshot", "ord", "relpath")) - 1
        return self.items.select("sha256", "snapshot", "relpath", "size", "mtime", "dev", "ino", "ext", "ord", pos.cast("long").alias("pos"))

    @cached_property
    def nodes(self) -> DataFrame:
        rn = F.conv(F.substring("sha256", 1, 12), 16, 10).cast("long")
        first = F.min_by(F.struct("snapshot", "relpath", "size"), F.struct("snapshot", "ord", "relpath")).alias("f")
        t = self.items.groupBy("sha256").agg(first).withColumn("rn", rn)
        rn = F.col("rn")
        return t.select(
            "sha256", text(f"{ROOT}/", F.col("f.snapshot"), "/", F.col("f.relpath")).alias("anchor_path"), F.col("f.size").alias("size"), "rn",
            F.when(rn % 37 != 0, 1000000 + rn).alias("fileid"), F.when(rn % 31 != 0, F.substring("sha256", 1, 16)).alias("remote_hash"),
        )

    @cached_property
    def remote(self) -> DataFrame:
        n, rn = self.nodes, F.col("rn")
        files = n.filter(rn % 41 != 0).select(
            F.col("anchor_path").alias("path"), F.when(rn % 43 == 0, 6000000 + rn).otherwise(1000000 + rn).alias("fileid"),
            F.when(rn % 47 == 0, F.concat(F.lit("ffff"), F.substring("sha256", 5, 12))).otherwise(F.substring("sha256", 1, 16)).alias("hash"),
            F.when(rn % 53 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        )
        stray = n.filter(rn % 59 == 0).select(text(f"{ROOT}/2024-01-15-000000/stray_", rn, ".bin"), -rn, F.lit("stray"), F.lit(1).cast("long"))
        h = self.holders.filter("pos > 0")
        stubs = h.select(
            text(f"{ROOT}/", F.col("snapshot"), "/", F.col("relpath"), ".meta.json"),
            F.lit(-1000000000000000) - F.col("ord") * 10 - F.substring("snapshot", 10, 1).cast("long"), F.lit("stub"), F.lit(200).cast("long"),
        )
        marks = self.snapshots.filter("k <> 3").select(text(f"{ROOT}/", F.col("snapshot"), "/.upload_complete"), (F.col("k") + 30000000).cast("long"), F.lit("marker"), F.lit(10).cast("long"))
        return files.union(stray).union(stubs).union(marks)

    @cached_property
    def stubs(self) -> DataFrame:
        h = self.holders.filter("pos > 0").withColumn("hn", F.col("ord") * 5 + F.col("pos"))
        n = self.nodes.select("sha256", "anchor_path", "fileid")
        hn = F.col("hn")
        return h.join(n, "sha256").select(
            "snapshot", "relpath",
            F.when(hn % 23 == 0, F.concat(F.lit("dead"), F.substring("sha256", 5, 60))).when(hn % 7 == 0, F.upper("sha256")).otherwise(F.col("sha256")).alias("sha256"),
            F.when(hn % 29 == 0, F.concat("anchor_path", F.lit(".old"))).otherwise(F.col("anchor_path")).alias("anchor_path"),
            "fileid", "size", "mtime", text(f"{ROOT}/", F.col("snapshot"), "/", F.col("relpath"), ".meta.json").alias("stub_path"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        e, kind = table(self.spark, self.sf_dir, "events"), F.col("event_type")
        return e.select(
            F.col("event_id").alias("run_id"), text("snap-", F.col("user_id")).alias("snapshot_name"),
            F.when(kind == "error", "FAILED").when(kind == "signup", "RUNNING").otherwise("SUCCESS").alias("status"), F.col("ts").alias("started_at"),
            F.when(kind != "signup", F.floor(F.col("value") * 60)).alias("duration_sec"), F.floor(F.col("value") * 10000000).alias("bytes_uploaded"),
            F.floor(F.col("value") * 7).alias("files_uploaded"), F.when(F.col("event_id") % 20 == 0, 1).otherwise(0).cast("long").alias("gap_backfill_mode"),
            F.when(kind == "error", F.col("props")).alias("error_message"),
        )

    @cached_property
    def phases(self) -> DataFrame:
        names = self.spark.createDataFrame(list(enumerate(PHASES)), "p int, phase_name string")
        r, p = self.runs.crossJoin(F.broadcast(names)), F.col("p")
        running = (F.col("status") == "RUNNING") & (p == 4)
        return r.select(
            (F.col("run_id") * 10 + p).alias("id"), "run_id", "phase_name", "p",
            F.when((F.col("status") == "FAILED") & (p == F.col("run_id") % 5), "FAILED").when(running, "RUNNING").otherwise("SUCCESS").alias("status"),
            F.when(~running, F.expr("coalesce(duration_sec, 100) * (p + 1) div 15")).alias("duration_sec"), F.expr("files_uploaded div (p + 1)").alias("files_processed"),
        )

    @cached_property
    def gaps(self) -> DataFrame:
        return self.runs.filter("gap_backfill_mode = 1").select(
            F.col("run_id").alias("id"), "run_id", F.col("snapshot_name").alias("gap_snapshot_name"), F.col("started_at").alias("backfilled_at"), "bytes_uploaded"
        )
