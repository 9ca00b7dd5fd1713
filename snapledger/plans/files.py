"""Queries: documents written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.operators import history, reconcile
from snapledger.plans.indexes import _CATEGORIES, _MATCH, _UNKNOWN
from snapledger.plans.registry import query
from snapledger.sources import readers, writers
from snapledger.sources.fixtures import AS_OF, PHASES, ROOT


def _index_documents(x):
    """One small index document per content, every seventh node malformed, every fifth content's holders bare strings."""
    h = x.holders.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("pos", "snapshot", "relpath", "ord"))).alias("h"))
    first = F.col("h")[0]["ord"]
    dicts = F.to_json(F.transform("h", lambda a: F.struct(a["snapshot"].alias("snapshot"), a["relpath"].alias("relpath"))))
    texts = F.to_json(F.transform("h", lambda a: a["snapshot"]))
    listed = F.when(first % 5 == 0, texts).otherwise(dicts)
    node = F.when(first % 7 == 0, F.lit('"broken"')).otherwise(F.concat(F.lit('{"anchor_path":"'), "anchor_path", F.lit('","fileid":"f'), F.coalesce("fileid", F.lit(0)), F.lit('","holders":'), listed, F.lit("}")))
    j = x.nodes.join(h, "sha256")
    return j.select(F.concat(F.lit('{"version":1,"items":{"'), F.upper("sha256"), F.lit('":'), node, F.lit("}}")).alias("value"))


_FIRST = ", f AS (SELECT sha256, arg_min(ord, pos) AS o FROM holder GROUP BY sha256)"


@query("S05_index_nodes", _FIRST + " SELECT n.sha256, CASE WHEN o % 7 = 0 THEN 'other' ELSE 'dict' END AS node_kind, CASE WHEN o % 7 <> 0 THEN anchor_path END AS anchor_path, CASE WHEN o % 7 <> 0 THEN fileid END AS fileid FROM content_node n JOIN f ON f.sha256 = n.sha256")
def _(x):
    return readers.index_nodes(_index_documents(x)).select("sha256", "node_kind", "anchor_path", "fileid")


@query("S06_index_holders", _FIRST + " SELECT h.sha256, pos, CASE WHEN o % 5 = 0 THEN 'string' ELSE 'dict' END AS holder_kind, snapshot, CASE WHEN o % 5 <> 0 THEN relpath END AS relpath FROM holder h JOIN f ON f.sha256 = h.sha256 WHERE o % 7 <> 0")
def _(x):
    return readers.index_holders(readers.index_nodes(_index_documents(x))).select("sha256", "pos", "holder_kind", "snapshot", "relpath")


@query("S07_remote_tree", """, s(path, name, is_folder, lvl, fileid) AS (SELECT '/a' || run_id, 'a' || run_id, true, 1, NULL FROM backup_run UNION ALL SELECT '/a' || run_id || '/b', 'b', true, 2, NULL FROM backup_run UNION ALL SELECT '/a' || run_id || '/b/c.txt', 'c.txt', false, 3, run_id FROM backup_run) SELECT path, name, is_folder, lvl::BIGINT AS lvl, fileid FROM s""")
def _(x):
    r = F.col("run_id").cast("string")
    doc = F.concat(
        F.lit('{"metadata":{"name":"/","isfolder":true,"contents":[{"name":"a'), r, F.lit('","isfolder":true,"contents":[{"name":"b","isfolder":true,"contents":[{"name":"c.txt","isfolder":false,"fileid":'), r,
        F.lit('}]}]},{"name":".upload_complete","isfolder":true,"contents":[{"name":"x","isfolder":false,"fileid":1}]}]}}'),
    )
    docs = x.runs.select(doc.alias("value"))
    return readers.remote_tree(docs).select("path", "name", "is_folder", "lvl", "fileid")


@query("K01_manifest_lines", """SELECT snapshot, ord, '{"relpath":"' || relpath || '","size":' || size || ',"sha256":"' || sha256 || '"}' AS value FROM manifest_item""")
def _(x):
    return writers.manifest_lines(x.items.select("snapshot", "ord", "relpath", "size", "sha256"))


@query(
    "K02_index_lines",
    """, h AS (SELECT sha256, string_agg('{"snapshot":"' || snapshot || '","relpath":"' || relpath || '"}', ',' ORDER BY pos) AS hs FROM holder GROUP BY sha256)
SELECT n.sha256, '{"anchor_path":"' || anchor_path || '"' || CASE WHEN fileid IS NULL THEN '' ELSE ',"fileid":' || fileid END || ',"holders":[' || hs || ']}' AS value FROM content_node n JOIN h ON h.sha256 = n.sha256""",
)
def _(x):
    return writers.index_lines(x.nodes, x.holders)


_T, _GB = f"TIMESTAMP '{AS_OF}'", "1073741824.0::DOUBLE"
_REPORTS = f""", rec AS (SELECT * FROM backup_run ORDER BY started_at DESC, run_id DESC LIMIT 10),
bad AS (SELECT * FROM backup_run WHERE status = 'FAILED' AND started_at >= {_T} - INTERVAL 7 DAY ORDER BY started_at DESC, run_id DESC LIMIT 5),
perf AS (SELECT count(*) AS total, sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END)::BIGINT AS success, sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END)::BIGINT AS failed, sum(gap_backfill_mode)::BIGINT AS gap_backfills FROM backup_run WHERE started_at >= {_T} - INTERVAL 30 DAY),
ph AS (SELECT list_position({list(PHASES)}, phase_name)::BIGINT AS seq, phase_name, count(*) AS n, sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END)::BIGINT AS failed FROM backup_phase WHERE run_id IN (SELECT run_id FROM backup_run WHERE started_at >= {_T} - INTERVAL 30 DAY) GROUP BY phase_name)
SELECT to_json({{'recent': (SELECT coalesce(list({{'run_id': run_id, 'snapshot_name': snapshot_name, 'status': status, 'started': strftime(started_at, '%d.%m.%Y %H:%M')}} ORDER BY run_id), []) FROM rec),
  'failed': (SELECT coalesce(list({{'run_id': run_id, 'snapshot_name': snapshot_name, 'error': substr(error_message, 1, 50)}} ORDER BY run_id), []) FROM bad),
  'performance': (SELECT list({{'total': total, 'success': success, 'failed': failed, 'gap_backfills': gap_backfills}}) FROM perf),
  'phases': (SELECT list({{'seq': seq, 'phase_name': phase_name, 'n': n, 'failed': failed}} ORDER BY seq) FROM ph)}})::VARCHAR AS value"""


@query("K06_reports_document", _REPORTS)
def _(x):
    newest, bad = history.newest(x.runs, 10).drop("gb"), history.failed(x.runs, AS_OF, n=5)
    perf, phases = history.performance(x.runs, AS_OF).select("total", "success", "failed", "gap_backfills"), history.phase_stats(x.phases, x.runs, AS_OF, PHASES)
    return writers.document(recent=(newest, F.struct(*newest.columns)), failed=(bad, F.struct(*bad.columns)), performance=(perf, F.struct(*perf.columns)), phases=(phases, F.struct("seq", "phase_name", "n", "failed")))


@query("K07_status_document", ", s AS (SELECT status, count(*) AS n FROM backup_run GROUP BY status) SELECT to_json({'services': list({'status': status, 'n': n} ORDER BY status)})::VARCHAR AS value FROM s")
def _(x):
    t = x.runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return writers.document(services=(t, F.struct("status", "n")))


@query("K05_integrity_document", _MATCH + _UNKNOWN + _CATEGORIES + "SELECT to_json({'findings': list({'category': category, 'n': n, 'is_issue': is_issue} ORDER BY category)})::VARCHAR AS value FROM rep")
def _(x):
    t = reconcile.tamper_report(x.nodes, x.holders, x.remote, ROOT)
    return writers.document(findings=(t, F.struct("category", "n", "is_issue")))


@query("S03_manifest_paths", "SELECT snapshot, sha256, string_agg(relpath, ',' ORDER BY relpath) AS paths FROM manifest_item GROUP BY ALL")
def _(x):
    return readers.manifest_paths(x.items).withColumn("paths", F.array_join("paths", ","))


@query("S12_delta_report", "SELECT 'missing_anchors' AS category, sha256, anchor_path, fileid FROM content_node UNION ALL SELECT 'moved', sha256, anchor_path, NULL FROM content_node WHERE rn % 2 = 0")
def _(x):
    row = lambda *c: F.array(F.struct("sha256", "anchor_path", *c))
    doc = F.to_json(F.struct(row("fileid").alias("missing_anchors"), F.when(F.col("rn") % 2 == 0, row()).alias("moved"), F.lit(1).alias("checked")))
    return readers.delta_report(x.nodes.select(doc.alias("value")))


@query("S16_status_documents", "SELECT 'h' || run_id AS hostname, CASE WHEN run_id % 4 = 0 THEN 'UNKNOWN' ELSE status END AS overall_status, CASE WHEN run_id % 4 = 0 THEN 3 ELSE (run_id % 3)::INTEGER END AS exit_code FROM backup_run")
def _(x):
    r, some = F.col("run_id"), F.col("run_id") % 4 != 0
    doc = F.to_json(F.struct(F.concat(F.lit("h"), r).alias("hostname"), F.when(some, F.col("status")).alias("overall_status"), F.when(some, r % 3).alias("exit_code")))
    return readers.status_documents(x.runs.select(doc.alias("value")))


@query("S19_template_folders", "SELECT 'f' || run_id AS relpath FROM backup_run WHERE run_id % 3 <> 0")
def _(x):
    r = F.col("run_id").cast("string")
    doc = F.when(F.col("run_id") % 3 == 0, F.concat(F.lit('{"folders":"f'), r, F.lit('"}'))).otherwise(F.concat(F.lit('{"folders":["f'), r, F.lit('"],"x":1}')))
    return readers.template_folders(x.runs.select(doc.alias("value")))
