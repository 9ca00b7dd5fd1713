"""Queries: plans of what a run would do."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.operators import diff, history, index, plan
from snapledger.plans.diffs import _DIFF, CUR, the_diff
from snapledger.plans.registry import query
from snapledger.sources.fixtures import AS_OF, ROOT, SNAPSHOTS

S = SNAPSHOTS

_DIM = ", ".join(f"({k}, '{s}', {str(k != 0).lower()}, {str(k != 3).lower()}, {str(k != 1).lower()}, {'NULL' if k == 0 else repr(S[k - 1])})" for k, s in enumerate(S))
_SNAPS = f", dim(k, snapshot, is_local, is_remote, has_manifest, ref_snapshot) AS (VALUES {_DIM})\n"


def dim(x):
    """All snapshots but the first are local, all but the fourth stored, the second's manifest is lost."""
    k = F.col("k")
    from pyspark.sql.window import Window

    return x.snapshots.select("k", "snapshot", (k != 0).alias("is_local"), (k != 3).alias("is_remote"), (k != 1).alias("has_manifest"), F.lag("snapshot").over(Window.orderBy("k")).alias("ref_snapshot"))


@query("J19_snapshot_sets", _SNAPS + "SELECT snapshot, CASE WHEN is_remote AND is_local THEN 'keep' WHEN is_remote THEN 'delete' WHEN is_local THEN 'missing' ELSE 'none' END AS fate FROM dim")
def _(x):
    return plan.snapshot_sets(dim(x))


@query("J18_gaps", _SNAPS + "SELECT a.snapshot, CASE WHEN count(b.snapshot) = 0 THEN 'NEW' ELSE 'GAP' END AS kind, count(b.snapshot) AS n_later FROM dim a LEFT JOIN dim b ON b.is_remote AND b.snapshot > a.snapshot WHERE a.is_local AND NOT a.is_remote GROUP BY a.snapshot")
def _(x):
    return plan.gaps(dim(x))


_CHAIN = ", chain AS (SELECT a.snapshot, a.ref_snapshot, CASE WHEN NOT a.has_manifest THEN 'MISSING_MANIFEST' WHEN a.ref_snapshot IS NOT NULL AND NOT coalesce(b.is_remote, false) THEN 'BROKEN_CHAIN' ELSE 'OK' END AS state FROM dim a LEFT JOIN dim b ON a.ref_snapshot = b.snapshot WHERE a.is_remote)\n"


@query("J26_chain_state", _SNAPS + _CHAIN + "SELECT * FROM chain")
def _(x):
    return plan.chain_state(dim(x))


_GAPS = ", g AS (SELECT a.snapshot AS gap, bool_or(b.snapshot IS NOT NULL) AS is_gap FROM dim a LEFT JOIN dim b ON b.is_remote AND b.snapshot > a.snapshot WHERE a.is_local AND NOT a.is_remote GROUP BY a.snapshot)\n"
_LATER = """, later AS (SELECT gap, c.snapshot, max(CASE WHEN state <> 'OK' THEN 1 ELSE 0 END) OVER (PARTITION BY gap ORDER BY c.snapshot) AS broken FROM g JOIN chain c ON c.snapshot > g.gap WHERE is_gap)
SELECT gap, 'build' AS action, gap AS snapshot, 1 AS step FROM g UNION ALL SELECT gap, 'delete_snapshot', snapshot, 0 FROM later WHERE {cond} UNION ALL SELECT gap, 'rebuild', snapshot, 2 FROM later WHERE {cond}"""


@query("C08_gap_plan_optimistic", _SNAPS + _CHAIN + _GAPS + _LATER.replace("{cond}", "broken = 1"))
def _(x):
    return plan.gap_actions(dim(x))


@query("C08_gap_plan_aggressive", _SNAPS + _CHAIN + _GAPS + _LATER.replace("{cond}", "true"))
def _(x):
    return plan.gap_actions(dim(x), "aggressive")


@query("C08_gap_plan_conservative", _SNAPS + _GAPS + "SELECT gap, CASE WHEN is_gap THEN 'abort' ELSE 'build' END AS action, gap AS snapshot, 1 AS step FROM g")
def _(x):
    return plan.gap_actions(dim(x), "conservative")


@query("C18_bootstrap", ", g AS (SELECT snapshot FROM snap) SELECT snapshot AS gap, 'build' AS action, snapshot, 1 AS step FROM g")
def _(x):
    return plan.gap_actions(dim(x).withColumn("is_remote", F.lit(False)).withColumn("is_local", F.lit(True)))


@query("S09_complete_snapshots", ", top AS (SELECT snapshot FROM snap ORDER BY snapshot DESC LIMIT 60) SELECT snapshot FROM top WHERE snapshot IN (SELECT split_part(path, '/', 4) FROM remote_object WHERE path LIKE '%/.upload_complete')")
def _(x):
    newest = x.snapshots.select("snapshot").orderBy(F.desc("snapshot")).limit(60)
    done = x.remote.filter(F.endswith("path", F.lit("/.upload_complete"))).select(F.split_part("path", F.lit("/"), F.lit(4)).alias("snapshot"))
    return newest.join(done, "snapshot", "left_semi")


@query("S08_remote_snapshots", "SELECT DISTINCT split_part(path, '/', 4) AS snapshot FROM remote_object WHERE split_part(path, '/', 4) <> '_index'")
def _(x):
    return x.remote.select(F.split_part("path", F.lit("/"), F.lit(4)).alias("snapshot")).filter("snapshot <> '_index'").distinct()


@query("S10_local_snapshots", _SNAPS + "SELECT snapshot FROM dim WHERE is_local AND regexp_matches(snapshot, '^[0-9]{4}-[0-9]{2}-[0-9]{2}-')")
def _(x):
    return dim(x).filter(F.col("is_local") & F.regexp_like("snapshot", F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}-"))).select("snapshot")


@query("A21_snapshot_parity", _SNAPS + "SELECT count(*) FILTER (is_local AND NOT has_manifest) AS missing, count(*) FILTER (has_manifest AND NOT is_local) AS orphan, count(*) FILTER (is_local AND has_manifest) AS matched FROM dim")
def _(x):
    l, m = F.col("is_local"), F.col("has_manifest")
    return dim(x).agg(F.count_if(l & ~m).alias("missing"), F.count_if(m & ~l).alias("orphan"), F.count_if(l & m).alias("matched"))


@query("J17_orphan_manifests", _SNAPS + "SELECT snapshot FROM dim WHERE has_manifest AND snapshot NOT IN (SELECT snapshot FROM dim WHERE is_local)")
def _(x):
    return dim(x).filter("has_manifest").select("snapshot").join(dim(x).filter("is_local").select("snapshot"), "snapshot", "left_anti")


@query(
    "C19_abort_cleanup",
    _SNAPS + f"""SELECT 1 AS step, 'delete_local' AS action, snapshot AS path, NULL AS target FROM dim WHERE snapshot = '{S[4]}' AND is_local UNION ALL SELECT 2, 'set_latest', 'latest', max(snapshot) FROM dim WHERE is_local AND snapshot <> '{S[4]}'
UNION ALL SELECT 3, 'delete_manifest', '/A/manifests/' || snapshot || '.json', NULL FROM dim WHERE snapshot = '{S[4]}' AND has_manifest UNION ALL SELECT 4, 'delete_object', path, NULL FROM remote_object WHERE path LIKE '{ROOT}/{S[4]}/%'""",
)
def _(x):
    return plan.cleanup_aborted(dim(x), x.remote, S[4], ROOT, "/A/manifests")


@query(
    "C02_choose_mode",
    f""", m AS (SELECT sha256, snapshot, max(a) AS a FROM (SELECT sha256, snapshot, 0 AS a FROM holder UNION ALL SELECT sha256, split_part(anchor_path, '/', 4), 1 FROM content_node) GROUP BY ALL),
r AS (SELECT snapshot, count(*) AS total, count(*) FILTER (a = 0) / count(*) AS ratio FROM m GROUP BY snapshot), b AS (SELECT max(snapshot) AS snapshot FROM snap WHERE snapshot <> '{S[4]}' AND k <> 3)
SELECT b.snapshot AS basis, total, ratio, CASE WHEN total >= 100 AND ratio >= 0.5 THEN 'TURBO' ELSE 'SAFE' END AS mode FROM b LEFT JOIN r ON b.snapshot = r.snapshot""",
)
def _(x):
    done = x.snapshots.select("snapshot", (F.col("k") != 3).alias("complete"))
    return plan.choose_mode(index.stub_ratio(x.nodes, x.holders, ROOT), done, S[4])


_RETENTION = f""", fate(snapshot, fate) AS (VALUES ('{S[0]}', 'delete'), ('{S[1]}', 'delete'), ('{S[3]}', 'keep'), ('{S[4]}', 'keep')),
p AS (SELECT h.sha256, count(*) FILTER (f.fate = 'keep') AS kept, count(*) FILTER (f.fate = 'delete') AS deleted, count(*) AS held,
  arg_max(h.snapshot || '/' || h.relpath, (h.snapshot, -h.pos)) FILTER (f.fate = 'keep') AS newest FROM holder h LEFT JOIN fate f ON h.snapshot = f.snapshot GROUP BY h.sha256),
j AS (SELECT n.sha256, n.fileid, p.*, coalesce(f.fate = 'delete', false) AS lost FROM content_node n JOIN p ON n.sha256 = p.sha256 LEFT JOIN fate f ON split_part(n.anchor_path, '/', 4) = f.snapshot),
ret AS (SELECT sha256, CASE WHEN lost AND kept = 0 THEN 'drop_node' WHEN lost THEN 'promote' ELSE 'trim' END AS action, CASE WHEN lost AND kept > 0 THEN '{ROOT}/' || newest END AS new_anchor, kept, held - kept AS dropped, lost AND kept > 0 AND fileid IS NULL AS needs_path_move FROM j WHERE lost OR deleted > 0)
"""


def _retention(x):
    keep, delete = x.snapshots.filter("k IN (3, 4)").select("snapshot"), x.snapshots.filter("k IN (0, 1)").select("snapshot")
    return plan.retention(x.nodes, x.holders, keep, delete, ROOT)


@query("C03_retention_plan", _RETENTION + "SELECT * FROM ret")
def _(x):
    return _retention(x)


@query("C03_retention_summary", _RETENTION + "SELECT action, count(*) AS n, sum(dropped)::BIGINT AS dropped FROM ret GROUP BY action")
def _(x):
    return _retention(x).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("dropped").alias("dropped"))


@query(
    "C06_full_write_plan",
    f""", h AS (SELECT * FROM holder WHERE snapshot < '{S[3]}' OR (snapshot = '{S[3]}' AND ord % 9 = 0)), n AS (SELECT sha256, CASE WHEN rn % 17 = 0 THEN '' ELSE anchor_path END AS anchor_path FROM content_node WHERE split_part(anchor_path, '/', 4) < '{S[3]}'),
r AS (SELECT m.*, h.sha256 IS NOT NULL AS held, n.anchor_path, '{ROOT}/' || m.snapshot || '/' || m.relpath AS path, row_number() OVER (PARTITION BY m.dev, m.ino ORDER BY m.ord) > 1 AS again
  FROM manifest_item m LEFT JOIN h ON h.sha256 = m.sha256 AND h.snapshot = m.snapshot AND h.relpath = m.relpath LEFT JOIN n ON n.sha256 = m.sha256 WHERE m.snapshot = '{S[3]}'),
f AS (SELECT *, NOT held AND NOT again AND coalesce(anchor_path, '') = '' AS fresh FROM r), w AS (SELECT f.*, a.na FROM f LEFT JOIN (SELECT sha256, arg_min(path, ord) FILTER (fresh) AS na FROM f GROUP BY sha256) a ON f.sha256 = a.sha256),
t AS (SELECT *, CASE WHEN held THEN 'resume' WHEN fresh AND path = na THEN 'upload' WHEN anchor_path = path THEN 'resume' ELSE 'stub' END AS action FROM w)
SELECT snapshot, ord, relpath, sha256, action, CASE WHEN action = 'stub' THEN coalesce(nullif(anchor_path, ''), na) END AS target FROM t""",
)
def _(x):
    h = x.holders.filter((F.col("snapshot") < S[3]) | ((F.col("snapshot") == S[3]) & (F.col("ord") % 9 == 0)))
    old = F.split_part("anchor_path", F.lit("/"), F.lit(4)) < S[3]
    n = x.nodes.filter(old).select("sha256", F.when(F.col("rn") % 17 == 0, "").otherwise(F.col("anchor_path")).alias("anchor_path"))
    return plan.full_write(x.manifest(3), n, h, ROOT)


_DELTA = _DIFF + f""", n AS (SELECT sha256, anchor_path FROM content_node WHERE split_part(anchor_path, '/', 4) < '{CUR}' AND rn % 3 <> 0),
t AS (SELECT d.relpath, d.sha256, status, n.anchor_path, row_number() OVER w AS nth, first_value(d.relpath) OVER w AS fst FROM diff d LEFT JOIN n ON n.sha256 = d.sha256 WHERE status IN ('new', 'changed') WINDOW w AS (PARTITION BY d.sha256 ORDER BY d.ext, d.relpath))
"""


@query("C04_delta_write_plan", _DELTA + f"SELECT relpath, sha256, status, CASE WHEN anchor_path IS NULL AND nth = 1 THEN 'upload' ELSE 'stub' END AS action, coalesce(anchor_path, '{ROOT}/{CUR}/' || fst) AS anchor FROM t")
def _(x):
    n = x.nodes.filter((F.split_part("anchor_path", F.lit("/"), F.lit(4)) < CUR) & (F.col("rn") % 3 != 0))
    return plan.delta_write(the_diff(x), n, f"{ROOT}/{CUR}")


@query("A03_new_contents", _DELTA + f"SELECT sha256, '{ROOT}/{CUR}/' || fst AS anchor_path FROM t WHERE anchor_path IS NULL AND nth = 1")
def _(x):
    n = x.nodes.filter((F.split_part("anchor_path", F.lit("/"), F.lit(4)) < CUR) & (F.col("rn") % 3 != 0))
    return plan.delta_write(the_diff(x), n, f"{ROOT}/{CUR}").filter("action = 'upload'").select("sha256", F.col("anchor").alias("anchor_path"))


@query(
    "C07_object_store_plan",
    "SELECT '/B/_objects/' || substr(sha256, 1, 2) || '/' || sha256 || '.txt' AS object_path, count(*) AS n_stubs, max(size) AS size, CASE WHEN sha256 IN (SELECT sha256 FROM content_node WHERE rn % 2 = 0) THEN 'present' ELSE 'upload' END AS action FROM manifest_item GROUP BY sha256",
)
def _(x):
    there = x.nodes.filter("rn % 2 = 0").select(F.concat(F.lit("/B/_objects/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256", F.lit(".txt")).alias("path"))
    return plan.object_store(x.items, there, "/B/_objects")


_RESTORE = f""", w AS (SELECT h.*, n.fileid, row_number() OVER q AS nth, first_value(h.relpath) OVER q AS src FROM holder h LEFT JOIN content_node n ON n.sha256 = h.sha256 WHERE h.snapshot = '{S[4]}' AND h.relpath LIKE 'src%' WINDOW q AS (PARTITION BY h.sha256 ORDER BY h.relpath)),
rs AS (SELECT relpath, sha256, size, CASE WHEN nth > 1 THEN 'link' WHEN fileid IS NULL THEN 'download_by_path' ELSE 'download' END AS action, CASE WHEN nth > 1 THEN src END AS link_to FROM w)
"""


@query("C12_restore_plan", _RESTORE + "SELECT * FROM rs")
def _(x):
    return plan.restore(x.nodes, x.holders, S[4], "src")


@query("A19_restore_totals", _RESTORE + "SELECT action, count(*) AS files, sum(size)::BIGINT AS bytes FROM rs GROUP BY action")
def _(x):
    return plan.restore(x.nodes, x.holders, S[4], "src").groupBy("action").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("J21_restore_items", f"SELECT h.relpath, h.sha256, n.anchor_path, n.fileid FROM holder h JOIN content_node n ON h.sha256 = n.sha256 WHERE h.snapshot = '{S[2]}'")
def _(x):
    return x.holders.filter(F.col("snapshot") == S[2]).select("relpath", "sha256").join(x.nodes.select("sha256", "anchor_path", "fileid"), "sha256")


@query("P03_restore_prefix", f"SELECT relpath FROM holder WHERE snapshot = '{S[2]}' AND relpath LIKE 'src1%'")
def _(x):
    return x.holders.filter((F.col("snapshot") == S[2]) & F.startswith("relpath", F.lit("src1"))).select("relpath")


_STUBS = f""", p AS (SELECT h.*, n.anchor_path, n.fileid, '{ROOT}/' || h.snapshot || '/' || h.relpath AS path FROM holder h JOIN content_node n ON n.sha256 = h.sha256 WHERE n.fileid IS NOT NULL)
SELECT path || '.meta.json' AS stub_path, regexp_replace(path, '/[^/]*$', '') AS dir, sha256, fileid, '{{"type":"hardlink","sha256":"' || sha256 || '","size":' || size || ',"anchor_path":"' || anchor_path || '","fileid":' || fileid || ',"snapshot":"' || snapshot || '","relpath":"' || relpath || '"}}' AS payload FROM p"""


@query("J22_stubs_of_all_holders", _STUBS)
def _(x):
    return plan.stub_rows(x.nodes, x.holders, ROOT, False)


@query("J23_stubs_without_anchor", _STUBS + " WHERE path <> anchor_path")
def _(x):
    return plan.stub_rows(x.nodes, x.holders, ROOT, True)


@query("K03_stubs_by_folder", _STUBS.replace("SELECT path ||", ", s AS (SELECT path ||") + " WHERE path <> anchor_path) SELECT dir, count(*) AS n FROM s GROUP BY dir")
def _(x):
    return plan.stub_rows(x.nodes, x.holders, ROOT, True).groupBy("dir").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J24_parent_folders",
    """, p AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM remote_object), k AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM remote_object WHERE fileid % 2 = 0)
SELECT p.dir, CASE WHEN k.dir IS NOT NULL THEN length(k.dir)::BIGINT END AS folderid, (length(p.dir) - length(replace(p.dir, '/', '')))::BIGINT AS depth, CASE WHEN k.dir IS NULL THEN 'ensure_path' ELSE 'known' END AS action FROM p LEFT JOIN k ON p.dir = k.dir""",
)
def _(x):
    d = F.regexp_replace("path", "/[^/]*$", "")
    known = x.remote.filter("fileid % 2 = 0").select(d.alias("path")).distinct().withColumn("folderid", F.length("path").cast("long"))
    return plan.parents(x.remote, known)


@query("A24_folders_by_depth", ", p AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM remote_object) SELECT (length(dir) - length(replace(dir, '/', '')))::BIGINT AS depth, count(*) AS n FROM p GROUP BY 1")
def _(x):
    return plan.parents(x.remote, x.remote.limit(0).select("path", F.lit(0).cast("long").alias("folderid"))).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("K09_upsert_new", "SELECT run_id, status FROM backup_run WHERE run_id % 3 = 0 UNION ALL SELECT run_id, 'NEW' FROM backup_run WHERE run_id % 2 = 0 AND run_id % 3 <> 0")
def _(x):
    have = x.runs.filter("run_id % 3 = 0").select("run_id", "status")
    return plan.upsert_new(have, x.runs.filter("run_id % 2 = 0").select("run_id", F.lit("NEW").alias("status")), "run_id")


@query("K10_latest_state", "SELECT run_id, arg_max(phase_name, p) AS phase_name, arg_max(status, p) AS status FROM backup_phase GROUP BY run_id")
def _(x):
    return history.latest_state(x.phases.select("run_id", "phase_name", "status", "p"), "run_id", ["p"]).select("run_id", "phase_name", "status")


@query("K11_purge", f", o AS (SELECT run_id FROM backup_run WHERE started_at < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY) SELECT 'backup_run' AS table_name, count(*) AS n FROM o UNION ALL SELECT 'backup_phase', count(*) FROM backup_phase WHERE run_id IN (SELECT run_id FROM o)")
def _(x):
    return plan.purge(x.runs, x.phases, AS_OF, 20)


@query("K14_temp_cleanup", "SELECT ord FROM manifest_item WHERE ord % 4 < 3 AND floor((1704067200.0 + 30 * 86400 - mtime) / 86400) > 7")
def _(x):
    k = F.col("ord") % 4
    name = F.when(k == 0, F.concat(F.lit("x_mani."), "ord", F.lit(".json"))).when(k == 1, F.concat(F.lit("x_index_"), "ord", F.lit(".json"))).when(k == 2, F.concat(F.lit("delta"), "ord", F.lit(".json"))).otherwise(F.concat(F.lit("keep"), "ord", F.lit(".json")))
    return plan.temp_cleanup(x.items.select("ord", name.alias("name"), "mtime"), 1704067200 + 30 * 86400).select("ord")


@query(
    "C10_oldest_holder_anchor",
    f", o AS (SELECT sha256, '{ROOT}/' || arg_min(snapshot || '/' || relpath, pos) AS oldest FROM holder GROUP BY sha256) SELECT n.sha256, CASE WHEN rn % 4 = 0 THEN oldest ELSE anchor_path END AS anchor_path, fileid, remote_hash, rn % 4 = 0 AS was_set FROM content_node n JOIN o ON n.sha256 = o.sha256",
)
def _(x):
    nodes = x.nodes.withColumn("anchor_path", F.when(F.col("rn") % 8 == 0, "").when(F.col("rn") % 4 != 0, F.col("anchor_path")))
    return index.set_missing_anchors(nodes, x.holders, ROOT)


@query("C10_reset_ids", "SELECT sha256, anchor_path, NULL::BIGINT AS fileid, NULL::VARCHAR AS remote_hash, false AS was_set FROM content_node")
def _(x):
    return index.set_missing_anchors(x.nodes, x.holders, ROOT, reset=True)


@query(
    "C11_autofix",
    f""", m AS (SELECT n.sha256, n.anchor_path FROM content_node n LEFT JOIN remote_object r ON n.anchor_path = r.path WHERE r.path IS NULL), f AS (SELECT sha256, '{ROOT}/' || arg_min(snapshot || '/' || relpath, pos) AS target FROM holder GROUP BY sha256)
SELECT m.sha256, 'promote' AS action, m.anchor_path AS path, target FROM m JOIN f ON f.sha256 = m.sha256
UNION ALL SELECT lower(s.sha256), CASE WHEN n.sha256 IS NULL THEN 'delete_stub' ELSE 'rewrite_stub' END, stub_path, n.anchor_path FROM stub s LEFT JOIN content_node n ON n.sha256 = lower(s.sha256) WHERE n.sha256 IS NULL OR s.anchor_path <> n.anchor_path""",
)
def _(x):
    missing = x.nodes.join(x.remote.select(F.col("path").alias("anchor_path")), "anchor_path", "left_anti")
    return plan.autofix(x.nodes, x.holders, x.stubs, missing, ROOT)


@query("J25_template_delta", ", a AS (SELECT DISTINCT split_part(relpath, '/', 1) AS relpath FROM manifest_item ), b AS (SELECT DISTINCT split_part(relpath, '/', 2) AS relpath FROM manifest_item UNION SELECT DISTINCT split_part(relpath, '/', 1) FROM manifest_item WHERE relpath LIKE 'src1%') SELECT coalesce(a.relpath, b.relpath) AS relpath, CASE WHEN a.relpath IS NULL THEN 'only_right' WHEN b.relpath IS NULL THEN 'only_left' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.relpath = b.relpath")
def _(x):
    part = lambda n: F.split_part("relpath", F.lit("/"), F.lit(n)).alias("relpath")
    template = x.items.select(part(2)).union(x.items.filter("relpath LIKE 'src1%'").select(part(1)))
    return diff.set_delta(x.items.select(part(1)), template)
