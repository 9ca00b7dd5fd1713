"""Queries: manifests, differences, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.functions import fmt
from snapledger.functions import paths as P
from snapledger.operators import diff, index, plan, reconcile, tree
from snapledger.plans.registry import query
from snapledger.sources.fixtures import ROOT, SNAPSHOTS, table

CUR, REF = SNAPSHOTS[3], SNAPSHOTS[2]
_DIFF = f""", c AS (SELECT * FROM manifest_item WHERE snapshot = '{CUR}'), r AS (SELECT * FROM manifest_item WHERE snapshot = '{REF}'),
diff AS (SELECT coalesce(c.relpath, r.relpath) AS relpath, CASE WHEN c.relpath IS NULL THEN 'deleted' WHEN r.relpath IS NULL THEN 'new'
  WHEN c.sha256 = r.sha256 AND c.mtime IS NOT DISTINCT FROM r.mtime THEN 'identical' ELSE 'changed' END AS status,
  coalesce(c.sha256, r.sha256) AS sha256, coalesce(c.size, r.size) AS size, coalesce(c.mtime, r.mtime) AS mtime, coalesce(c.ext, r.ext) AS ext
  FROM c FULL JOIN r ON c.relpath = r.relpath)
"""


def the_diff(x):
    return diff.manifest_diff(x.manifest(3), x.manifest(2))


@query("J01_manifest_diff", _DIFF + "SELECT * FROM diff")
def _(x):
    return the_diff(x)


@query("A11_diff_stats", _DIFF + "SELECT status, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM diff GROUP BY status")
def _(x):
    return diff.diff_stats(the_diff(x))


@query("L03_write_order", _DIFF + "SELECT *, row_number() OVER (ORDER BY coalesce(ext, ''), relpath) AS seq FROM diff WHERE status IN ('new', 'changed')")
def _(x):
    return diff.write_order(the_diff(x))


@query(
    "C05_delete_plan",
    _DIFF + f"SELECT relpath, 'file' AS kind, '{ROOT}/{CUR}/' || relpath AS path FROM diff WHERE status IN ('deleted', 'changed') UNION ALL SELECT relpath, 'stub', '{ROOT}/{CUR}/' || relpath || '.meta.json' FROM diff WHERE status IN ('deleted', 'changed')",
)
def _(x):
    return diff.delete_paths(the_diff(x), f"{ROOT}/{CUR}")


_FOLDERS = """, f AS (SELECT DISTINCT snapshot, split_part(relpath, '/', 1) AS relpath FROM manifest_item UNION
  SELECT DISTINCT snapshot, split_part(relpath, '/', 1) || '/' || split_part(relpath, '/', 2) FROM manifest_item)
"""


@query("P01_folders", _FOLDERS + f"SELECT relpath FROM f WHERE snapshot = '{CUR}'")
def _(x):
    return diff.folders(x.manifest(3))


@query(
    "U02_folder_delta",
    _FOLDERS + f", a AS (SELECT relpath FROM f WHERE snapshot = '{CUR}' AND relpath NOT LIKE 'src1%'), b AS (SELECT relpath FROM f WHERE snapshot = '{REF}' AND relpath NOT LIKE 'src2%') SELECT coalesce(a.relpath, b.relpath) AS relpath, CASE WHEN a.relpath IS NULL THEN 'only_right' WHEN b.relpath IS NULL THEN 'only_left' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.relpath = b.relpath",
)
def _(x):
    return diff.set_delta(diff.folders(x.manifest(3)).filter("relpath NOT LIKE 'src1%'"), diff.folders(x.manifest(2)).filter("relpath NOT LIKE 'src2%'"))


@query(
    "C01_template_choice",
    _FOLDERS + f""", a AS (SELECT relpath FROM f WHERE snapshot = '{CUR}'), b AS (SELECT relpath FROM f WHERE snapshot = '{REF}' AND relpath NOT LIKE 'src12%'),
s AS (SELECT count(*) FILTER (a.relpath IS NOT NULL AND b.relpath IS NOT NULL) AS shared, count(*) FILTER (b.relpath IS NULL) AS l, count(*) FILTER (a.relpath IS NULL) AS r FROM a FULL JOIN b ON a.relpath = b.relpath)
SELECT shared + l AS n_manifest, shared AS n_shared, l AS n_add, r AS n_delete, 1 + l + r AS copy_cost, CASE WHEN shared + l >= 50 AND shared / (shared + l) >= 0.7 AND 1 + l + r < shared + l THEN 'template' ELSE 'single' END AS choice FROM s""",
)
def _(x):
    return plan.template_choice(diff.folders(x.manifest(3)), diff.folders(x.manifest(2)).filter("relpath NOT LIKE 'src12%'"))


@query(
    "A12_manifest_totals",
    "SELECT snapshot, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes, count(DISTINCT sha256)::BIGINT AS contents, max(mtime) AS newest FROM manifest_item GROUP BY snapshot",
)
def _(x):
    return x.items.groupBy("snapshot").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_distinct("sha256").alias("contents"), F.max("mtime").alias("newest"))


@query("P02_required_fields", "SELECT snapshot, relpath, lower(nullif(CASE WHEN ord % 11 = 0 THEN '' ELSE sha256 END, '')) AS sha256 FROM manifest_item WHERE ord % 11 <> 0")
def _(x):
    return index.with_hash(x.items.withColumn("sha256", F.when(F.col("ord") % 11 == 0, "").otherwise(F.col("sha256")))).select("snapshot", "relpath", "sha256")


@query("P04_ignored_objects", "SELECT path FROM remote_object WHERE NOT (path LIKE '%.meta.json' OR path LIKE '%/.upload_complete')")
def _(x):
    return x.remote.filter(~reconcile.ignored(F.col("path"))).select("path")


@query("P05_snapshot_filter", f"SELECT path, regexp_extract(path, '/_snapshots/([^/]+)/', 1) AS snap FROM remote_object WHERE regexp_extract(path, '/_snapshots/([^/]+)/', 1) IN ('{CUR}', '{REF}')")
def _(x):
    s = P.snapshot_segment(F.col("path"))
    return x.remote.filter(s.isNull() | s.isin(CUR, REF)).select("path", s.alias("snap"))


@query("P07_both_present_differ", "SELECT a.sha256, a.fileid AS left_id, b.fileid AS right_id FROM content_node a JOIN content_node b ON a.sha256 = b.sha256 WHERE a.fileid IS NOT NULL AND b.rn % 5 <> 0 AND a.fileid <> b.fileid + (CASE WHEN b.rn % 3 = 0 THEN 1 ELSE 0 END)")
def _(x):
    b = x.nodes.select("sha256", F.when(F.col("rn") % 5 != 0, F.col("fileid")).alias("right_id"), F.when(F.col("rn") % 3 == 0, 1).otherwise(0).alias("d"))
    j = x.nodes.select("sha256", F.col("fileid").alias("left_id")).join(b, "sha256")
    return j.filter("left_id IS NOT NULL AND right_id IS NOT NULL AND left_id <> right_id + d").select("sha256", "left_id", "right_id")


@query(
    "F01_path_functions",
    """SELECT path, '/' || trim(regexp_replace(path, '/+', '/', 'g'), '/') AS norm, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS base,
  nullif(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^\\.*[^.].*?(\\.[^.]*)$', 1), '') AS ext, split_part(path, '/', 4) AS snap, (length(path) - length(replace(path, '/', '')))::BIGINT AS depth,
  path LIKE '%.meta.json' AS is_stub, path || '.meta.json' AS stub, substr(path, length('/B/_snapshots/') + 1) AS rel, '/B/_snapshots/x/' || fileid::VARCHAR AS joined FROM remote_object""",
)
def _(x):
    p = F.col("path")
    return x.remote.select(
        "path", P.norm_remote(F.concat(F.lit(" "), F.replace(p, F.lit("/"), F.lit("//")), F.lit("/ "))).alias("norm"), P.dirname(p).alias("dir"), P.basename(p).alias("base"), P.ext(p).alias("ext"),
        P.snapshot_segment(p).alias("snap"), P.depth(p).cast("long").alias("depth"), P.is_stub(p).alias("is_stub"), P.stub_path(p).alias("stub"), P.relative_to(p, F.lit(ROOT)).alias("rel"),
        P.join_remote(F.lit(ROOT + "/x/"), F.concat(F.lit("/"), F.col("fileid").cast("string"))).alias("joined"),
    )


@query(
    "F08_object_paths",
    "SELECT sha256, '/B/_objects/' || substr(sha256, 1, 2) || '/' || sha256 || CASE WHEN ord % 2 = 0 THEN '.txt' ELSE '' END AS object_path, dev::VARCHAR || ':' || ino::VARCHAR AS inode_key, snapshot || '/' || relpath AS place FROM manifest_item",
)
def _(x):
    e = F.when(F.col("ord") % 2 == 0, F.col("ext"))
    return x.items.select("sha256", P.object_path(F.lit("/B/_objects"), F.col("sha256"), e).alias("object_path"), P.inode_key(F.col("dev"), F.col("ino")).alias("inode_key"), P.holder_path(F.col("snapshot"), F.lit(None).cast("string"), F.col("relpath")).alias("place"))


@query(
    "F12_display_functions",
    """SELECT run_id, CASE WHEN bytes_uploaded < 1024 THEN printf('%.1f B', bytes_uploaded::DOUBLE) WHEN bytes_uploaded < 1048576 THEN printf('%.1f KB', bytes_uploaded / 1024.0::DOUBLE) WHEN bytes_uploaded < 1073741824 THEN printf('%.1f MB', bytes_uploaded / 1048576.0::DOUBLE) ELSE printf('%.1f GB', bytes_uploaded / 1073741824.0::DOUBLE) END AS size,
  CASE WHEN duration_sec IS NULL THEN 'N/A' WHEN duration_sec >= 3600 THEN printf('%dh%dm%ds', duration_sec // 3600, duration_sec % 3600 // 60, duration_sec % 60) WHEN duration_sec >= 60 THEN printf('%dm%ds', duration_sec // 60, duration_sec % 60) ELSE printf('%ds', duration_sec) END AS took,
  CASE WHEN run_id % 200 >= 24 THEN printf('%dd %dh ago', run_id % 200 // 24, run_id % 200 % 24) ELSE printf('%dh ago', run_id % 200) END AS age,
  CASE WHEN run_id % 7 = 0 THEN NULL ELSE strftime(make_timestamp((1704067200 + run_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS iso, floor(bytes_uploaded * 500 // 1073741824 * 10 / 1024) / 10 AS tb,
  CASE WHEN run_id % 900 < 200 THEN 'CRITICAL' WHEN run_id % 900 < 500 THEN 'WARNING' ELSE 'OK' END AS free FROM backup_run""",
)
def _(x):
    r = F.col("run_id")
    return x.runs.select(
        "run_id", fmt.fmt_bytes(F.col("bytes_uploaded")).alias("size"), fmt.fmt_duration(F.col("duration_sec")).alias("took"), fmt.age_display(r % 200).alias("age"),
        fmt.iso_utc(F.when(r % 7 != 0, (r + 1704067200).cast("double"))).alias("iso"), fmt.whole_tb(F.col("bytes_uploaded") * 500).alias("tb"), fmt.free_class(r % 900).alias("free"),
    )


@query("F15_snapshot_time", "SELECT snapshot, strftime(strptime(snapshot, '%Y-%m-%d-%H%M%S'), '%Y-%m-%d %H:%M:%S') AS at FROM snap")
def _(x):
    return x.snapshots.select("snapshot", F.date_format(fmt.snapshot_time(F.col("snapshot")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("F20_content_hashes", "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents", ctes=False)
def _(x):
    d = table(x.spark, x.sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"))


@query(
    "F21_unique_names",
    """WITH d AS (SELECT doc_id AS ord, CASE WHEN doc_id % 50 = 7 THEN 'doc_' || lang || ' (' || doc_id % 9 || ').txt' ELSE 'doc_' || lang || '.txt' END AS name FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) - 1 AS nth FROM d), m AS (SELECT name, max(nth) AS most, left(name, length(name) - 4) AS base FROM n GROUP BY name HAVING max(nth) > 0),
c AS (SELECT name, base || ' (' || i || ').txt' AS cand, i FROM (SELECT *, unnest(generate_series(1, most + 20)) AS i FROM m)),
f AS (SELECT name, cand, row_number() OVER (PARTITION BY name ORDER BY i) AS nth FROM c WHERE cand NOT IN (SELECT name FROM d))
SELECT n.ord, n.name, CASE WHEN n.nth = 0 THEN n.name ELSE f.cand END AS unique_name FROM n LEFT JOIN f ON f.name = n.name AND f.nth = n.nth""",
    ctes=False,
)
def _(x):
    i = F.col("doc_id")
    name = F.concat(F.lit("doc_"), "lang", F.when(i % 50 == 7, F.concat(F.lit(" ("), i % 9, F.lit(")"))).otherwise(F.lit("")), F.lit(".txt"))
    return plan.unique_names(table(x.spark, x.sf_dir, "documents").select(i.alias("ord"), name.alias("name")))


@query("F22_file_ids", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE doc_id END AS fileid FROM documents", ctes=False)
def _(x):
    i = F.col("doc_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit("f"), i.cast("string"))).when(i % 3 == 1, i.cast("string")).otherwise("x1y")
    return table(x.spark, x.sf_dir, "documents").select("doc_id", P.file_id(raw).alias("fileid"))


@query("F28_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", ctes=False)
def _(x):
    return table(x.spark, x.sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("P11_safe_paths", "SELECT relpath, ord, ord % 4 <> 1 AS safe FROM manifest_item")
def _(x):
    k = F.col("ord") % 4
    p = F.when(k == 0, F.concat(F.lit("a/../"), "relpath")).when(k == 1, F.concat(F.lit("a/../../"), "relpath")).otherwise(F.col("relpath"))
    return x.items.select("relpath", "ord", P.safe_under_base(p).alias("safe"))




def _tree(x):
    c = F.col("c_custkey")
    return table(x.spark, x.sf_dir, "customer").select(
        c.alias("id"), F.expr("CASE WHEN c_custkey > 5 THEN c_custkey div 5 END").alias("parent_id"), F.when(c % 97 == 0, ".upload_complete").otherwise(F.concat(F.lit("n"), c.cast("string"))).alias("name"), (c % 3 == 0).alias("is_folder")
    )


_RECURSIVE = """WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_custkey <= 5 THEN NULL ELSE c_custkey // 5 END AS parent_id, CASE WHEN c_custkey % 97 = 0 THEN '.upload_complete' ELSE 'n' || c_custkey END AS name, c_custkey % 3 = 0 AS is_folder FROM customer),
"""


@query(
    "T01_flatten_tree",
    _RECURSIVE + "f AS (SELECT id, is_folder, '/' || name AS path, 1::BIGINT AS lvl FROM t WHERE parent_id IS NULL AND name <> '.upload_complete' UNION ALL SELECT t.id, t.is_folder, f.path || '/' || t.name, f.lvl + 1 FROM t JOIN f ON t.parent_id = f.id WHERE t.name <> '.upload_complete') SELECT * FROM f",
    ctes=False,
)
def _(x):
    return tree.flatten(_tree(x))


@query(
    "T02_flatten_to_depth",
    _RECURSIVE + "f AS (SELECT id, is_folder, '/' || name AS path, 1::BIGINT AS lvl FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, t.is_folder, f.path || '/' || t.name, f.lvl + 1 FROM t JOIN f ON t.parent_id = f.id WHERE f.lvl < 3) SELECT * FROM f",
    ctes=False,
)
def _(x):
    return tree.flatten(_tree(x), max_depth=3, prune_markers=False)


@query("T03_folder_paths", _RECURSIVE + "f AS (SELECT id, is_folder, '/' || name AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, t.is_folder, f.path || '/' || t.name FROM t JOIN f ON t.parent_id = f.id) SELECT path, id AS folderid FROM f WHERE is_folder", ctes=False)
def _(x):
    return tree.flatten(_tree(x), prune_markers=False).filter("is_folder").select("path", F.col("id").alias("folderid"))


@query(
    "T04_resolve_up",
    _RECURSIVE + "f AS (SELECT id, '/' || name AS path, 1::BIGINT AS depth FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, f.path || '/' || t.name, f.depth + 1 FROM t JOIN f ON t.parent_id = f.id) SELECT id, path, depth, true AS complete FROM f",
    ctes=False,
)
def _(x):
    t = _tree(x)
    return tree.resolve_up(t, t.select("id"))


@query(
    "U03_missing_folders",
    _FOLDERS + f"SELECT relpath FROM f WHERE snapshot = '{CUR}' EXCEPT SELECT relpath FROM f WHERE snapshot = '{REF}' AND relpath NOT LIKE 'src1%'",
)
def _(x):
    sides = diff.set_delta(diff.folders(x.manifest(3)), diff.folders(x.manifest(2)).filter("relpath NOT LIKE 'src1%'"))
    return sides.filter("side = 'only_left'").select("relpath")


@query("F05_after_marker", "SELECT path, CASE WHEN contains(path, '/_snapshots/') THEN split_part(split_part(path, '/_snapshots/', 2), '/', 1) END AS after_marker, split_part(path, '/', 4) AS segment FROM remote_object")
def _(x):
    p = F.col("path")
    return x.remote.select("path", P.snapshot_after_marker(p).alias("after_marker"), P.snapshot_segment(p).alias("segment"))


@query("F10_relative_paths", f"SELECT path, CASE WHEN fileid % 7 = 0 THEN '.' WHEN split_part(path, '/', 4) = '{CUR}' THEN substr(path, length('{ROOT}/{CUR}/') + 1) ELSE path END AS rel FROM remote_object")
def _(x):
    base = F.when(F.col("fileid") % 7 == 0, F.col("path")).otherwise(F.lit(f"{ROOT}/{CUR}"))
    return x.remote.select("path", P.relative_to(F.col("path"), base).alias("rel"))


@query("P12_snapshot_names", "SELECT run_id, run_id % 3 <> 2 AS valid FROM backup_run")
def _(x):
    r = F.col("run_id")
    name = F.when(r % 3 == 0, CUR).when(r % 3 == 1, "2024-01-02__03-04-05").otherwise(F.concat(F.lit("latest"), r.cast("string")))
    return x.runs.select("run_id", P.valid_snapshot(name).alias("valid"))


@query(
    "R16_quota_and_disk",
    """SELECT run_id, 2000 AS total_gb, run_id * 7 % 2000 AS used_gb, 2000 - run_id * 7 % 2000 AS free_gb, printf('%.1f', round_even((2000 - run_id * 7 % 2000) / 1024.0::DOUBLE, 1)) AS free_tb,
  CASE WHEN 2000 - run_id * 7 % 2000 < 200 THEN 'CRITICAL' WHEN 2000 - run_id * 7 % 2000 < 500 THEN 'WARNING' ELSE 'OK' END AS state, CASE WHEN 100 - run_id % 101 < 5 THEN 'CRITICAL' WHEN 100 - run_id % 101 < 10 THEN 'WARNING' ELSE 'OK' END AS disk FROM backup_run""",
)
def _(x):
    gb = F.lit(1024**3).cast("long")
    return x.runs.select("run_id", F.inline(F.array(fmt.quota(gb * 2000, gb * (F.col("run_id") * 7 % 2000)))), fmt.disk_class(F.col("run_id") % 101).alias("disk"))


@query("F24_titles", "SELECT event_id, CASE WHEN length(props) <= 8 THEN props ELSE left(props, 8) || '...' END AS short, 'Nas Av ' || upper(left(event_type, 1)) || substr(event_type, 2) AS title FROM events", ctes=False)
def _(x):
    e = table(x.spark, x.sf_dir, "events")
    return e.select("event_id", fmt.truncated(F.col("props"), 8).alias("short"), fmt.title(F.concat(F.lit("nas-av-"), "event_type")).alias("title"))


@query(
    "F29_row_form",
    "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'FOLDER' ELSE 'FILE' END AS type, CASE WHEN c_custkey % 5 <> 0 THEN c_name WHEN c_custkey % 3 = 0 THEN '/' ELSE '' END AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE -c_custkey END AS id, CAST(c_nationkey AS BIGINT) AS parent FROM customer",
    ctes=False,
)
def _(x):
    k = F.col("c_custkey")
    row = fmt.row_form(k % 3 == 0, F.when(k % 5 != 0, F.col("c_name")), k, -k, F.col("c_nationkey").cast("long"))
    return table(x.spark, x.sf_dir, "customer").select(k.alias("k"), F.inline(F.array(row)))
