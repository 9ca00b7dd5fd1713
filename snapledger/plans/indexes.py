"""Queries: the inverted index and its agreement with what it describes."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.operators import index, reconcile
from snapledger.plans.registry import query
from snapledger.sources.fixtures import ROOT, SNAPSHOTS

S = SNAPSHOTS


@query(
    "A01_build_index",
    f"SELECT n.sha256, n.anchor_path, split_part(n.anchor_path, '/', 4) AS anchor_snapshot, n.size, h.c AS n_holders, h.s AS n_snapshots FROM content_node n JOIN (SELECT sha256, count(*) AS c, count(DISTINCT snapshot) AS s FROM holder GROUP BY sha256) h ON n.sha256 = h.sha256",
)
def _(x):
    return index.build_nodes(x.items, ROOT)


@query("A01_build_holders", "SELECT * FROM holder")
def _(x):
    return index.build_holders(x.items)


_INDEX_TO_3 = f", h3 AS (SELECT * FROM holder WHERE snapshot <= '{S[2]}'), cur AS (SELECT * FROM manifest_item WHERE snapshot = '{S[3]}')"


@query("A02_append_holders_complete", _INDEX_TO_3 + " SELECT sha256, snapshot, relpath FROM cur")
def _(x):
    return index.holders_after_run(x.manifest(3), x.holders.filter(F.col("snapshot") <= S[2]))


@query(
    "A02_append_holders_first_inode",
    _INDEX_TO_3 + " SELECT sha256, snapshot, relpath FROM (SELECT *, row_number() OVER (PARTITION BY dev, ino ORDER BY ord) AS nth FROM cur) WHERE nth = 1",
)
def _(x):
    return index.holders_after_run(x.manifest(3), x.holders.filter(F.col("snapshot") <= S[2]), "first_inode_only")


@query(
    "A04_stub_ratio",
    """, m AS (SELECT sha256, snapshot, max(a) AS a FROM (SELECT sha256, snapshot, 0 AS a FROM holder UNION ALL SELECT sha256, split_part(anchor_path, '/', 4), 1 FROM content_node) GROUP BY ALL)
SELECT snapshot, count(*) AS total, count(*) FILTER (a = 0) AS stubs, count(*) FILTER (a = 0) / count(*) AS ratio FROM m GROUP BY snapshot""",
)
def _(x):
    return index.stub_ratio(x.nodes, x.holders, ROOT)


@query(
    "A05_time_travel",
    f"SELECT s.snapshot AS as_of, h.sha256, count(*)::BIGINT AS n_holders, '{ROOT}/' || arg_min(h.snapshot || '/' || h.relpath, h.pos) AS anchor_path FROM holder h JOIN snap s ON h.snapshot <= s.snapshot GROUP BY ALL",
)
def _(x):
    return index.time_travel(x.holders, x.snapshots, ROOT)


@query(
    "A06_hard_links",
    """, m AS (SELECT *, count(*) OVER (PARTITION BY snapshot, dev, ino) AS nlink, first_value(relpath) OVER (PARTITION BY snapshot, dev, ino ORDER BY ord) AS master FROM manifest_item)
SELECT snapshot, relpath, nlink, relpath = master AS is_master, CASE WHEN relpath <> master THEN master END AS hardlink_of FROM m WHERE nlink > 1""",
)
def _(x):
    return index.hard_links(x.items)


@query("A07_snapshots_in_index", "SELECT snapshot, count(*)::BIGINT AS n FROM holder GROUP BY snapshot")
def _(x):
    return x.holders.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))


@query("A08_paths_of_content", "SELECT snapshot, sha256, string_agg(relpath, ',' ORDER BY relpath) AS paths FROM manifest_item GROUP BY ALL")
def _(x):
    return x.items.groupBy("snapshot", "sha256").agg(F.array_join(F.sort_array(F.collect_list("relpath")), ",").alias("paths"))


@query("A09_expected_snapshots", "SELECT sha256, string_agg(DISTINCT snapshot, ',' ORDER BY snapshot) AS snapshots FROM manifest_item GROUP BY ALL")
def _(x):
    return x.items.groupBy("sha256").agg(F.array_join(F.sort_array(F.collect_set("snapshot")), ",").alias("snapshots"))


@query(
    "W03_oldest_newest_holder",
    "SELECT sha256, arg_min(snapshot || '/' || relpath, pos) AS oldest, arg_max(snapshot || '/' || relpath, (snapshot, -pos)) AS newest FROM holder GROUP BY sha256",
)
def _(x):
    place = F.concat_ws("/", "snapshot", "relpath")
    return x.holders.groupBy("sha256").agg(F.min_by(place, "pos").alias("oldest"), F.max_by(place, F.struct(F.col("snapshot"), -F.col("pos"))).alias("newest"))


_REUSE = f""", c AS (SELECT * FROM manifest_item WHERE snapshot = '{S[3]}'), r AS (SELECT * FROM manifest_item WHERE snapshot = '{S[2]}'),
ri AS (SELECT dev, ino, arg_max(sha256, ord) AS sha256, arg_max(mtime, ord) AS mtime, arg_max(size, ord) AS size FROM r GROUP BY ALL),
j AS (SELECT c.relpath, r.sha256 AS ps, ri.sha256 AS s, r.relpath IS NOT NULL AND r.mtime = c.mtime AND r.size = c.size AS p, ri.ino IS NOT NULL AND {{cond}} AS i FROM c LEFT JOIN r ON c.relpath = r.relpath LEFT JOIN ri ON c.dev = ri.dev AND c.ino = ri.ino)
SELECT relpath, CASE WHEN p THEN 'path' WHEN i THEN 'inode' ELSE 'calculate' END AS how, CASE WHEN p THEN ps WHEN i THEN s END AS sha256 FROM j
"""


@query("J13_reuse_hashes_strict", _REUSE.replace("{cond}", "ri.mtime = c.mtime AND ri.size = c.size"))
def _(x):
    return index.reuse_hashes(x.manifest(3), x.manifest(2))


@query("J13_reuse_hashes_reference", _REUSE.replace("{cond}", "true"))
def _(x):
    return index.reuse_hashes(x.manifest(3), x.manifest(2), "reference")


_ENRICH = f""", n AS (SELECT * FROM content_node {{cond}}), c AS (SELECT sha256, -1 AS pos, anchor_path AS path FROM n UNION ALL SELECT h.sha256, h.pos, '{ROOT}/' || h.snapshot || '/' || h.relpath FROM holder h JOIN n ON n.sha256 = h.sha256),
b AS (SELECT c.sha256, arg_min(r.path, pos) AS found_path, arg_min(r.fileid, pos) AS fileid, arg_min(r.hash, pos) AS hash FROM c JOIN remote_object r ON c.path = r.path GROUP BY c.sha256)
SELECT n.sha256, b.found_path, b.fileid, coalesce(n.remote_hash, b.hash) AS remote_hash FROM n LEFT JOIN b ON n.sha256 = b.sha256
"""


@query("J11_enrich_missing", _ENRICH.replace("{cond}", "WHERE fileid IS NULL"))
def _(x):
    return index.enrich(x.nodes, x.holders, x.remote, ROOT)


@query("J12_enrich_forced", _ENRICH.replace("{cond}", ""))
def _(x):
    return index.enrich(x.nodes, x.holders, x.remote, ROOT, force=True)


@query(
    "C09_repair_anchors",
    f""", m AS (SELECT n.* FROM content_node n LEFT JOIN remote_object r ON n.anchor_path = r.path WHERE r.path IS NULL), h AS (SELECT h.*, m.anchor_path, '{ROOT}/' || snapshot || '/' || relpath AS path FROM holder h JOIN m ON m.sha256 = h.sha256)
SELECT sha256, CASE WHEN count(*) = count(*) FILTER (path = anchor_path) THEN 'drop_node' ELSE 'reanchor' END AS action, count(*) FILTER (path = anchor_path) AS dropped, arg_min(path, pos) FILTER (path <> anchor_path) AS new_anchor FROM h GROUP BY sha256""",
)
def _(x):
    lost = x.nodes.join(x.remote.select(F.col("path").alias("anchor_path")), "anchor_path", "left_anti")
    return index.repair_anchors(x.nodes, x.holders, lost, ROOT)


_BAD_HOLDERS = f""", bh AS (SELECT sha256, CASE WHEN ord % 31 = 0 THEN NULL WHEN ord % 37 = 0 THEN '2020-01-01-000000' ELSE snapshot END AS snapshot, CASE WHEN ord % 29 = 0 THEN 'wrong/' || relpath ELSE relpath END AS relpath, ord FROM holder),
mm AS (SELECT * FROM manifest_item WHERE ord % 41 <> 0)"""


def _bad_holders(x):
    o = F.col("ord")
    return x.holders.select("sha256", F.when(o % 31 == 0, None).when(o % 37 == 0, "2020-01-01-000000").otherwise(F.col("snapshot")).alias("snapshot"), F.when(o % 29 == 0, F.concat(F.lit("wrong/"), "relpath")).otherwise(F.col("relpath")).alias("relpath"))


@query(
    "J05_classify_holders",
    _BAD_HOLDERS + """, f AS (SELECT snapshot, sha256, arg_min(relpath, ord) AS first_path FROM mm GROUP BY ALL)
SELECT bh.sha256, bh.snapshot, bh.relpath, CASE WHEN bh.snapshot IS NULL THEN 'blank' WHEN bh.snapshot NOT IN (SELECT snapshot FROM mm) THEN 'no_manifest' WHEN f.first_path IS NULL THEN 'not_in_manifest' WHEN e.relpath IS NULL THEN 'path_mismatch' ELSE 'ok' END AS verdict,
CASE WHEN f.first_path IS NOT NULL AND e.relpath IS NULL THEN f.first_path END AS repaired_path
FROM bh LEFT JOIN f ON bh.snapshot = f.snapshot AND bh.sha256 = f.sha256 LEFT JOIN mm e ON e.snapshot = bh.snapshot AND e.sha256 = bh.sha256 AND e.relpath = bh.relpath""",
)
def _(x):
    return index.classify_holders(_bad_holders(x), x.items.filter("ord % 41 <> 0"))


@query(
    "J15_repair_holders",
    _BAD_HOLDERS + """, f AS (SELECT snapshot, sha256, arg_min(relpath, ord) AS first_path FROM mm GROUP BY ALL)
SELECT bh.sha256, bh.snapshot, CASE WHEN f.first_path IS NOT NULL AND e.relpath IS NULL THEN f.first_path ELSE bh.relpath END AS relpath
FROM bh LEFT JOIN f ON bh.snapshot = f.snapshot AND bh.sha256 = f.sha256 LEFT JOIN mm e ON e.snapshot = bh.snapshot AND e.sha256 = bh.sha256 AND e.relpath = bh.relpath
WHERE bh.snapshot IS NOT NULL AND (f.first_path IS NOT NULL OR bh.snapshot NOT IN (SELECT snapshot FROM mm))""",
)
def _(x):
    c = index.classify_holders(_bad_holders(x), x.items.filter("ord % 41 <> 0"))
    return c.filter("verdict IN ('ok', 'path_mismatch', 'no_manifest')").select("sha256", "snapshot", F.coalesce("repaired_path", "relpath").alias("relpath"))


_MATCH = """, j AS (SELECT n.*, i.path AS ip, i.fileid AS ii, i.hash AS ih, i.size AS isz, p.path AS pp, p.fileid AS pi, p.hash AS ph, p.size AS psz FROM content_node n LEFT JOIN remote_object i ON n.fileid = i.fileid LEFT JOIN remote_object p ON n.anchor_path = p.path),
m AS (SELECT sha256, anchor_path, CASE WHEN ip IS NOT NULL THEN 'fileid' WHEN pp IS NOT NULL THEN 'path' ELSE 'missing' END AS how,
  coalesce(fileid <> CASE WHEN ip IS NOT NULL THEN ii ELSE pi END, false) AS id_differs, coalesce(remote_hash <> CASE WHEN ip IS NOT NULL THEN ih ELSE ph END, false) AS hash_differs,
  coalesce(size <> CASE WHEN ip IS NOT NULL THEN isz ELSE psz END, false) AS size_differs, coalesce(ip <> anchor_path, false) AS moved, remote_hash IS NULL AS no_hash FROM j)
"""
_UNKNOWN = f""", u AS (SELECT path, fileid, size FROM remote_object WHERE NOT (path LIKE '%.meta.json' OR path LIKE '%/.upload_complete') AND fileid NOT IN (SELECT fileid FROM content_node WHERE fileid IS NOT NULL)
  AND path NOT IN (SELECT anchor_path FROM content_node UNION SELECT '{ROOT}/' || snapshot || '/' || relpath FROM holder))
"""


@query("J02_match_anchors", _MATCH + "SELECT * FROM m")
def _(x):
    return reconcile.match_anchors(x.nodes, x.remote)


@query("J03_unknown_objects", _UNKNOWN + "SELECT * FROM u")
def _(x):
    return reconcile.unknown_objects(x.nodes, x.holders, x.remote, ROOT)


_CATEGORIES = """, rep AS (SELECT 'missing' AS category, count(*) FILTER (how = 'missing') AS n, true AS is_issue FROM m UNION ALL SELECT 'fileid_mismatch', count(*) FILTER (id_differs), true FROM m UNION ALL SELECT 'hash_mismatch', count(*) FILTER (hash_differs), true FROM m
UNION ALL SELECT 'size_mismatch', count(*) FILTER (size_differs), true FROM m UNION ALL SELECT 'moved', count(*) FILTER (moved), false FROM m UNION ALL SELECT 'hash_missing', count(*) FILTER (no_hash), false FROM m UNION ALL SELECT 'ok', count(*) FILTER (how <> 'missing'), false FROM m
UNION ALL SELECT 'unknown', count(*), true FROM u)
"""


@query("C17_tamper_report", _MATCH + _UNKNOWN + _CATEGORIES + "SELECT * FROM rep")
def _(x):
    return reconcile.tamper_report(x.nodes, x.holders, x.remote, ROOT)


@query("A10_issue_count", _MATCH + _UNKNOWN + _CATEGORIES + "SELECT sum(n) FILTER (is_issue)::BIGINT AS issues, count(*) FILTER (is_issue AND n > 0) AS categories FROM rep")
def _(x):
    t = reconcile.tamper_report(x.nodes, x.holders, x.remote, ROOT)
    return t.agg(F.sum(F.when(F.col("is_issue"), F.col("n"))).alias("issues"), F.count_if(F.col("is_issue") & (F.col("n") > 0)).alias("categories"))


@query("L04_first_findings", _MATCH + "SELECT how, sha256, nth FROM (SELECT how, sha256, row_number() OVER (PARTITION BY how ORDER BY sha256) AS nth FROM m) WHERE nth <= 10")
def _(x):
    return reconcile.first_of_each(reconcile.match_anchors(x.nodes, x.remote).select("how", "sha256"), "how", ["sha256"], 10)


@query("K04_report_document", _MATCH + "SELECT how, count(*) AS n, string_agg(CASE WHEN nth <= 50 THEN sha256 END, ',' ORDER BY sha256) AS details FROM (SELECT *, row_number() OVER (PARTITION BY how ORDER BY sha256) AS nth FROM m) GROUP BY how")
def _(x):
    m = reconcile.match_anchors(x.nodes, x.remote).select("how", "sha256")
    first = reconcile.first_of_each(m, "how", ["sha256"], 50).groupBy("how").agg(F.array_join(F.sort_array(F.collect_list("sha256")), ",").alias("details"))
    return m.groupBy("how").agg(F.count(F.lit(1)).alias("n")).join(first, "how")


@query("J04_missing_in_index", "SELECT m.sha256, m.snapshot, m.relpath FROM manifest_item m WHERE sha256 NOT IN (SELECT sha256 FROM content_node WHERE rn % 13 <> 0)")
def _(x):
    return reconcile.missing_in_index(x.items, x.nodes.filter("rn % 13 <> 0"))


@query("J04_missing_holder", "SELECT DISTINCT m.sha256, m.snapshot FROM manifest_item m WHERE sha256 IN (SELECT sha256 FROM holder WHERE ord % 5 <> 0) AND NOT EXISTS (SELECT 1 FROM holder h WHERE h.ord % 5 <> 0 AND h.sha256 = m.sha256 AND h.snapshot = m.snapshot)")
def _(x):
    return reconcile.missing_holder(x.items, x.holders.filter("ord % 5 <> 0"))


@query("J06_orphaned_holders", f"SELECT sha256, snapshot, relpath FROM holder WHERE snapshot = '{S[3]}'")
def _(x):
    there = x.remote.filter(F.endswith("path", F.lit("/.upload_complete"))).select(F.split_part("path", F.lit("/"), F.lit(4)).alias("snapshot"))
    return reconcile.orphaned_holders(x.holders, there)


@query(
    "J08_check_stubs",
    """, o AS (SELECT fileid, max(path) AS path FROM remote_object WHERE fileid IS NOT NULL GROUP BY fileid) SELECT s.stub_path, lower(s.sha256) AS sha256, CASE WHEN lower(s.sha256) IN (SELECT sha256 FROM content_node) THEN 'hash' WHEN s.anchor_path IN (SELECT anchor_path FROM content_node) THEN 'anchor' ELSE 'none' END AS in_index,
CASE WHEN s.fileid IS NULL THEN 'no_fileid' WHEN o.path IS NULL THEN 'object_missing' WHEN o.path <> s.anchor_path THEN 'moved' ELSE 'ok' END AS object_state FROM stub s LEFT JOIN o ON s.fileid = o.fileid""",
)
def _(x):
    return reconcile.check_stubs(x.stubs, x.nodes, x.remote)


@query("J07_stubs_not_in_index", "SELECT stub_path FROM stub WHERE lower(sha256) NOT IN (SELECT sha256 FROM content_node)")
def _(x):
    return x.stubs.withColumn("sha256", F.lower("sha256")).join(x.nodes.select("sha256"), "sha256", "left_anti").select("stub_path")


@query("J10_index_anchors", "SELECT n.sha256, CASE WHEN r.path IS NULL THEN 'missing' WHEN n.fileid <> r.fileid THEN 'fileid_mismatch' ELSE 'ok' END AS state FROM content_node n LEFT JOIN remote_object r ON n.anchor_path = r.path")
def _(x):
    j = x.nodes.join(x.remote.select(F.col("path").alias("anchor_path"), F.col("fileid").alias("rid")), "anchor_path", "left")
    return j.select("sha256", F.when(F.col("rid").isNull(), "missing").when(F.col("fileid") != F.col("rid"), "fileid_mismatch").otherwise("ok").alias("state"))


@query("C16_anchor_timeline", "SELECT n.sha256, anchor_path, split_part(anchor_path, '/', 4) AS snapshot FROM content_node n WHERE NOT EXISTS (SELECT 1 FROM holder h WHERE h.sha256 = n.sha256 AND h.snapshot = split_part(anchor_path, '/', 4) AND h.ord % 7 <> 0)")
def _(x):
    return reconcile.anchor_timeline(x.nodes, x.holders.filter("ord % 7 <> 0"))


@query("C14_hash_backfill", "SELECT n.sha256, CASE WHEN c.sha = n.sha256 THEN 'match' ELSE 'mismatch' END AS state FROM content_node n JOIN (SELECT 1000000 + rn AS fileid, CASE WHEN rn % 62 = 0 THEN 'x' || sha256 ELSE sha256 END AS sha FROM content_node WHERE rn % 93 <> 0) c ON n.fileid = c.fileid WHERE n.remote_hash IS NULL")
def _(x):
    sums = x.nodes.filter("rn % 93 <> 0").select((F.col("rn") + 1000000).alias("fileid"), F.when(F.col("rn") % 62 == 0, F.concat(F.lit("x"), "sha256")).otherwise(F.col("sha256")).alias("sha"))
    j = x.nodes.filter("remote_hash IS NULL").join(sums, "fileid")
    return j.select("sha256", F.when(F.col("sha") == F.col("sha256"), "match").otherwise("mismatch").alias("state"))


@query("C13_fileid_candidates", "SELECT sha256, anchor_path FROM content_node WHERE fileid IS NULL")
def _(x):
    return x.nodes.filter("fileid IS NULL").select("sha256", "anchor_path")


@query("L05_sample_per_snapshot", "SELECT snapshot, stub_path, rank FROM (SELECT snapshot, stub_path, row_number() OVER (PARTITION BY snapshot ORDER BY md5('1' || stub_path), stub_path) AS rank FROM stub) WHERE rank <= 100")
def _(x):
    return reconcile.hashed_sample(x.stubs.select("snapshot", "stub_path"), "stub_path", 100, "snapshot")


@query(
    "C15_checksum_sample",
    "SELECT sha256, anchor_path, rank, CASE WHEN rn % 3 = 0 THEN 'unknown' WHEN rn % 3 = 1 THEN 'match' ELSE 'mismatch' END AS state FROM (SELECT *, row_number() OVER (ORDER BY md5('1' || sha256), sha256) AS rank FROM content_node) WHERE rank <= 50",
)
def _(x):
    sums = x.nodes.filter("rn % 3 <> 0").select(F.col("anchor_path").alias("path"), F.when(F.col("rn") % 3 == 1, F.upper("sha256")).otherwise(F.concat(F.lit("x"), "sha256")).alias("sha256"))
    return reconcile.check_sums(x.nodes, sums, 50)


@query("W08_every_tenth", "SELECT snapshot, stub_path, rank FROM (SELECT snapshot, stub_path, row_number() OVER (PARTITION BY snapshot ORDER BY md5('1' || stub_path), stub_path) AS rank FROM stub) WHERE rank <= 100 AND rank % 10 = 0")
def _(x):
    return reconcile.hashed_sample(x.stubs.select("snapshot", "stub_path"), "stub_path", 100, "snapshot").filter("rank % 10 = 0")


@query("L06_hash_share", "SELECT stub_path FROM stub WHERE substr(md5('2' || stub_path), 1, 2) < '40'")
def _(x):
    return x.stubs.filter(F.substring(F.md5(F.concat(F.lit("2"), "stub_path")), 1, 2) < "40").select("stub_path")


@query("J20_anchor_is_holder", f"SELECT n.sha256, h.pos FROM content_node n JOIN holder h ON h.sha256 = n.sha256 AND '{ROOT}/' || h.snapshot || '/' || h.relpath = n.anchor_path")
def _(x):
    h = x.holders.select("sha256", "pos", F.concat_ws("/", F.lit(ROOT), "snapshot", "relpath").alias("anchor_path"))
    return x.nodes.select("sha256", "anchor_path").join(h, ["sha256", "anchor_path"]).select("sha256", "pos")
