"""Operators on small frames: odd values, ties, empty tables, documented quirks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from snapledger.functions import fmt
from snapledger.functions import paths as P
from snapledger.operators import diff, history, index, plan, reconcile, status, tree
from snapledger.sources import readers

ITEM = "snapshot string, ord long, type string, relpath string, ext string, size long, mtime double, sha256 string, dev long, ino long"
NODE = "sha256 string, anchor_path string, fileid long, remote_hash string, size long"
HOLDER = "sha256 string, snapshot string, relpath string, pos long, size long"
ROOT = "/B/_snapshots"


def items(spark, *rows, snapshot="s1"):
    return spark.createDataFrame([(snapshot, i, "file", p, ".txt", 1, t, h, None, None) for i, (p, h, t) in enumerate(rows)], ITEM)


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("raw, want", [(None, "/"), ("", "/"), (" a//b/ ", "/a/b"), ("/", "/"), ("//", "/"), ("/a", "/a"), ("é/ü", "/é/ü")])
def test_norm_remote(spark, raw, want):
    assert value(spark, P.norm_remote(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("name, want", [(".bashrc", None), ("a.tar.gz", ".gz"), ("x.", "."), ("dir.d/file", None), ("a.b/c.txt", ".txt"), ("..a", None), ("", None)])
def test_ext(spark, name, want):
    assert value(spark, P.ext(F.lit(name))) == want


@pytest.mark.parametrize("path, want", [("a/b", True), ("a/../b", True), ("../b", False), ("a/../../b", False), ("/etc", False), ("a/./b/../..", True)])
def test_safe_paths(spark, path, want):
    assert value(spark, P.safe_under_base(F.lit(path))) is want


def test_snapshot_segments(spark):
    p = F.lit("/B/_snapshots/2024/x/_snapshots/y")
    assert value(spark, P.snapshot_segment(p)) == "2024" and value(spark, P.snapshot_after_marker(p)) == "2024"
    assert value(spark, P.snapshot_segment(F.lit("/a/b"))) is None and value(spark, P.snapshot_segment(F.lit("/a/_snapshots"))) is None
    assert value(spark, P.object_path(F.lit("/o"), F.lit("a"), F.lit(""))) == "/o/zz/a"


def test_formats(spark):
    assert value(spark, fmt.fmt_duration(F.lit(None).cast("long"))) == "N/A" and value(spark, fmt.fmt_duration(F.lit(3661))) == "1h1m1s"
    assert value(spark, fmt.percent(F.lit(1), F.lit(0))) == "N/A" and value(spark, fmt.iso_utc(F.lit(0.0))) is None
    assert str(value(spark, fmt.snapshot_time(F.lit("2024-01-02__03-04-05")))) == "2024-01-02 03:04:05" and value(spark, fmt.snapshot_time(F.lit("latest"))) is None


def test_diff_rules(spark):
    cur = items(spark, ("same", "A", 1.0), ("time", "a", 2.0), ("nulls", None, None), ("new", "x", 1.0), ("twice", "old", 1.0), ("twice", "a", 1.0))
    ref = items(spark, ("same", "a", 1.0), ("time", "a", 1.0), ("nulls", "", None), ("gone", "y", 1.0), ("twice", "a", 1.0))
    d = diff.manifest_diff(cur, ref)
    assert got(d, "relpath", "status") == [("gone", "deleted"), ("new", "new"), ("nulls", "identical"), ("same", "identical"), ("time", "changed"), ("twice", "identical")]
    assert diff.manifest_diff(cur.limit(0), ref.limit(0)).count() == 0


def test_diff_partitions_both_sides(spark):
    rng = random.Random(3)
    for _ in range(3):
        a, b = ([(f"p{k}", rng.choice("xyz"), float(rng.randint(0, 1))) for k in rng.sample(range(30), 18)] for _ in range(2))
        n = dict(got(diff.diff_stats(diff.manifest_diff(items(spark, *a), items(spark, *b))), "status", "n"))
        same = n.get("identical", 0) + n.get("changed", 0)
        assert same + n.get("new", 0) == len(a) and same + n.get("deleted", 0) == len(b)


def plain_retention(nodes, holders, keep, delete):
    out = {}
    for sha, anchor, fileid, *_ in nodes:
        mine = [h for h in holders if h[0] == sha]
        lost = anchor.split("/")[3] in delete
        if not lost and not any(h[1] in delete for h in mine):
            continue
        kept = [h for h in mine if h[1] in keep]
        if lost and not kept:
            out[sha] = ("drop_node", None)
        elif lost:
            newest = max(h[1] for h in kept)
            out[sha] = ("promote", f"{ROOT}/{newest}/" + next(h[2] for h in kept if h[1] == newest))
        else:
            out[sha] = ("trim", None)
    return out


def test_retention_equals_nested_loops(spark):
    rng = random.Random(5)
    snaps = [f"s{k}" for k in range(6)]
    for _ in range(3):
        nodes, holders = [], []
        for k in range(25):
            mine = sorted({(rng.choice(snaps), f"f{rng.randint(0, 3)}") for _ in range(rng.randint(1, 4))})
            holders += [(f"h{k}", s, p, i, 1) for i, (s, p) in enumerate(mine)]
            s, p = mine[0]
            nodes.append((f"h{k}", f"{ROOT}/{s}/{p}", k or None, None, 1))
        keep, delete = {"s2", "s4"}, {"s0", "s1"}
        r = plan.retention(
            spark.createDataFrame(nodes, NODE), spark.createDataFrame(holders, HOLDER), spark.createDataFrame([(s,) for s in keep], "snapshot string"), spark.createDataFrame([(s,) for s in delete], "snapshot string"), ROOT
        )
        assert {a: (b, c) for a, b, c in ((x["sha256"], x["action"], x["new_anchor"]) for x in r.collect())} == plain_retention(nodes, holders, keep, delete)


@pytest.mark.parametrize("strategy, stored, lost, want", [
    ("conservative", "1101", "", [("2", "abort")]),
    ("optimistic", "1101", "", [("2", "build"), ("3", "delete_snapshot"), ("3", "rebuild")]),
    ("optimistic", "1110", "", [("3", "build")]),
    ("aggressive", "1011", "", [("1", "build"), ("2", "delete_snapshot"), ("2", "rebuild"), ("3", "delete_snapshot"), ("3", "rebuild")]),
    ("optimistic", "0000", "", [("0", "build"), ("1", "build"), ("2", "build"), ("3", "build")]),
])
def test_gap_plans(spark, strategy, stored, lost, want):
    rows = [(str(k), True, stored[k] == "1", str(k) not in lost, str(k - 1) if k else None) for k in range(4)]
    dim = spark.createDataFrame(rows, "snapshot string, is_local boolean, is_remote boolean, has_manifest boolean, ref_snapshot string")
    assert got(plan.gap_actions(dim, strategy), "snapshot", "action") == want


def test_time_travel_ends_at_the_index(spark):
    h = spark.createDataFrame([("a", "s1", "x", 0, 1), ("a", "s2", "x", 1, 1), ("a", "s2", "y", 2, 1), ("b", "s2", "z", 0, 1)], HOLDER)
    t = index.time_travel(h, spark.createDataFrame([("s1",), ("s2",), ("s3",)], "snapshot string"), ROOT)
    assert got(t, "as_of", "sha256", "n_holders", "anchor_path") == [
        ("s1", "a", 1, f"{ROOT}/s1/x"), ("s2", "a", 3, f"{ROOT}/s1/x"), ("s2", "b", 1, f"{ROOT}/s2/z"), ("s3", "a", 3, f"{ROOT}/s1/x"), ("s3", "b", 1, f"{ROOT}/s2/z"),
    ]


def test_rebuilt_index_verifies(spark):
    it = items(spark, ("a", "x", 1.0), ("b", "x", 1.0), ("c", "", 1.0), ("", "y", 1.0), ("d", "Z", 1.0))
    nodes, holders = index.build_nodes(it, ROOT), index.build_holders(it)
    assert got(nodes, "sha256", "n_holders") == [("x", 2), ("z", 1)]
    assert got(index.classify_holders(holders, it), "verdict") == [("ok",)] * 3
    assert reconcile.missing_in_index(it.filter("relpath <> ''"), nodes).count() == 0


def test_enrich_prefers_anchor_then_first_holder(spark):
    n = spark.createDataFrame([("a", f"{ROOT}/s1/x", None, None, 1), ("b", f"{ROOT}/s1/q", None, "h", 1), ("c", "/no", 7, None, 1), ("d", "/no", None, None, 1)], NODE)
    h = spark.createDataFrame([("a", "s2", "x", 1, 1), ("b", "s2", "q", 1, 1), ("b", "s3", "q", 2, 1)], HOLDER)
    r = spark.createDataFrame([(f"{ROOT}/s1/x", 1, "r1"), (f"{ROOT}/s2/x", 2, "r2"), (f"{ROOT}/s3/q", 3, "r3")], "path string, fileid long, hash string")
    assert [tuple(x) for x in index.enrich(n, h, r, ROOT).orderBy("sha256").select("sha256", "fileid", "remote_hash").collect()] == [("a", 1, "r1"), ("b", 3, "h"), ("d", None, None)]


def test_roll_up_all_cases(spark):
    cases = list(itertools.product((0, 1, 2), ("ok", "running", "failed"), (0, 1)))
    s, c = status.roll_up(F.col("sync"), F.col("job"), F.col("failed"))
    for r in spark.createDataFrame(cases, "sync int, job string, failed int").select("*", s.alias("s"), c.alias("c")).collect():
        worst = r.sync == 2 or r.job == "failed"
        assert r.s == ("CRITICAL" if worst else "WARNING" if r.failed else "RUNNING" if r.job == "running" else "WARNING" if r.sync else "OK")
        assert r.c == (2 if worst else 1 if r.sync or r.failed else 0)


def test_index_reader_keeps_what_is_good(spark):
    doc = '{"version":1,"items":{"AA":{"anchor_path":"/p","fileid":"f12","holders":["s1",{"snapshot":"s2","relpath":"r"},3]},"bb":"junk","cc":{"holders":[]},"dd":{}}}'
    n = readers.index_nodes(spark.createDataFrame([(doc,), ("not json",), (None,), ("[]",)], "value string"))
    assert [tuple(x) for x in n.orderBy("sha256").select("sha256", "node_kind", "fileid").collect()] == [("aa", "dict", 12), ("bb", "other", None), ("cc", "dict", None), ("dd", "dict", None)]
    h = readers.index_holders(n).orderBy("pos").collect()
    assert [(x.pos, x.holder_kind, x.snapshot, x.relpath) for x in h] == [(0, "string", "s1", None), (1, "dict", "s2", "r"), (2, "string", "3", None)]


def test_manifest_reader(spark, tmp_path):
    (tmp_path / "2024-01-01-000000.json").write_text('{"schema":3,"snapshot":"x","items":[{"type":"dir","relpath":""},{"type":"file","relpath":"a","size":1,"mtime":1.5,"sha256":"AB","inode":{"dev":1,"ino":2,"nlink":1}}]}')
    (tmp_path / "2024-01-02-000000.json").write_text("{broken")
    t = readers.manifest_items(readers.manifests(spark, str(tmp_path)))
    assert [(r.snapshot, r.ord, r.type, r.relpath, r.mtime) for r in t.orderBy("ord").collect()] == [("2024-01-01-000000", 0, "dir", "", None), ("2024-01-01-000000", 1, "file", "a", 1.5)]


def test_missing_index_can_be_empty(spark, tmp_path):
    assert readers.read_index(spark, str(tmp_path / "none.json"), on_error="empty").count() == 0
    with pytest.raises(Exception):
        readers.read_index(spark, str(tmp_path / "none.json")).count()


def test_stubs_files_and_settings(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt.meta.json").write_text('{"type":"hardlink","sha256":"ab","fileid":5}')
    (tmp_path / "d" / "a.txt").write_text("hello")
    assert [(r.type, r.fileid) for r in readers.stubs(spark, str(tmp_path)).collect()] == [("hardlink", 5)]
    assert readers.files(spark, str(tmp_path)).filter(F.endswith("path", F.lit("a.txt"))).first()["sha256"] == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    assert readers.settings({"a": "1", "b": "2"}, readers.env_lines("# c\nexport a='3'\nb=\n\nbad"), {"c": None}) == {"a": "3", "b": "2"}


def test_circles_end(spark):
    t = spark.createDataFrame([(1, 2, "a", True), (2, 1, "b", True), (3, None, "r", True), (4, 3, "c", False), (5, 9, "lost", False)], "id int, parent_id int, name string, is_folder boolean")
    up = tree.resolve_up(t, spark.createDataFrame([(1,), (4,), (5,)], "id int"))
    assert [(r.id, r.path, r.complete) for r in up.orderBy("id").collect()] == [(1, "/b/a", False), (4, "/r/c", True), (5, "/lost", False)]
    assert got(tree.flatten(t), "id", "path") == [(3, "/r"), (4, "/r/c")]


def test_upsert_twice_is_once(spark):
    have = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    once = plan.upsert_new(have, new, "k")
    assert got(once, "k", "v") == got(plan.upsert_new(once, new, "k"), "k", "v") == [(1, "a"), (2, "c")]


def test_empty_history(spark):
    runs = spark.createDataFrame([], "run_id long, snapshot_name string, status string, started_at timestamp_ntz, duration_sec long, bytes_uploaded long, gap_backfill_mode long, error_message string")
    assert tuple(history.performance(runs, "2024-01-31 00:00:00").first()) == (0, None, None, None, None, None)
    assert history.newest(runs, 5).count() == 0


def test_unique_names_take_free_numbers(spark):
    rows = list(enumerate(["a.txt", "a.txt", "a (1).txt", "b", "b", "b (2)", "c.tar.gz", "a.txt", "a (1).txt"]))
    names = spark.createDataFrame(rows, "ord long, name string")
    assert [r[0] for r in plan.unique_names(names).orderBy("ord").select("unique_name").collect()] == ["a.txt", "a (2).txt", "a (1).txt", "b", "b (1)", "b (2)", "c.tar.gz", "a (3).txt", "a (1) (1).txt"]
    present = spark.createDataFrame([("c.tar.gz",), ("c.tar (1) [x].gz",), ("b",)], "name string")
    got = {r["ord"]: r["unique_name"] for r in plan.unique_names(names, present, "x").collect()}
    assert got[6] == "c.tar (2) [x].gz" and got[3] == "b (1) [x]" and got[4] == "b (2) [x]" and got[0] == "a.txt" and got[1] == "a (1) [x].txt"
    assert plan.unique_names(names.limit(0)).count() == 0


def test_match_anchors_once_a_node(spark):
    nodes = spark.createDataFrame([("a", "/p", 1, "h", 1), ("b", "/q", 9, "h", 1), ("c", "", 3, "h", 1), ("d", None, 3, "h", 1), ("e", "/r", None, "h", 1)], NODE)
    remote = spark.createDataFrame([("/q", 5, "x", 1), ("/q", 6, "y", 1), ("/r", None, "h", 1), ("/p2", 1, "h", 1)], "path string, fileid long, hash string, size long")
    assert got(reconcile.match_anchors(nodes, remote), "sha256", "how", "moved") == [("a", "fileid", True), ("b", "path", False), ("e", "path", False)]


def test_rows_without_inode_stand_alone(spark):
    it = items(spark, ("a", "x", 1.0), ("b", "x", 1.0), ("c", "y", 1.0))
    assert index.holders_after_run(it, spark.createDataFrame([], HOLDER), "first_inode_only").count() == 3
    plan_rows = plan.full_write(it, spark.createDataFrame([], NODE), spark.createDataFrame([], HOLDER), ROOT)
    assert got(plan_rows, "relpath", "action") == [("a", "upload"), ("b", "stub"), ("c", "upload")]


def test_autofix_and_anchors(spark):
    nodes = spark.createDataFrame([("a", "/old", 1, "h", 1), ("b", None, 2, "h", 1), ("c", "", 3, "h", 1)], NODE)
    holders = spark.createDataFrame([("a", "s2", "x", 1, 1), ("a", "s1", "y", 0, 1), ("b", "", "z", 0, 1), ("b", "s3", "z", 1, 1)], HOLDER)
    stubs = spark.createDataFrame([("A", "/s1", "/old"), ("b", "/s2", "/else"), ("zz", "/s3", "/old")], "sha256 string, stub_path string, anchor_path string")
    known = nodes.withColumn("anchor_path", F.when(F.col("sha256") == "b", "/new").otherwise(F.col("anchor_path")))
    fixed = plan.autofix(known, holders, stubs, nodes.filter("sha256 IN ('a', 'c')"), ROOT)
    assert got(fixed, "sha256", "action", "path") == [("a", "promote", "/old"), ("b", "rewrite_stub", "/s2"), ("zz", "delete_stub", "/s3")]
    anchors = index.set_missing_anchors(nodes, holders, ROOT)
    assert {(r.sha256, r.anchor_path, r.was_set) for r in anchors.collect()} == {("a", "/old", False), ("b", f"{ROOT}/s3/z", True), ("c", None, False)}
    assert index.set_missing_anchors(nodes, holders, ROOT, reset=True).filter("fileid IS NOT NULL OR remote_hash IS NOT NULL").count() == 0


def test_alerts_sort_a_host_across_pieces(spark, tmp_path):
    from snapledger.streaming import monitor

    rng = random.Random(4)
    rows = [(f"h{k % 2}", k, rng.choice(["OK", "BAD", "WORSE"])) for k in range(400)]
    mixed = rows[:]
    rng.shuffle(mixed)
    spark.createDataFrame(mixed, "host string, ts long, status string").write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        s = spark.readStream.schema("host string, ts long, status string").parquet(str(tmp_path / "in"))
        found = got(monitor.drain(monitor.alerts_on_change(s), str(tmp_path / "out"), "append"), "host", "ts", "before", "status")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, last = [], {}
    for host, ts, state in rows:
        if last.get(host, "OK") != state:
            want.append((host, ts, last.get(host, "OK"), state))
        last[host] = state
    assert found == sorted(want)


def test_deep_trees(spark):
    t = spark.createDataFrame([(k, k - 1 if k else None, f"n{k}", True) for k in range(120)], "id int, parent_id int, name string, is_folder boolean")
    assert tree.flatten(t).filter("lvl = 120").count() == 1
    assert tree.resolve_up(t, spark.createDataFrame([(119,)], "id int")).first()["depth"] == 120


def test_settings_by_precedence():
    s = readers.effective_settings({"host": "d", "port": "1", "token": ""}, {"host": "f", "token": "t"}, {"host": "p", "timeout": "5"}, {"host": ""}, {"port": 9, "token": None})
    assert s == {"host": "p", "port": 9, "token": "t", "timeout": 5}
    with pytest.raises(ValueError):
        readers.effective_settings({"token": ""})


def test_walk_rows(spark):
    e = [("", 0o040755, 0, 1.0, 1, 1, 2, None), ("b", 0o100644, 3, 1.0, 1, 7, 2, None), ("a", 0o100644, 3, 1.0, 1, 7, 2, None), ("l", 0o120777, 1, 1.0, 1, 9, 1, "a"), ("pipe", 0o010644, 0, 1.0, 1, 8, 1, None), ("one", 0o100644, 1, 1.0, None, None, 1, None)]
    r = readers.walk_rows(spark.createDataFrame(e, "path string, mode int, size long, mtime double, dev long, ino long, nlink int, target string"))
    assert [tuple(x) for x in r.select("type", "relpath", "hardlink_of", "hardlink_master", "target").orderBy("relpath").collect()] == [("dir", "", None, None, None), ("file", "a", None, True, None), ("file", "b", "a", False, None), ("symlink", "l", None, None, "a"), ("file", "one", None, None, None)]
