"""Plans: rows of intended actions. Nothing here performs an action."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapledger.functions import paths as P

BLOCKED_ORDER = ("delete_snapshot", "build", "rebuild")


def choose_mode(ratios: DataFrame, snapshots: DataFrame, current: str, min_ratio: float = 0.5, min_files: int = 100) -> DataFrame:
    """Whether to copy from the newest other complete snapshot (TURBO) or to write all (SAFE)."""
    basis = snapshots.filter((F.col("snapshot") != current) & F.col("complete")).agg(F.max("snapshot").alias("snapshot"))
    j = basis.join(ratios, "snapshot", "left")
    turbo = (F.col("total") >= min_files) & (F.col("ratio") >= min_ratio)
    return j.select(F.col("snapshot").alias("basis"), "total", "ratio", F.when(turbo, "TURBO").otherwise("SAFE").alias("mode"))


def template_choice(manifest: DataFrame, template: DataFrame, min_overlap: float = 0.7, min_folders: int = 50) -> DataFrame:
    """Cost of copying a folder template (1 + additions + deletions) against creating every folder."""
    from snapledger.operators.diff import set_delta

    sides = set_delta(manifest, template).agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("shared", "only_left", "only_right")])
    n = F.col("shared") + F.col("only_left")
    copy = 1 + F.col("only_left") + F.col("only_right")
    use = (n >= min_folders) & (F.try_divide(F.col("shared"), n) >= min_overlap) & (copy < n)
    return sides.select(n.alias("n_manifest"), F.col("shared").alias("n_shared"), F.col("only_left").alias("n_add"), F.col("only_right").alias("n_delete"),
        copy.alias("copy_cost"), F.when(F.coalesce(use, F.lit(False)), "template").otherwise("single").alias("choice"))


def _seen_inode(rows: DataFrame) -> Column:
    key = F.when(F.col("dev").isNotNull() & F.col("ino").isNotNull(), F.concat_ws(":", "dev", "ino"))
    # rows without inode stand alone, each under its own path, and not together in one task
    first = F.row_number().over(Window.partitionBy("snapshot", F.coalesce(key, F.concat(F.lit("/"), F.col("relpath")))).orderBy("ord"))
    return F.when(key.isNotNull() & (first > 1), True).otherwise(False)


def full_write(items: DataFrame, nodes: DataFrame, holders: DataFrame, root: str) -> DataFrame:
    """What a full run does with each file: resume, upload or stub, and where a stub points.

    A file already held is resumed. Of the others, further names of an inode are stubs;
    contents with an anchor elsewhere are stubs; the first row of a content without one is
    uploaded and becomes the anchor of the rest.
    """
    rows = items.filter("type = 'file' AND coalesce(sha256, '') <> ''").select("snapshot", "ord", "relpath", "sha256", "dev", "ino", "size")
    held = holders.select("sha256", "snapshot", "relpath").distinct().withColumn("held", F.lit(True))
    rows = rows.join(held, ["sha256", "snapshot", "relpath"], "left").join(nodes.select("sha256", "anchor_path"), "sha256", "left")
    rows = rows.withColumn("path", F.concat_ws("/", F.lit(root), "snapshot", "relpath")).withColumn("again", _seen_inode(rows))
    fresh = F.col("held").isNull() & ~F.col("again") & P.blank(F.col("anchor_path"))
    first = F.min_by(F.when(fresh, F.col("path")), F.when(fresh, F.col("ord"))).over(Window.partitionBy("snapshot", "sha256"))
    rows = rows.withColumn("fresh", fresh).withColumn("new_anchor", first)
    action = (
        F.when(F.col("held"), "resume").when(F.col("fresh") & (F.col("path") == F.col("new_anchor")), "upload")
        .when(F.col("anchor_path") == F.col("path"), "resume").otherwise("stub")
    )
    target = F.when(action == "stub", F.coalesce(F.when(~P.blank(F.col("anchor_path")), F.col("anchor_path")), "new_anchor"))
    return rows.select("snapshot", "ord", "relpath", "sha256", action.alias("action"), target.alias("target"))


def delta_write(diff: DataFrame, nodes: DataFrame, folder: str) -> DataFrame:
    """Upload or stub for each new or changed row: a content not in the index is uploaded by its first row in write order."""
    rows = diff.filter(F.col("status").isin("new", "changed") & ~P.blank(F.col("sha256")))
    order = Window.partitionBy("sha256").orderBy(F.coalesce("ext", F.lit("")), "relpath")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("first", F.first("relpath").over(order))
    rows = rows.join(nodes.select("sha256", "anchor_path"), "sha256", "left")
    new = F.col("anchor_path").isNull()
    target = F.coalesce("anchor_path", F.concat(F.lit(f"{folder}/"), F.col("first")))
    return rows.select("relpath", "sha256", "status", F.when(new & (F.col("nth") == 1), "upload").otherwise("stub").alias("action"), target.alias("anchor"))


def object_store(items: DataFrame, remote: DataFrame, root: str) -> DataFrame:
    """Each content's object path and whether it must be uploaded."""
    rows = items.filter("type = 'file' AND coalesce(sha256, '') <> ''")
    t = rows.groupBy(P.object_path(F.lit(root), F.col("sha256"), F.col("ext")).alias("object_path")).agg(F.count(F.lit(1)).alias("n_stubs"), F.max("size").alias("size"))
    there = remote.select(F.col("path").alias("object_path")).distinct().withColumn("there", F.lit(True))
    return t.join(there, "object_path", "left").select("object_path", "n_stubs", "size", F.when(F.col("there"), "present").otherwise("upload").alias("action"))


def retention(nodes: DataFrame, holders: DataFrame, keep: DataFrame, delete: DataFrame, root: str) -> DataFrame:
    """What deleting snapshots does to each content that one of them holds or anchors.

    keep and delete have a column snapshot. Holders of touched nodes are kept only for
    kept snapshots; an anchor in a deleted snapshot moves to the newest keeper (the first
    held there), or the node goes if it has none. One pass, whatever the number of
    snapshots.
    """
    mark = F.broadcast(keep.select("snapshot", F.lit("keep").alias("fate")).unionByName(delete.select("snapshot", F.lit("delete").alias("fate"))))
    h = holders.join(mark, "snapshot", "left")
    keeper = F.col("fate") == "keep"
    per = h.groupBy("sha256").agg(
        F.count_if(keeper).alias("kept"), F.count_if(F.col("fate") == "delete").alias("deleted"), F.count(F.lit(1)).alias("held"),
        F.max_by(F.when(keeper, F.struct("snapshot", "relpath")), F.when(keeper, F.struct(F.col("snapshot"), -F.col("pos")))).alias("newest"),
    )
    a = nodes.select("sha256", "anchor_path", "fileid", P.snapshot_segment(F.col("anchor_path")).alias("snapshot")).join(mark, "snapshot", "left")
    j = a.join(per, "sha256", "left")
    lost = F.coalesce(F.col("fate") == "delete", F.lit(False))
    kept = F.coalesce("kept", F.lit(0))
    action = F.when(lost & (kept == 0), "drop_node").when(lost, "promote").otherwise("trim")
    to = F.when(action == "promote", F.concat_ws("/", F.lit(root), "newest.snapshot", "newest.relpath"))
    return j.filter(lost | (F.col("deleted") > 0)).select("sha256", action.alias("action"), to.alias("new_anchor"), kept.alias("kept"), (F.col("held") - kept).alias("dropped"),
        ((action == "promote") & F.col("fileid").isNull()).alias("needs_path_move"))


def snapshot_sets(snapshots: DataFrame) -> DataFrame:
    """keep = remote and local, delete = remote only, missing = local only."""
    fate = F.when(F.col("is_remote") & F.col("is_local"), "keep").when(F.col("is_remote"), "delete").when(F.col("is_local"), "missing").otherwise("none")
    return snapshots.select("snapshot", fate.alias("fate"))


def gaps(snapshots: DataFrame) -> DataFrame:
    """Local snapshots not stored: NEW after the last stored one, GAP before a stored one; with the later stored ones in a row's own list."""
    later = F.max(F.when(F.col("is_remote"), F.col("snapshot"))).over(Window.orderBy("snapshot").rowsBetween(1, Window.unboundedFollowing))
    n_later = F.count_if("is_remote").over(Window.orderBy("snapshot").rowsBetween(1, Window.unboundedFollowing))
    t = snapshots.withColumn("later", later).withColumn("n_later", n_later)
    return t.filter("is_local AND NOT is_remote").select("snapshot", F.when(F.col("later").isNull(), "NEW").otherwise("GAP").alias("kind"), "n_later")


def chain_state(snapshots: DataFrame) -> DataFrame:
    """Each stored snapshot's reference chain: OK, BROKEN_CHAIN or MISSING_MANIFEST."""
    refs = F.broadcast(snapshots.select(F.col("snapshot").alias("ref_snapshot"), F.col("is_remote").alias("ref_there")))
    state = F.when(~F.col("has_manifest"), "MISSING_MANIFEST").when(F.col("ref_snapshot").isNotNull() & ~F.coalesce("ref_there", F.lit(False)), "BROKEN_CHAIN").otherwise("OK")
    return snapshots.filter("is_remote").join(refs, "ref_snapshot", "left").select("snapshot", "ref_snapshot", state.alias("state"))


def gap_actions(snapshots: DataFrame, strategy: str = "optimistic") -> DataFrame:
    """Ordered actions that fill the gaps.

    Nothing stored: build all. conservative aborts at a gap; aggressive deletes and
    rebuilds all later stored snapshots; optimistic does so only from the first later one
    whose chain is not intact.
    """
    g = gaps(snapshots).select(F.col("snapshot").alias("gap"), "kind")
    chain = chain_state(snapshots).select(F.col("snapshot").alias("later"), "state")
    build = g.select("gap", F.when((F.col("kind") == "GAP") & F.lit(strategy == "conservative"), "abort").otherwise("build").alias("action"), F.col("gap").alias("snapshot"), F.lit(1).alias("step"))
    if strategy == "conservative":
        return build
    pairs = g.filter("kind = 'GAP'").join(F.broadcast(chain), F.col("later") > F.col("gap"))
    if strategy == "optimistic":
        broken = F.max(F.when(F.col("state") != "OK", 1).otherwise(0)).over(Window.partitionBy("gap").orderBy("later").rowsBetween(Window.unboundedPreceding, 0))
        pairs = pairs.withColumn("broken", broken).filter("broken = 1")
    both = pairs.select("gap", F.col("later").alias("snapshot"), F.inline(F.array(F.struct(F.lit("delete_snapshot").alias("action"), F.lit(0).alias("step")), F.struct(F.lit("rebuild").alias("action"), F.lit(2).alias("step")))))
    return build.unionByName(both.select("gap", "action", "snapshot", "step"))


def restore(nodes: DataFrame, holders: DataFrame, snapshot: str, prefix: str = "") -> DataFrame:
    """Files of a snapshot: the first path of a content is downloaded, further ones are linked to it; unsafe paths are refused."""
    h = holders.filter((F.col("snapshot") == snapshot) & F.startswith("relpath", F.lit(prefix)))
    w = Window.partitionBy("sha256").orderBy("relpath")
    h = h.withColumn("nth", F.row_number().over(w)).withColumn("source", F.first("relpath").over(w)).join(nodes.select("sha256", "fileid"), "sha256", "left")
    safe = P.safe_under_base(F.col("relpath"))
    action = F.when(~safe, "refuse").when(F.col("nth") > 1, "link").when(F.col("fileid").isNull(), "download_by_path").otherwise("download")
    return h.select("relpath", "sha256", "size", action.alias("action"), F.when(action == "link", F.col("source")).alias("link_to"))


def stub_rows(nodes: DataFrame, holders: DataFrame, root: str, skip_anchor: bool) -> DataFrame:
    """Stub to write for every holder of a node with a fileid, grouped by folder through dir."""
    path = F.concat_ws("/", F.lit(root), "snapshot", "relpath")
    j = holders.join(nodes.filter("fileid IS NOT NULL").select("sha256", "anchor_path", "fileid"), "sha256").withColumn("path", path)
    j = j.filter("path <> anchor_path") if skip_anchor else j
    payload = F.to_json(F.struct(F.lit("hardlink").alias("type"), "sha256", "size", "anchor_path", "fileid", "snapshot", "relpath"))
    return j.select(P.stub_path(F.col("path")).alias("stub_path"), P.dirname(F.col("path")).alias("dir"), "sha256", "fileid", payload.alias("payload"))


def parents(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """Distinct parent folders of ``paths`` and the id of each; those without one have to be made."""
    p = paths.select(P.dirname(F.col("path")).alias("dir")).distinct()
    j = p.join(folders.select(F.col("path").alias("dir"), "folderid"), "dir", "left")
    return j.select("dir", "folderid", P.depth(F.col("dir")).cast("long").alias("depth"), F.when(F.col("folderid").isNull(), "ensure_path").otherwise("known").alias("action"))


def unique_names(names: DataFrame, present: DataFrame | None = None, tag: str | None = None) -> DataFrame:
    """A name of its own for each row of ``names`` (ord, name), none of them in ``present`` (name).

    The first row of a name that is free keeps it; the others get ``base (n).ext``, or
    ``base (n) [tag].ext``, with the smallest numbers whose name neither stands among the
    names given nor in ``present``. Numbers as many as rows and names of that form are
    tried for each name, by an anti join.
    """
    taken = names.select("name") if present is None else names.select("name").union(present.select("name"))
    taken = taken.distinct()
    ext = F.coalesce(P.ext(F.col("name")), F.lit(""))
    base = F.substring(F.col("name"), F.lit(1), F.length("name") - F.length(ext))
    there = F.lit(0) if present is None else F.coalesce(F.col("there"), F.lit(0))
    rows = names if present is None else names.join(present.select("name", F.lit(1).alias("there")).distinct(), "name", "left")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("ord")) - 1 + there)
    wanted = rows.groupBy("name").agg(F.max("nth").alias("most")).filter("most > 0").withColumn("base", base).withColumn("ext", ext)
    suffix = F.lit(f" [{tag}]" if tag else "")
    # names of the form that stand in the way, counted by what they would number
    form = r"^(.*) \((\d+)\)" + (rf" \[{re.escape(tag)}\]" if tag else "") + r"(\.[^.]*)?$"
    numbered = taken.filter(F.regexp_like("name", F.lit(form))).select(F.concat(F.regexp_extract("name", form, 1), F.regexp_extract("name", form, 3)).alias("name"))
    blocked = numbered.groupBy("name").agg(F.count(F.lit(1)).alias("blocked"))
    tried = wanted.join(blocked, "name", "left").select("name", "most", "base", "ext", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most") + F.coalesce("blocked", F.lit(0)))).alias("n"))
    tried = tried.withColumn("unique_name", F.concat("base", F.lit(" ("), F.col("n"), F.lit(")"), suffix, "ext"))
    free = tried.join(taken.select(F.col("name").alias("unique_name")), "unique_name", "left_anti")
    free = free.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("n"))).select("name", "nth", "unique_name")
    return rows.join(free, ["name", "nth"], "left").select("ord", "name", F.coalesce("unique_name", "name").alias("unique_name"))


def upsert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and those of ``rows`` whose key it does not have."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(table.columns))


def purge(runs: DataFrame, phases: DataFrame, as_of: str, days: int) -> DataFrame:
    """What an age-based delete removes from the runs and, by cascade, from the phases."""
    old = runs.filter(F.col("started_at") < F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAY")).select("run_id")
    n = old.agg(F.count(F.lit(1)).alias("n")).select(F.lit("backup_run").alias("table_name"), "n")
    return n.unionByName(phases.join(old, "run_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("backup_phase").alias("table_name"), "n"))


def autofix(nodes: DataFrame, holders: DataFrame, stubs: DataFrame, missing: DataFrame, root: str) -> DataFrame:
    """Safe corrections (sha256, action, path, target): anchors in ``missing`` (sha256) are moved to their first holder's place, stubs
    of contents with an anchor that name another one are written anew, stubs of unknown contents go. Missing anchors without holder are left alone."""
    first = holders.groupBy("sha256").agg(F.min_by(F.concat_ws("/", F.lit(root), "snapshot", "relpath"), F.struct("pos", "snapshot", "relpath")).alias("target"))
    lost = nodes.join(missing.select("sha256").distinct(), "sha256", "left_semi").join(first, "sha256")
    moved = lost.select("sha256", F.lit("promote").alias("action"), F.col("anchor_path").alias("path"), "target")
    known = nodes.select("sha256", F.lit(True).alias("known"), F.col("anchor_path").alias("target"))
    s = stubs.withColumn("sha256", F.lower("sha256")).join(known, "sha256", "left")
    s = s.filter(F.col("known").isNull() | (~P.blank(F.col("target")) & ~F.col("anchor_path").eqNullSafe(F.col("target"))))
    action = F.when(F.col("known").isNull(), "delete_stub").otherwise("rewrite_stub")
    return moved.unionByName(s.select("sha256", action.alias("action"), F.col("stub_path").alias("path"), "target"))


def cleanup_aborted(snapshots: DataFrame, remote: DataFrame, aborted: str, root: str, archive: str) -> DataFrame:
    """Steps that remove an aborted snapshot (step, action, path, target): its folder, the pointer to the newest other local one, its manifest, its stored objects."""
    newest = snapshots.filter(F.col("is_local") & (F.col("snapshot") != aborted)).agg(F.max("snapshot").alias("target"))
    pointer = newest.select(F.lit(2).alias("step"), F.lit("set_latest").alias("action"), F.lit("latest").alias("path"), "target").filter("target IS NOT NULL")
    own = snapshots.filter(F.col("snapshot") == aborted)
    none = F.lit(None).cast("string").alias("target")
    folder = own.filter("is_local").select(F.lit(1).alias("step"), F.lit("delete_local").alias("action"), F.col("snapshot").alias("path"), none)
    manifest = own.filter("has_manifest").select(F.lit(3).alias("step"), F.lit("delete_manifest").alias("action"), F.concat(F.lit(f"{archive}/"), "snapshot", F.lit(".json")).alias("path"), none)
    stored = remote.filter(F.startswith("path", F.lit(f"{root}/{aborted}/"))).select(F.lit(4).alias("step"), F.lit("delete_object").alias("action"), "path", none)
    return folder.unionByName(pointer).unionByName(manifest).unionByName(stored)


#: Names of temporary files, as LIKE patterns.
TEMP_FILES = ("%mani.%.json", "%index_%.json", "delta%.json")


def temp_cleanup(files: DataFrame, now: float, days: int = 7, patterns: tuple[str, ...] = TEMP_FILES) -> DataFrame:
    """Files (name, mtime) to delete: those named as temporary and older than ``days`` whole days."""
    named = F.lit(False)
    for p in patterns:
        named = named | F.col("name").like(p.replace("_", "\\_"))
    return files.filter(named & (F.floor((F.lit(float(now)) - F.col("mtime")) / 86400) > days))
