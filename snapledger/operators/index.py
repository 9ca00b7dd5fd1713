"""The inverted index: content to holders, its build, repair and states in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_hash(items: DataFrame) -> DataFrame:
    return items.filter("type = 'file' AND coalesce(sha256, '') <> '' AND coalesce(relpath, '') <> ''").withColumn("sha256", F.lower("sha256"))


def build_holders(items: DataFrame) -> DataFrame:
    """Every place of every content, numbered from 0 by snapshot and item order."""
    pos = F.row_number().over(Window.partitionBy("sha256").orderBy("snapshot", "ord", "relpath")) - 1
    return with_hash(items).select("sha256", "snapshot", "relpath", "size", "mtime", "dev", "ino", "ext", "ord", pos.cast("long").alias("pos"))


def build_nodes(items: DataFrame, root: str) -> DataFrame:
    """One row per content with its anchor, the first place. A map-side combining aggregate, no sort."""
    first = F.min_by(F.struct("snapshot", "relpath", "size", "ext"), F.struct("snapshot", "ord", "relpath"))
    t = with_hash(items).groupBy("sha256").agg(first.alias("f"), F.count(F.lit(1)).alias("n_holders"), F.count_distinct("snapshot").alias("n_snapshots"))
    return t.select("sha256", F.concat_ws("/", F.lit(root), "f.snapshot", "f.relpath").alias("anchor_path"), F.col("f.snapshot").alias("anchor_snapshot"), F.col("f.size").alias("size"), "n_holders", "n_snapshots")


def holders_after_run(items: DataFrame, index_holders: DataFrame, policy: str = "complete") -> DataFrame:
    """Holders that a run over one snapshot's items appends; ``first_inode_only`` leaves out further names of an inode."""
    held = index_holders.select("sha256", "snapshot", "relpath")
    rows = with_hash(items)
    if policy == "first_inode_only":
        key = F.when(F.col("dev").isNotNull() & F.col("ino").isNotNull(), F.concat_ws(":", "dev", "ino"))
        # rows without inode stand alone, each under its own path, and not together in one task
        first = F.row_number().over(Window.partitionBy("snapshot", F.coalesce(key, F.concat(F.lit("/"), F.col("relpath")))).orderBy("ord"))
        rows = rows.withColumn("nth", F.when(key.isNull(), 1).otherwise(first)).filter("nth = 1").drop("nth")
    return rows.join(held, ["sha256", "snapshot", "relpath"], "left_anti").select("sha256", "snapshot", "relpath")


def time_travel(holders: DataFrame, snapshots: DataFrame, root: str) -> DataFrame:
    """The index as of every snapshot: contents held up to it, their number of holders, the oldest as anchor.

    Holders are first counted by content and snapshot; each content's counts are then
    summed up over the snapshots from its first on, so that the join with the few
    snapshots sees one row per content and snapshot, not one per holder.
    """
    per = holders.groupBy("sha256", "snapshot").agg(F.count(F.lit(1)).alias("n"), F.min_by("relpath", F.struct("pos", "relpath")).alias("path"))
    first = per.groupBy("sha256").agg(F.min_by("path", "snapshot").alias("path"), F.min("snapshot").alias("first"))
    grid = first.crossJoin(F.broadcast(snapshots.select(F.col("snapshot").alias("as_of")))).filter("as_of >= first")
    counted = grid.join(per.select("sha256", F.col("snapshot").alias("as_of"), "n"), ["sha256", "as_of"], "left")
    run = Window.partitionBy("sha256").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    return counted.select("as_of", "sha256", F.sum(F.coalesce("n", F.lit(0))).over(run).alias("n_holders"), F.concat_ws("/", F.lit(root), "first", "path").alias("anchor_path"))


def stub_ratio(nodes: DataFrame, holders: DataFrame, root: str) -> DataFrame:
    """By snapshot: contents held or anchored, those only held, and their ratio."""
    anchors = nodes.select("sha256", F.split_part(F.col("anchor_path"), F.lit("/"), F.lit(len(root.split("/")) + 1)).alias("snapshot"), F.lit(1).alias("anchor"))
    both = holders.select("sha256", "snapshot", F.lit(0).alias("anchor")).unionByName(anchors)
    per = both.groupBy("sha256", "snapshot").agg(F.max("anchor").alias("anchor"))
    t = per.groupBy("snapshot").agg(F.count(F.lit(1)).alias("total"), F.sum(1 - F.col("anchor")).cast("long").alias("stubs"))
    return t.withColumn("ratio", F.col("stubs") / F.col("total"))


def hard_links(items: DataFrame) -> DataFrame:
    """Names of an inode with several: the first is master, the others point to it."""
    w = Window.partitionBy("snapshot", "dev", "ino")
    master = F.first("relpath").over(w.orderBy("ord"))
    t = items.filter("dev IS NOT NULL AND ino IS NOT NULL").withColumn("nlink", F.count(F.lit(1)).over(w)).withColumn("master", master).filter("nlink > 1")
    return t.select("snapshot", "relpath", F.col("nlink").cast("long").alias("nlink"), (F.col("relpath") == F.col("master")).alias("is_master"), F.when(F.col("relpath") != F.col("master"), F.col("master")).alias("hardlink_of"))


def reuse_hashes(current: DataFrame, reference: DataFrame, inode_policy: str = "strict") -> DataFrame:
    """Hash for each current file from the reference: by path with equal time and size, else by inode."""
    by_path = reference.groupBy("relpath").agg(F.max_by(F.struct("sha256", "mtime", "size"), "ord").alias("p"))
    inode = F.struct("sha256", "mtime", "size")
    by_inode = reference.groupBy("dev", "ino").agg(F.max_by(inode, "ord").alias("i"))
    equal = lambda r: F.col("mtime").eqNullSafe(F.col(f"{r}.mtime")) & F.col("size").eqNullSafe(F.col(f"{r}.size"))
    j = current.select("relpath", "mtime", "size", "dev", "ino").join(by_path, "relpath", "left").join(by_inode, ["dev", "ino"], "left")
    usable = F.col("i").isNotNull() & (equal("i") if inode_policy == "strict" else F.lit(True))
    how = F.when(F.col("p").isNotNull() & equal("p"), "path").when(usable, "inode").otherwise("calculate")
    return j.select("relpath", how.alias("how"), F.when(how == "path", F.col("p.sha256")).when(how == "inode", F.col("i.sha256")).alias("sha256"))


def enrich(nodes: DataFrame, holders: DataFrame, remote: DataFrame, root: str, force: bool = False) -> DataFrame:
    """fileid and hash for nodes without: of the anchor's object, else of the first holder path that exists."""
    wanted = nodes if force else nodes.filter("fileid IS NULL")
    places = holders.join(wanted.select("sha256"), "sha256", "left_semi").select("sha256", "pos", F.concat_ws("/", F.lit(root), "snapshot", "relpath").alias("path"))
    candidates = wanted.select("sha256", F.lit(-1).cast("long").alias("pos"), F.col("anchor_path").alias("path")).unionByName(places)
    found = candidates.join(remote.select("path", F.col("fileid").alias("new_id"), F.col("hash").alias("new_hash")), "path")
    best = found.groupBy("sha256").agg(F.min_by(F.struct("new_id", "new_hash", "path"), "pos").alias("b"))
    return wanted.join(best, "sha256", "left").select("sha256", F.col("b.path").alias("found_path"), F.col("b.new_id").alias("fileid"), F.coalesce("remote_hash", "b.new_hash").alias("remote_hash"))


def repair_anchors(nodes: DataFrame, holders: DataFrame, missing: DataFrame, root: str) -> DataFrame:
    """Nodes whose anchor is missing: the holder at the anchor's path goes; the anchor moves to the oldest other one, or the node goes."""
    lost = nodes.join(missing.select("sha256"), "sha256", "left_semi").select("sha256", "anchor_path")
    path = F.concat_ws("/", F.lit(root), "snapshot", "relpath")
    h = holders.join(lost, "sha256").withColumn("path", path)
    t = h.groupBy("sha256", "anchor_path").agg(F.count(F.lit(1)).alias("held"), F.sum((F.col("path") == F.col("anchor_path")).cast("long")).alias("dropped"),
        F.min_by(F.when(F.col("path") != F.col("anchor_path"), F.col("path")), F.struct(F.when(F.col("path") != F.col("anchor_path"), F.col("snapshot")).isNull(), "snapshot", "pos")).alias("next"))
    action = F.when(F.col("held") == F.col("dropped"), "drop_node").otherwise("reanchor")
    return t.select("sha256", action.alias("action"), "dropped", F.col("next").alias("new_anchor"))


def classify_holders(holders: DataFrame, manifests: DataFrame) -> DataFrame:
    """What is wrong with a holder, the first of: blank field, snapshot without manifest, content not in it, other path."""
    known = manifests.select("snapshot").distinct().withColumn("has_manifest", F.lit(True))
    by_sha = with_hash(manifests).groupBy("snapshot", "sha256").agg(F.min_by("relpath", F.struct("ord", "relpath")).alias("first_path"))
    exact = with_hash(manifests).select("snapshot", "sha256", "relpath").distinct().withColumn("exact", F.lit(True))
    j = holders.join(F.broadcast(known), "snapshot", "left").join(by_sha, ["snapshot", "sha256"], "left").join(exact, ["snapshot", "sha256", "relpath"], "left")
    verdict = (
        F.when(F.expr("coalesce(snapshot, '') = '' OR coalesce(relpath, '') = ''"), "blank")
        .when(F.col("has_manifest").isNull(), "no_manifest").when(F.col("first_path").isNull(), "not_in_manifest")
        .when(F.col("exact").isNull(), "path_mismatch").otherwise("ok")
    )
    return j.select("sha256", "snapshot", "relpath", verdict.alias("verdict"), F.when(verdict == "path_mismatch", F.col("first_path")).alias("repaired_path"))


def set_missing_anchors(nodes: DataFrame, holders: DataFrame, root: str, reset: bool = False) -> DataFrame:
    """``nodes`` (sha256, anchor_path, fileid, remote_hash) with blank anchors set to the place of the oldest holder that names snapshot
    and path; with ``reset``, as after a repair that changed holders, all fileids and hashes are taken away to be looked up anew."""
    named = holders.filter("coalesce(snapshot, '') <> '' AND coalesce(relpath, '') <> ''")
    oldest = named.groupBy("sha256").agg(F.min_by(F.concat_ws("/", F.lit(root), "snapshot", "relpath"), F.struct("snapshot", "pos")).alias("oldest"))
    blank = F.coalesce("anchor_path", F.lit("")) == ""
    keep = lambda c: F.when(F.lit(not reset), F.col(c)).alias(c)
    return nodes.join(oldest, "sha256", "left").select("sha256", F.when(blank, F.col("oldest")).otherwise(F.col("anchor_path")).alias("anchor_path"), keep("fileid"), keep("remote_hash"), (blank & F.col("oldest").isNotNull()).alias("was_set"))
