"""Agreement of index, manifests, stubs and stored objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapledger.functions import paths as P


def match_anchors(nodes: DataFrame, remote: DataFrame) -> DataFrame:
    """Each node's stored object, by fileid first, else by path: two equi joins, never an OR.

    Nodes without anchor are left out. Of objects with one fileid the one of the greatest
    path counts, of those with one path the one of the greatest fileid; objects without
    fileid are found by path.
    """
    nodes = nodes.filter(~P.blank(F.col("anchor_path")))
    found = F.struct("path", "fileid", "hash", "size")
    by_id = remote.filter("fileid IS NOT NULL").groupBy("fileid").agg(F.max_by(found, "path").alias("i"))
    by_path = remote.groupBy(F.col("path").alias("anchor_path")).agg(F.max_by(found, F.struct(F.col("fileid").isNotNull(), "fileid", "hash", "size")).alias("p"))
    j = nodes.join(by_id, "fileid", "left").join(by_path, "anchor_path", "left")
    found = F.coalesce("i", "p")
    how = F.when(F.col("i").isNotNull(), "fileid").when(F.col("p").isNotNull(), "path").otherwise("missing")
    differ = lambda a, b: F.col(a).isNotNull() & b.isNotNull() & (F.col(a) != b)
    return j.select("sha256", "anchor_path", how.alias("how"), differ("fileid", found["fileid"]).alias("id_differs"), differ("remote_hash", found["hash"]).alias("hash_differs"),
        differ("size", found["size"]).alias("size_differs"), (F.col("i").isNotNull() & (F.col("i.path") != F.col("anchor_path"))).alias("moved"), F.col("remote_hash").isNull().alias("no_hash"))


def ignored(path):
    """Objects that are no content: stubs, the index, markers."""
    return P.is_stub(path) | F.contains(path, F.lit("/_index/")) | F.endswith(path, F.lit("content_index.json")) | P.basename(path).isin(*P.MARKERS)


def unknown_objects(nodes: DataFrame, holders: DataFrame, remote: DataFrame, root: str) -> DataFrame:
    """Stored objects known neither by fileid nor by path: two anti joins in a row."""
    known = nodes.select(F.col("anchor_path").alias("path")).union(holders.select(F.concat_ws("/", F.lit(root), "snapshot", "relpath")))
    r = remote.filter(F.col("fileid").isNotNull() & ~ignored(F.col("path")))
    return r.join(nodes.filter("fileid IS NOT NULL").select("fileid"), "fileid", "left_anti").join(known.distinct(), "path", "left_anti").select("path", "fileid", "size")


def missing_in_index(items: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = items.filter("type = 'file' AND coalesce(sha256, '') <> ''").withColumn("sha256", F.lower("sha256"))
    return rows.join(nodes.select("sha256"), "sha256", "left_anti").select("sha256", "snapshot", "relpath")


def missing_holder(items: DataFrame, holders: DataFrame) -> DataFrame:
    """Contents of a manifest that are in the index but not held for its snapshot."""
    rows = items.filter("type = 'file' AND coalesce(sha256, '') <> ''").select(F.lower("sha256").alias("sha256"), "snapshot").distinct()
    return rows.join(holders.select("sha256").distinct(), "sha256", "left_semi").join(holders.select("sha256", "snapshot").distinct(), ["sha256", "snapshot"], "left_anti")


def orphaned_holders(holders: DataFrame, remote_snapshots: DataFrame) -> DataFrame:
    return holders.join(F.broadcast(remote_snapshots.select("snapshot")), "snapshot", "left_anti").select("sha256", "snapshot", "relpath")


def check_stubs(stubs: DataFrame, nodes: DataFrame, remote: DataFrame) -> DataFrame:
    """Each stub's place in the index, by hash or else by anchor path, and of its object, by fileid."""
    by_sha = nodes.select("sha256", F.lit(True).alias("by_sha"))
    by_anchor = nodes.filter(~P.blank(F.col("anchor_path"))).select("anchor_path", F.lit(True).alias("by_anchor")).distinct()
    obj = remote.filter("fileid IS NOT NULL").groupBy("fileid").agg(F.max("path").alias("path"))
    j = stubs.withColumn("sha256", F.lower("sha256")).join(by_sha, "sha256", "left").join(by_anchor, "anchor_path", "left").join(obj, "fileid", "left")
    place = F.when(F.col("by_sha"), "hash").when(F.col("by_anchor"), "anchor").otherwise("none")
    state = F.when(F.col("fileid").isNull(), "no_fileid").when(F.col("path").isNull(), "object_missing").when(F.col("path") != F.col("anchor_path"), "moved").otherwise("ok")
    return j.select("stub_path", "sha256", place.alias("in_index"), state.alias("object_state"))


def anchor_timeline(nodes: DataFrame, holders: DataFrame) -> DataFrame:
    """Nodes whose anchor's snapshot is not among their holders."""
    a = nodes.select("sha256", "anchor_path", P.snapshot_segment(F.col("anchor_path")).alias("snapshot"))
    return a.join(holders.select("sha256", "snapshot").distinct(), ["sha256", "snapshot"], "left_anti").select("sha256", "anchor_path", "snapshot")


def tamper_report(nodes: DataFrame, holders: DataFrame, remote: DataFrame, root: str) -> DataFrame:
    """Findings by category, each once scanned: number, and whether it counts as an issue."""
    m = match_anchors(nodes, remote)
    flags = {"missing": "how = 'missing'", "fileid_mismatch": "id_differs", "hash_mismatch": "hash_differs", "size_mismatch": "size_differs", "moved": "moved", "hash_missing": "no_hash", "ok": "how <> 'missing'"}
    one = m.agg(*[F.count_if(F.expr(e)).alias(k) for k, e in flags.items()])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("n")) for k in flags])))
    rows = rows.union(unknown_objects(nodes, holders, remote, root).agg(F.count(F.lit(1))).select(F.lit("unknown"), "count(1)"))
    return rows.withColumn("is_issue", ~F.col("category").isin("hash_missing", "moved", "ok"))


def first_of_each(findings: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """At most ``n`` rows of each category, in order (a report's detail limit)."""
    return findings.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col("nth") <= n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def hashed_sample(df: DataFrame, key: str, n: int, by: str | None = None, seed: str = "1") -> DataFrame:
    """``n`` rows, of each ``by`` if given, by least hash of key and seed: the same at each run."""
    order = [F.md5(F.concat(F.lit(seed), F.col(key))), F.col(key)]
    if not by:
        # every task keeps its n least, and only n rows are numbered
        df = df.orderBy(*order).limit(n)
    rank = F.row_number().over((Window.partitionBy(by) if by else Window.partitionBy()).orderBy(*order))
    return df.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)


def check_sums(nodes: DataFrame, sums: DataFrame, n: int, seed: str = "1") -> DataFrame:
    """Of a sample of ``n`` nodes with an anchor, the content hash in ``sums`` (path, sha256) against the index: match, mismatch or unknown."""
    some = hashed_sample(nodes.filter(~P.blank(F.col("anchor_path"))).select("sha256", "anchor_path"), "sha256", n, seed=seed)
    found = sums.groupBy(F.col("path").alias("anchor_path")).agg(F.lower(F.max("sha256")).alias("stored"))
    state = F.when(P.blank(F.col("stored")), "unknown").when(F.col("stored") == F.lower("sha256"), "match").otherwise("mismatch")
    return some.join(found, "anchor_path", "left").select("sha256", "anchor_path", "rank", state.alias("state"))
