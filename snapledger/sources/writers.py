"""Writers: documents made of tables, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_lines(items: DataFrame) -> DataFrame:
    """Items as JSON lines in item order, for one text file per partition."""
    return items.select("snapshot", "ord", F.to_json(F.struct(*[c for c in items.columns if c not in ("snapshot", "ord")])).alias("value"))


def index_lines(nodes: DataFrame, holders: DataFrame) -> DataFrame:
    """One JSON line per content with its holders in order. Holders are gathered by content."""
    h = holders.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("pos", "snapshot", "relpath"))).alias("h"))
    listed = F.transform("h", lambda x: F.struct(x["snapshot"].alias("snapshot"), x["relpath"].alias("relpath")))
    return nodes.join(h, "sha256", "left").select("sha256", F.to_json(F.struct("anchor_path", "fileid", F.coalesce(listed, F.array()).alias("holders"))).alias("value"))


def document(**parts: tuple[DataFrame, Column]) -> DataFrame:
    """One row with one JSON document: each part a list of its frame's expression, in order. For reports of bounded size."""
    one = None
    for name, (frame, item) in parts.items():
        t = frame.agg(F.sort_array(F.collect_list(item)).alias(name))
        one = t if one is None else one.crossJoin(t)
    return one.select(F.to_json(F.struct(*parts)).alias("value"))


def replace(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write parquet to ``path``; readers see the old files or the new ones by the commit marker."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
