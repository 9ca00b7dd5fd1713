"""What changed between two manifests or two sets of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_path(items: DataFrame) -> DataFrame:
    """Files of a manifest, of rows with one path the last; hashes in lower case, null as ''."""
    row = F.struct(F.lower(F.coalesce("sha256", F.lit(""))).alias("sha256"), "mtime", "size", "ord", "ext")
    return items.filter("type = 'file'").groupBy("relpath").agg(F.max_by(row, "ord").alias("r")).select("relpath", "r.*")


def manifest_diff(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Every path of either manifest as identical, new, changed or deleted, with the row that counts.

    Equal means equal hash and equal modification time, null equal to null. One full
    outer join on the path.
    """
    c, r = last_per_path(current).alias("c"), last_per_path(reference).alias("r")
    j = c.join(r, F.col("c.relpath") == F.col("r.relpath"), "full_outer")
    gone, new = F.col("c.relpath").isNull(), F.col("r.relpath").isNull()
    same = (F.col("c.sha256") == F.col("r.sha256")) & F.col("c.mtime").eqNullSafe(F.col("r.mtime"))
    pick = lambda n: F.when(gone, F.col(f"r.{n}")).otherwise(F.col(f"c.{n}")).alias(n)
    status = F.when(gone, "deleted").when(new, "new").when(same, "identical").otherwise("changed")
    return j.select(pick("relpath"), status.alias("status"), pick("sha256"), pick("size"), pick("mtime"), pick("ext"))


def diff_stats(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def write_order(diff: DataFrame) -> DataFrame:
    """New and changed rows numbered in the order in which they are written: by extension, then path."""
    from pyspark.sql.window import Window

    order = Window.orderBy(F.coalesce("ext", F.lit("")), F.coalesce("relpath", F.lit("")))
    return diff.filter(F.col("status").isin("new", "changed")).withColumn("seq", F.row_number().over(order).cast("long"))


def delete_paths(diff: DataFrame, folder: str) -> DataFrame:
    """File and stub paths to delete for deleted and changed rows."""
    path = F.concat(F.lit(f"{folder}/"), F.col("relpath"))
    kinds = F.array(F.struct(F.lit("file").alias("kind"), path.alias("path")), F.struct(F.lit("stub").alias("kind"), F.concat(path, F.lit(".meta.json")).alias("path")))
    return diff.filter(F.col("status").isin("deleted", "changed")).select("relpath", F.inline(kinds))


def folders(items: DataFrame) -> DataFrame:
    """All folders above the files of a manifest, the root left out."""
    parts = F.slice(F.split("relpath", "/"), 1, F.size(F.split("relpath", "/")) - 1)
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return items.filter(F.contains("relpath", F.lit("/"))).select(F.explode(paths).alias("relpath")).distinct()


def set_delta(left: DataFrame, right: DataFrame) -> DataFrame:
    """Members of either one-column table: shared, only_left or only_right."""
    c = left.columns[0]
    a, b = left.distinct().withColumn("l", F.lit(True)), right.toDF(c).distinct().withColumn("r", F.lit(True))
    side: Column = F.when(F.col("l") & F.col("r"), "shared").when(F.col("l"), "only_left").otherwise("only_right")
    return a.join(b, c, "full_outer").select(c, side.alias("side"))
