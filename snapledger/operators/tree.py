"""Folder trees as parent pointers: paths downward, resolution upward."""

from __future__ import annotations

from pyspark.sql import DataFrame

MARKERS = "'.upload_started', '.upload_complete', '.upload_aborted', '.upload_incomplete'"


#: Levels of a tree; a deeper one is an error, never cut off.
DEEPEST = 100_000


def unlimited(spark) -> None:
    """Let recursive queries of this session return any number of rows (the default stops with an error at a million)."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")


def flatten(nodes: DataFrame, max_depth: int | None = None, prune_markers: bool = True) -> DataFrame:
    """Full path and level of every node (id, parent_id, name, is_folder) below the roots; nodes named as markers go with what is below them. Nodes in a circle are below no root."""
    unlimited(nodes.sparkSession)
    cond = f"AND n.name NOT IN ({MARKERS})" if prune_markers else ""
    deep = f"AND t.lvl < {max_depth}" if max_depth else ""
    return nodes.sparkSession.sql(
        f"""WITH RECURSIVE t(id, parent_id, name, is_folder, path, lvl) MAX RECURSION LEVEL {DEEPEST} AS (
          SELECT id, parent_id, name, is_folder, concat('/', name), 1 FROM {{nodes}} n WHERE parent_id IS NULL {cond}
          UNION ALL SELECT n.id, n.parent_id, n.name, n.is_folder, concat(t.path, '/', n.name), t.lvl + 1
          FROM {{nodes}} n JOIN t ON n.parent_id = t.id WHERE true {deep} {cond})
        SELECT id, is_folder, path, CAST(lvl AS BIGINT) AS lvl FROM t""",
        nodes=nodes,
    )


def resolve_up(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Path of each wanted id by its parents; ``complete`` is false if a parent is missing or they run in a circle."""
    unlimited(nodes.sparkSession)
    return nodes.sparkSession.sql(
        f"""WITH RECURSIVE t(id, parent_id, path, seen, n) MAX RECURSION LEVEL {DEEPEST} AS (
          SELECT n.id, n.parent_id, concat('/', n.name), array(n.id), 1 FROM {{nodes}} n JOIN {{wanted}} w ON n.id = w.id
          UNION ALL SELECT t.id, n.parent_id, concat('/', n.name, t.path), concat(t.seen, array(n.id)), t.n + 1
          FROM t JOIN {{nodes}} n ON n.id = t.parent_id WHERE NOT array_contains(t.seen, n.id))
        SELECT id, max_by(path, n) AS path, CAST(max(n) AS BIGINT) AS depth, max_by(parent_id IS NULL, n) AS complete FROM t GROUP BY id""",
        nodes=nodes,
        wanted=wanted,
    )
