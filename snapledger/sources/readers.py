"""Readers of the ledger's documents: manifests, index, folder listings, stubs, logs, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INODE = "STRUCT<dev: BIGINT, ino: BIGINT, nlink: INT>"
ITEM = f"type STRING, relpath STRING, size BIGINT, mtime DOUBLE, source_path STRING, ext STRING, inode {INODE}, sha256 STRING, hardlink_of STRING, hardlink_master BOOLEAN, lmode STRING, target STRING, target_error STRING"
MANIFEST = f"schema INT, snapshot STRING, root STRING, created BIGINT, hash STRING, mode STRING, ref_snapshot STRING, ref_manifest STRUCT<path: STRING, snapshot: STRING, loaded_at: BIGINT>, items ARRAY<STRUCT<{', '.join(x.strip().replace(' ', ': ', 1) for x in ITEM.replace(INODE, '@').split(','))}>>".replace("@", INODE)
NODE = "anchor_path STRING, anchor_snapshot STRING, fileid STRING, {hash_field} STRING, size BIGINT, ext STRING, holders ARRAY<STRING>"
HOLDER = f"snapshot STRING, relpath STRING, size BIGINT, mtime DOUBLE, inode {INODE}, ext STRING"
STUB = f"type STRING, sha256 STRING, size BIGINT, mtime DOUBLE, inode {INODE}, anchor_path STRING, fileid BIGINT, snapshot STRING, relpath STRING, format_version INT, kind STRING, holder_type STRING, mtime_iso STRING, object_path STRING"
LOG = "timestamp STRING, level STRING, message STRING, run_id STRING"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Header rows with items, one for each readable manifest; the snapshot is the file's name without .json. Unreadable files give nothing."""
    t = spark.read.schema(MANIFEST + ", _corrupt STRING").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return t.withColumn("file_snapshot", name).filter("_corrupt IS NULL AND items IS NOT NULL").drop("_corrupt")


def manifest_items(headers: DataFrame) -> DataFrame:
    """Items with their position, from ``manifests``."""
    return headers.select(F.col("file_snapshot").alias("snapshot"), F.posexplode("items").alias("ord", "i")).select("snapshot", F.col("ord").cast("long").alias("ord"), "i.*")


def index_nodes(documents: DataFrame, column: str = "value", hash_field: str = "remote_hash") -> DataFrame:
    """Nodes of index documents given as text, parsed in two stages so that one bad node costs itself only.

    ``node_kind`` is dict or other; ``holders`` keeps each holder's own text; ``hash_field``
    names the field with the stored object's hash. A document
    that is no index gives nothing.
    """
    node = F.explode(F.from_json(F.col(column), "version INT, items MAP<STRING, STRING>")["items"]).alias("sha256", "node")
    t = documents.select(node)
    kind = F.when(F.startswith(F.ltrim("node"), F.lit("{")), "dict").otherwise("other")
    t = t.select(F.lower("sha256").alias("sha256"), kind.alias("node_kind"), F.when(kind == "dict", F.from_json("node", NODE.format(hash_field=hash_field))).alias("n"))
    fileid = F.regexp_replace("n.fileid", "^f+", "").try_cast("bigint")
    return t.select("sha256", "node_kind", "n.anchor_path", "n.anchor_snapshot", F.when(fileid != 0, fileid).alias("fileid"), F.col(f"n.{hash_field}").alias("remote_hash"), "n.size", "n.ext", "n.holders")


def index_holders(nodes: DataFrame) -> DataFrame:
    """Holders with position and kind; of a bare string the text is the snapshot."""
    t = nodes.filter("node_kind = 'dict'").select("sha256", F.posexplode("holders").alias("pos", "h"))
    kind = F.when(F.startswith(F.ltrim("h"), F.lit("{")), "dict").when(F.col("h").isNull(), "other").otherwise("string")
    h = t.select("sha256", F.col("pos").cast("long").alias("pos"), kind.alias("holder_kind"), "h", F.when(kind == "dict", F.from_json("h", HOLDER)).alias("d"))
    return h.select("sha256", "pos", "holder_kind", F.coalesce("d.snapshot", F.when(F.col("holder_kind") == "string", F.col("h"))).alias("snapshot"), "d.relpath", "d.size", "d.mtime", "d.inode.dev", "d.inode.ino", "d.ext")


def read_index(spark: SparkSession, path: str, on_error: str = "raise") -> DataFrame:
    """Nodes of an index file; with on_error='empty' a missing file is an empty index."""
    try:
        return index_nodes(spark.read.text(path, wholetext=True))
    except Exception:
        if on_error != "empty":
            raise
        return index_nodes(spark.createDataFrame([], "value string"))


def remote_tree(documents: DataFrame, column: str = "value") -> DataFrame:
    """Files and folders of a recursive listing in JSON (metadata with contents), at any depth, with full paths.

    A node named as an upload marker goes with all below it.
    """
    from snapledger.operators.tree import DEEPEST, MARKERS, unlimited

    unlimited(documents.sparkSession)
    return documents.sparkSession.sql(
        f"""WITH RECURSIVE t(node, path, lvl) MAX RECURSION LEVEL {DEEPEST} AS (
          SELECT variant_get(try_parse_json({column}), '$.metadata', 'variant'), '', 0 FROM {{documents}}
          UNION ALL SELECT c.value, concat(t.path, '/', variant_get(c.value, '$.name', 'string')), t.lvl + 1
          FROM t, LATERAL variant_explode(variant_get(t.node, '$.contents', 'variant')) AS c
          WHERE variant_get(c.value, '$.name', 'string') NOT IN ({MARKERS}))
        SELECT path, variant_get(node, '$.name', 'string') AS name, coalesce(variant_get(node, '$.isfolder', 'boolean'), false) AS is_folder, CAST(lvl AS BIGINT) AS lvl,
          try_variant_get(node, '$.folderid', 'bigint') AS folderid, try_variant_get(node, '$.fileid', 'bigint') AS fileid, try_variant_get(node, '$.hash', 'string') AS hash, try_variant_get(node, '$.size', 'bigint') AS size
        FROM t WHERE lvl > 0""",
        documents=documents,
    )


def stubs(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of all stub files below ``path`` with their paths."""
    t = spark.read.option("pathGlobFilter", "*.meta.json").option("recursiveFileLookup", True).text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("stub_path"), F.from_json("value", STUB).alias("s")).select("stub_path", "s.*")


def logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Structured log lines, as a table or as a stream."""
    return (spark.readStream if stream else spark.read).schema(LOG).json(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` with size, modification time and content hash (no inodes: object stores have none)."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return t.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.sha2("content", 256).alias("sha256"))


def manifest_paths(items: DataFrame) -> DataFrame:
    """(snapshot, sha256, paths) of manifest items with hash and path: each snapshot's contents and, sorted, where they stand."""
    rows = items.filter("coalesce(sha256, '') <> '' AND coalesce(relpath, '') <> ''")
    return rows.groupBy("snapshot", F.lower("sha256").alias("sha256")).agg(F.sort_array(F.collect_set("relpath")).alias("paths"))


def walk_rows(entries: DataFrame) -> DataFrame:
    """Manifest rows of a walk's entries (path, mode, size, mtime, dev, ino, nlink, target): files, links and folders, the root as '';
    sockets, pipes and devices are left out. The first path of an inode with several names is its master."""
    from pyspark.sql.window import Window

    kind = F.expr("CASE mode & 61440 WHEN 32768 THEN 'file' WHEN 40960 THEN 'symlink' WHEN 16384 THEN 'dir' END")
    rows = entries.withColumn("type", kind).filter("type IS NOT NULL")
    linked = (F.col("type") == "file") & (F.col("nlink") > 1)
    # only files with several names are put together by inode
    key = F.when(linked, F.concat_ws(":", "dev", "ino")).otherwise(F.concat(F.lit("/"), F.col("path")))
    master = F.min("path").over(Window.partitionBy(key))
    return rows.select("type", F.col("path").alias("relpath"), F.when(F.col("type") == "file", F.col("size")).alias("size"), "mtime", F.when(F.col("type") == "file", F.struct("dev", "ino", "nlink")).alias("inode"),
        F.when(linked & (F.col("path") != master), master).alias("hardlink_of"), F.when(linked, F.col("path") == master).alias("hardlink_master"), F.when(F.col("type") == "symlink", F.col("target")).alias("target"))


def delta_report(documents: DataFrame, column: str = "value") -> DataFrame:
    """Findings (category, sha256, anchor_path, fileid) of delta reports given as text; a report that is no JSON gives none."""
    parsed = F.from_json(F.col(column), "MAP<STRING, STRING>")
    t = documents.select(F.explode(parsed).alias("category", "listed"))
    rows = F.from_json("listed", "ARRAY<STRUCT<sha256: STRING, anchor_path: STRING, fileid: STRING>>")
    t = t.filter(F.startswith(F.ltrim("listed"), F.lit("["))).select("category", F.explode(rows).alias("r"))
    return t.select("category", "r.sha256", "r.anchor_path", F.regexp_replace("r.fileid", "^f+", "").try_cast("bigint").alias("fileid"))


def status_documents(documents: DataFrame, column: str = "value") -> DataFrame:
    """(hostname, overall_status, exit_code) of status documents; what one does not say is null, UNKNOWN and 3."""
    field = lambda name: F.get_json_object(column, f"$.{name}")
    return documents.select(field("hostname").alias("hostname"), F.coalesce(field("overall_status"), F.lit("UNKNOWN")).alias("overall_status"), F.coalesce(field("exit_code").try_cast("int"), F.lit(3)).alias("exit_code"))


def template_folders(documents: DataFrame, column: str = "value") -> DataFrame:
    """Folders of a template's manifest; one whose ``folders`` is no list, or that is no JSON, gives none."""
    listed = F.get_json_object(column, "$.folders")
    return documents.filter(F.startswith(F.ltrim(listed), F.lit("["))).select(F.explode(F.from_json(listed, "ARRAY<STRING>")).alias("relpath")).filter("relpath IS NOT NULL")


def run_history(spark: SparkSession, url: str, table: str, key: str = "id", bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of the run history by JDBC, read in ``parts`` ranges of ``key`` if its ``bounds`` are given; filters and columns are pushed down."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def settings(*layers: dict[str, str | None]) -> dict[str, str]:
    """Merge of settings, later layers over earlier ones; empty and missing values do not override."""
    out: dict[str, str] = {}
    for layer in layers:
        out |= {k: v for k, v in layer.items() if v not in (None, "")}
    return out


def env_lines(text: str) -> dict[str, str]:
    """KEY=value lines; comments, blank lines and an export word are skipped, quotes around values go."""
    out = {}
    for line in text.splitlines():
        key, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and not key.startswith("#"):
            out[key.strip()] = value.strip().strip("\"'")
    return out


#: Settings that are whole numbers.
WHOLE = ("port", "timeout")


def effective_settings(defaults: dict, file: dict | None = None, profile: dict | None = None, environment: dict | None = None, overrides: dict | None = None, required: tuple[str, ...] = ("token",)) -> dict:
    """Settings by precedence: overrides over the environment over the profile's file over the default file over defaults; required ones must not be empty."""
    out: dict = settings(defaults, file or {}, profile or {}, environment or {}, {k: None if v is None else str(v) for k, v in (overrides or {}).items()})
    missing = [k for k in required if not out.get(k)]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return {k: int(v) if k in WHOLE else v for k, v in out.items()}
