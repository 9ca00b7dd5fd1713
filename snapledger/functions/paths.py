"""Path and identifier expressions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STUB_SUFFIX = ".meta.json"
MARKERS = (".upload_started", ".upload_complete", ".upload_aborted", ".upload_incomplete")


def blank(c: Column) -> Column:
    """True for null and the empty string."""
    return F.coalesce(c, F.lit("")) == ""


def norm_remote(c: Column) -> Column:
    """Trimmed, with one leading slash, no double slashes and no slash at the end."""
    p = F.regexp_replace(F.concat(F.lit("/"), F.trim(F.coalesce(c, F.lit("")))), "/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def join_remote(parent: Column, name: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), "^/+|/+$", "")
    base = norm_remote(parent)
    return F.when(base == "/", F.concat(base, bare)).otherwise(F.concat(base, F.lit("/"), bare))


def dirname(c: Column) -> Column:
    p = norm_remote(c)
    up = F.regexp_replace(p, "/[^/]*$", "")
    return F.when(up == "", F.lit("/")).otherwise(up)


def basename(c: Column) -> Column:
    return F.regexp_extract(c, "([^/]*)$", 1)


def ext(c: Column) -> Column:
    """Extension with its dot; null without one. Leading dots do not begin one."""
    found = F.regexp_extract(basename(c), r"^\.*[^.].*?(\.[^.]*)$", 1)
    return F.when(found != "", found)


def snapshot_after_marker(c: Column, marker: str = "/_snapshots/") -> Column:
    """What stands after the first marker, up to a slash; null without the marker."""
    return F.when(F.contains(c, F.lit(marker)), F.split_part(F.substring_index(F.regexp_replace(c, "^.*?" + marker, "\x01"), "\x01", -1), F.lit("/"), F.lit(1)))


def snapshot_segment(c: Column, part: str = "_snapshots") -> Column:
    """The path component after the first one equal to ``part``; null if there is none."""
    parts = F.split(c, "/")
    at = F.array_position(parts, part)
    return F.when((at > 0) & (at < F.size(parts)), F.try_element_at(parts, (at + 1).cast("int")))


def holder_path(root: Column, snapshot: Column, relpath: Column) -> Column:
    return F.concat_ws("/", root, snapshot, relpath)


def stub_path(c: Column) -> Column:
    return F.concat(c, F.lit(STUB_SUFFIX))


def is_stub(c: Column) -> Column:
    return F.endswith(c, F.lit(STUB_SUFFIX))


def object_path(root: Column, sha: Column, extension: Column) -> Column:
    """Two-character fan-out of an object store; short hashes go under zz."""
    name = F.when(blank(extension), sha).otherwise(F.concat(sha, F.lit("."), F.ltrim(extension, F.lit("."))))
    return F.concat_ws("/", root, F.when(F.length(sha) >= 2, F.substring(sha, 1, 2)).otherwise(F.lit("zz")), name)


def inode_key(dev: Column, ino: Column) -> Column:
    """dev:ino, null if either is."""
    return F.concat(dev.cast("string"), F.lit(":"), ino.cast("string"))


def relative_to(c: Column, base: Column) -> Column:
    p, b = norm_remote(c), norm_remote(base)
    prefix = F.when(b == "/", b).otherwise(F.concat(b, F.lit("/")))
    return F.when(p == b, F.lit(".")).when(F.startswith(p, prefix), F.substring(p, F.length(prefix) + 1, F.length(p))).otherwise(c)


def depth(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def safe_under_base(c: Column) -> Column:
    """False if following the path's components would leave the base, or it is absolute."""
    step = lambda s, x: F.when(s < 0, s).when(x == "..", s - 1).when((x == "") | (x == "."), s).otherwise(s + 1)
    return ~F.startswith(c, F.lit("/")) & (F.aggregate(F.split(c, "/"), F.lit(0), step) >= 0)


def file_id(c: Column) -> Column:
    """'f123' -> 123; what is not a number -> 0."""
    return F.coalesce(F.regexp_replace(c, "^f+", "").try_cast("bigint"), F.lit(0))


def valid_snapshot(c: Column) -> Column:
    """Whether a name is a snapshot's: a date, then a time after one hyphen or two underscores."""
    return F.coalesce(F.regexp_like(c, F.lit(r"^\d{4}-\d{2}-\d{2}(-\d{6}|__\d{2}-\d{2}-\d{2})$")), F.lit(False))
