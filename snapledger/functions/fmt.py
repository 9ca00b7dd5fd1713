"""Display expressions for sizes, times and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt_bytes(n: Column, decimals: int = 1) -> Column:
    out = None
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        text = F.format_string(f"%.{decimals}f {unit}", F.bround(n / F.lit(float(1024**k)), decimals))
        if unit == "TB":
            return out.otherwise(text)
        fits = n < 1024 ** (k + 1)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return out


def fmt_duration(s: Column) -> Column:
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(s.isNull(), F.lit("N/A"))
        .when(h > 0, F.format_string("%dh%dm%ds", h, m, r))
        .when(m > 0, F.format_string("%dm%ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def age_display(hours: Column) -> Column:
    return F.when(hours >= 24, F.format_string("%dd %dh ago", F.floor(hours / 24), hours % 24)).otherwise(F.format_string("%dh ago", hours))


def snapshot_time(name: Column) -> Column:
    """Time of a snapshot named YYYY-MM-DD__HH-MM-SS or YYYY-MM-DD-HHMMSS; null for other names."""
    digits = F.regexp_replace(name, "[^0-9]", "")
    known = F.regexp_like(name, F.lit(r"^\d{4}-\d{2}-\d{2}(__\d{2}-\d{2}-\d{2}|-\d{6})$"))
    return F.when(known, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


def iso_utc(epoch: Column) -> Column:
    """Whole seconds since 1970 as ISO text; null for 0 and null."""
    at = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=F.floor(epoch).cast("decimal(18,6)"))
    return F.when(F.coalesce(epoch, F.lit(0.0)) != 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit("N/A")).otherwise(F.format_string("%.1f%%", part * 100.0 / whole))


def whole_tb(bytes_: Column) -> Column:
    """Bytes floored to GB, then to TB with one decimal of the floored GB."""
    gb = F.floor(bytes_ / F.lit(float(1024**3)))
    return F.floor(gb * 10 / 1024) / 10.0


def free_class(free_gb: Column, warning: int = 500, critical: int = 200) -> Column:
    return F.when(free_gb < critical, F.lit("CRITICAL")).when(free_gb < warning, F.lit("WARNING")).otherwise(F.lit("OK"))


def quota(total: Column, used: Column, warning: int = 500, critical: int = 200) -> Column:
    """Of bytes in all and used: whole GB of each, TB with one decimal of the free GB, and the class of what is free."""
    gb = lambda c: F.floor(c / F.lit(float(1024**3))).cast("long")
    free = gb(total - used)
    return F.struct(gb(total).alias("total_gb"), gb(used).alias("used_gb"), free.alias("free_gb"), F.format_string("%.1f", F.bround(free / 1024, 1)).alias("free_tb"), free_class(free, warning, critical).alias("state"))


def disk_class(used_percent: Column, warning: int = 10, critical: int = 5) -> Column:
    """Class of a disk by its free percentage."""
    return free_class(100 - used_percent, warning, critical)


def truncated(text: Column, most: int) -> Column:
    """The text, or its first ``most`` characters and an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def title(name: Column) -> Column:
    """A service's name with blanks for hyphens and each word's first letter in upper case."""
    return F.array_join(F.transform(F.split(name, "[- ]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def row_form(is_folder: Column, name: Column, folderid: Column, fileid: Column, parent: Column) -> Column:
    """A listing entry as a row: type, name (a nameless folder is the root), id, parent."""
    return F.struct(
        F.when(is_folder, "FOLDER").otherwise("FILE").alias("type"), F.when(is_folder & (F.coalesce(name, F.lit("")) == ""), "/").otherwise(F.coalesce(name, F.lit(""))).alias("name"),
        F.when(is_folder, folderid).otherwise(fileid).alias("id"), parent.alias("parent"),
    )
