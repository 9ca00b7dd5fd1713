"""Status of components: severities, roll-up, changes, log states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def severity(checks: DataFrame, by: str = "host") -> DataFrame:
    """The worst status of a host's checks, 0 to 3."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("OK", "WARNING", "CRITICAL", "UNKNOWN")]), F.least(F.max("status"), F.lit(3)) + 1)
    return checks.groupBy(by).agg(F.max("status").cast("long").alias("worst"), F.count_if(F.col("status") > 0).alias("n_bad"), name.alias("overall"))


def roll_up(sync: Column, job: Column, failed: Column) -> tuple[Column, Column]:
    """Overall status and exit code from the sync check's code, the snapshot job's state and the number of failed services.

    Critical beats all; a running job shows as RUNNING over a warning, whose exit code
    stays; a failed service turns what is not critical into a warning.
    """
    critical = (sync == 2) | (job == "failed")
    status = F.when(critical, "CRITICAL").when(failed > 0, "WARNING").when(job == "running", "RUNNING").when(sync == 1, "WARNING").otherwise("OK")
    code = F.when(critical, 2).when((failed > 0) | (sync == 1), 1).otherwise(0)
    return status, code


def changes(states: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """Rows whose status differs from the key's row before, with that; a first row is a change unless OK."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    return states.withColumn("before", before).filter(F.coalesce(F.col("before") != F.col(status), F.col(status) != "OK"))


def log_state(lines: DataFrame, rules: list[tuple[str, str, int]], key: str = "host", number: str = "n") -> DataFrame:
    """State of a log: the first rule (state, pattern, tail) of which one of the last ``tail`` lines matches, else unknown."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(number)))
    t = lines.withColumn("back", back).filter(F.col("back") <= max(r[2] for r in rules))
    hits = t.groupBy(key).agg(*[F.max((F.regexp_like("line", F.lit(p)) & (F.col("back") <= n)).cast("int")).alias(s) for s, p, n in rules])
    out = F.lit("unknown")
    for s, _, _ in reversed(rules):
        out = F.when(F.col(s) == 1, s).otherwise(out)
    return hits.select(key, out.alias("state"))


def age_check(newest_local: Column, last_success: Column) -> Column:
    return F.when(last_success.isNull(), "WARNING").when(newest_local != last_success, "CRITICAL").otherwise("OK")


def explain(services: DataFrame, by: str = "host") -> DataFrame:
    """Names of failed and of inactive services; blocked ones do not count as failed."""
    named = lambda s: F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("service")))), ", ")
    return services.groupBy(by).agg(named("failed").alias("failed"), named("inactive").alias("inactive"), F.count_if(F.col("status") == "blocked").alias("n_blocked"))


def log_fields(line: Column) -> Column:
    """What a log line tells: its time, the gate's colour and those of the components nas and nas-av, the state of the honeyfiles; null where it does not say."""
    found = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    return F.struct(
        found(r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})").alias("at"), found("SAFETY-GATE: (GREEN|YELLOW|RED)").alias("gate"),
        found("(?:^|[^-\\w])nas: (GREEN|YELLOW|RED)").alias("nas"), found("nas-av: (GREEN|YELLOW|RED)").alias("nas_av"),
        F.when(F.regexp_like(line, F.lit("(?i)honeyfile.*alarm")), "ALARM").when(F.contains(line, F.lit("Honeyfiles:")), "OK").alias("honeyfiles"),
    )
