"""Jobs, access and lineage: which rows a scope sees, what is due, what hangs on what, and counts of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(rows: DataFrame, files: DataFrame, members: DataFrame, file: tuple[str, str], member: tuple[str, str]) -> DataFrame:
    """rows joined with their files (row's and file's key) and these with the members of a scope (file's and member's key)."""
    seen = files.join(members, F.col(member[0]) == F.col(member[1]))
    return rows.join(seen, F.col(file[0]) == F.col(file[1]))


def chained(first: DataFrame, *steps: tuple[DataFrame, str, str], how: str = "inner") -> DataFrame:
    """first joined with each step's table on first's column and the table's, the last step innermost: small tables meet first."""
    if not steps:
        return first
    table, mine, theirs = steps[0]
    return first.join(chained(table, *steps[1:], how=how), F.col(mine) == F.col(theirs), how)


def last_outcomes(entries: DataFrame, events: DataFrame, key: str, order: str, kind: str, missing: str = "missing") -> DataFrame:
    """key, outcome: the kind of each entry's last event in the order given, or ``missing``; an entry that stands twice counts once."""
    last = events.groupBy(key).agg(F.max_by(kind, order).alias("outcome"))
    return entries.select(key).distinct().join(last, key, "left").select(key, F.coalesce("outcome", F.lit(missing)).alias("outcome"))


def to_remove(existing: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Distinct keys that exist and are not allowed any more; a null key isn't allowed."""
    return existing.select(key).distinct().join(allowed.select(key), key, "left_anti")


def cascade(root: DataFrame, *levels: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """What is left of each level's table when the rows of root go, with all that hangs on them.

    root: one column of keys; a level: table, its column with the parent's key, and its own key.
    """
    left, gone = [], root.toDF("_gone")
    for table, parent, own in levels:
        left.append(table.join(gone, F.col(parent) == F.col("_gone"), "left_anti"))
        gone = table.join(gone, F.col(parent) == F.col("_gone"), "left_semi").select(F.col(own).alias("_gone")).distinct()
    return left


def ensured(wanted: DataFrame, existing: DataFrame, key: str, status: str = "queued") -> DataFrame:
    """New jobs, one for each wanted key that has none: key, status."""
    return wanted.select(key).distinct().join(existing.select(key), key, "left_anti").withColumn("status", F.lit(status))


def due(jobs: DataFrame, now: Column, held_until: str = "lease_expires_at") -> DataFrame:
    """Queued jobs that may be taken now."""
    return jobs.where((F.col("status") == "queued") & (F.col(held_until).isNull() | (F.col(held_until) <= now)))


def requeued_failed(jobs: DataFrame) -> DataFrame:
    """Failed jobs as new ones: queued, without attempts or lease; other jobs are left out."""
    fresh = {"status": F.lit("queued"), "attempt_count": F.lit(0).cast("long"), "lease_expires_at": F.lit(None).cast("long")}
    return jobs.where("status = 'failed'").withColumns(fresh)


def mean_pass(rows: DataFrame, score: str, *by: str) -> DataFrame:
    """by, pass_rate (0 without scores), scored: mean of the scores there are."""
    return rows.groupBy(*by).agg(F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("pass_rate"), F.count(score).alias("scored"))


def run_summary(rows: DataFrame, failed: Column, scored: Column, *by: str) -> DataFrame:
    """by, total, failed, scored."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"), F.count_if(scored).alias("scored"))


def sums_by_key(rows: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """by, sums: a map of key to the sum of its values; null keys are left out."""
    each = rows.where(F.col(key).isNotNull()).groupBy(by, key).agg(F.sum(value).alias("s"))
    return each.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "s")))).alias("sums"))  # one entry a key


def group_counters(rows: DataFrame, group: str, member: str) -> DataFrame:
    """group, n rows and members, the distinct ones."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(member).alias("members"))


def retry_after(rows: DataFrame, by: str, limited: Column, wait: Column) -> DataFrame:
    """by, retry_after: the longest wait among rows that were limited, 0 without one."""
    return rows.groupBy(by).agg(F.coalesce(F.max(F.when(limited, wait)), F.lit(0.0)).alias("retry_after"))
