"""Windows, budgets, jobs, lineage and interval operators over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranges import running_by_key


def latest(df: DataFrame, key: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= n)


def placed(df: DataFrame, key: str, *order: Column, name: str = "rn") -> DataFrame:
    """df with each row's place among its key's rows, from 1; the order leaves no ties, and a busy key is spread over tasks."""
    return running_by_key(df.withColumn("_one", F.lit(1)), key, list(order), "sum", "_one", name).drop("_one")


def expired(df: DataFrame, key: list[str], *order: Column, keep: int = 2) -> DataFrame:
    """The rows beyond the first ``keep`` of each key: what retention deletes. The order leaves no ties."""
    one = key[0] if len(key) == 1 else "_key"
    rows = df if len(key) == 1 else df.withColumn("_key", F.struct(*key))
    return placed(rows, one, *order).where(F.col("rn") > keep).drop("_key")


def history_window(turns: DataFrame, max_messages: int = 12, max_chars: int = 12000) -> DataFrame:
    """The newest whole question-answer pairs within both limits, in order. turns: conv_id, turn, role, text.

    Both running sums only grow towards older pairs, so a plain filter keeps the same pairs as stopping at the first
    that doesn't fit.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = turns.select(
        "conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"), F.lead("turn").over(w).alias("answer_turn")
    )
    pairs = after.where("role = 'user' and next_role = 'assistant'").withColumn("chars", (F.length("text") + F.length("answer")).cast("long"))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    pairs = pairs.withColumn("pair", F.row_number().over(back).cast("long"))
    pairs = pairs.withColumn("total", F.sum("chars").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return pairs.where((2 * F.col("pair") <= max_messages) & (F.col("total") <= max_chars)).select("conv_id", "turn", "answer_turn", "pair", "total")


def budget(rows: DataFrame, available: int, by: str = "item_id", order: str = "number") -> DataFrame:
    """How much of each text fits: header and text are charged in order, the text is cut to what is left, and the first cut or left-out row ends it.

    rows: by, order, header_chars, text_chars. Adds used (characters of the text taken).
    """
    w = Window.partitionBy(by).orderBy(order)
    before = F.coalesce(F.sum(F.col("header_chars") + F.col("text_chars")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(available) - before - F.col("header_chars")
    out = rows.withColumn("left", left).where("left > 0")
    return out.withColumn("used", F.least("text_chars", "left").cast("long")).drop("left")


def requeued(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs with expired leases back in the queue; attempts stay."""
    gone = F.coalesce((F.col("status") == "running") & (F.col("lease_expires_at") < now), F.lit(False))
    return jobs.withColumns(
        {"status": F.when(gone, "queued").otherwise(F.col("status")), "lease_expires_at": F.when(~gone, F.col("lease_expires_at"))}
    )


def after_failure(jobs: DataFrame, most: int = 3) -> DataFrame:
    """Next state of failed attempts: queued again after 2 to the attempts seconds while transient and under ``most``, else failed."""
    again = F.col("transient") & (F.col("attempt_count") < most)
    return jobs.withColumn("next_status", F.when(again, "queued").otherwise("failed")).withColumn(
        "delay", F.when(again, F.pow(F.lit(2.0), F.col("attempt_count")))
    )


def reusable(manifest: DataFrame, stored: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Manifest rows that stored has by keys, and those that need work."""
    have = stored.select(*keys).distinct()
    return manifest.join(have, keys, "left_semi"), manifest.join(have, keys, "left_anti")


def pending(inputs: DataFrame, stored: DataFrame) -> DataFrame:
    """Inputs (id, content_hash) whose stored hash is missing or different."""
    s = stored.select("id", F.col("content_hash").alias("stored_hash"))
    return inputs.join(s, "id", "left").where(~F.col("content_hash").eqNullSafe(F.col("stored_hash")))


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """stored with rows of new in place of those with the same key; the last in new wins by ``version``."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, key, F.desc("_new"), F.desc("version")).drop("_new", "rn")


def synchronized(existing: DataFrame, remote: DataFrame, key: list[str]) -> DataFrame:
    """existing brought up to date with remote (the same columns): remote's rows as they are, and existing ones it lacks with present false.

    A key that remote has twice counts once. Null keys are keys too.
    """
    fresh = remote.dropDuplicates(key)
    a, b = existing.alias("a"), fresh.alias("b")
    gone = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "left_anti")
    return fresh.withColumn("present", F.lit(True)).unionByName(gone.withColumn("present", F.lit(False)))


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of intervals (key, id, lo, hi) that overlap: a.lo < b.hi and a.hi > b.lo.

    Each interval is put into the cells of ``width`` it touches; a pair is given out only by the cell where its common
    part begins, so no pair comes twice and the join is on (key, cell).
    """

    def cells(df: DataFrame, p: str) -> DataFrame:
        span = F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))
        return df.where("hi > lo").select(F.col(key), *[F.col(c).alias(p + c) for c in ("id", "lo", "hi")], F.explode(span).alias("cell"))

    both = cells(a, "a_").join(cells(b, "b_"), [key, "cell"]).where("a_lo < b_hi and a_hi > b_lo")
    return both.where(F.floor(F.greatest("a_lo", "b_lo") / width) == F.col("cell")).drop("cell")


def nearest_before(points: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """For each point (key, id, at) the last event (key, event, time) at or before it, in one order of both; a busy key is spread over tasks."""
    p = points.select(key, "id", F.col("at"), F.lit(None).cast("long").alias("event"), F.lit(1).alias("side"))
    e = events.select(key, F.lit(None).cast("long").alias("id"), F.col("time").alias("at"), "event", F.lit(0).alias("side"))
    by = ["at", "side", "event", "id"]
    both = running_by_key(p.unionByName(e), key, [F.col(c).asc() for c in by], "last", "event", "last", by)
    return both.where("side = 1").select(key, "id", F.col("last").alias("event"))


def nearest_after(points: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """For each point (key, id, at) the first event (key, event, time) at or after it: the last one with time turned round."""
    turned = nearest_before(points.withColumn("at", -F.col("at")), events.withColumns({"time": -F.col("time"), "event": -F.col("event")}), key)
    return turned.withColumn("event", -F.col("event"))


def top_level(intervals: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Intervals that no strictly larger interval of the same key contains.

    With the widest first at each start, one is inside another exactly if an earlier one reaches as far.
    """
    once = intervals.groupBy(key, lo, hi).agg(F.count(F.lit(1)).alias("copies"))
    far = running_by_key(once, key, [F.asc(lo), F.desc(hi)], "max", hi, "far", upto=-1)
    return far.where(F.col("far").isNull() | (F.col("far") < F.col(hi))).drop("far")
