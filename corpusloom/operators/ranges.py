"""Running sums over all rows of a table: rows are range-partitioned, and ranges carry on from the sums of those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.stages import stored


def running_sums(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """df with each of values replaced by its sum over all rows up to and with the row, in the order given; no two rows may tie.

    No task holds more than its range, and the driver gets one row of sums a range.
    """
    spark = df.sparkSession
    parts = stored(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))
    upto, before = [], [0] * len(values)
    for r in parts.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values)).orderBy("_part").collect():
        upto.append((r["_part"], *before))
        before = [a + (r[v] or 0) for a, v in zip(before, values, strict=True)]
    offsets = spark.createDataFrame(upto or [(-1, *before)], ", ".join(["_part int", *(f"_{v} long" for v in values)]))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = parts.join(F.broadcast(offsets), "_part")  # one row a range
    return whole.withColumns({v: F.sum(v).over(w) + F.col(f"_{v}") for v in values}).drop("_part", *(f"_{v}" for v in values))


def totals_from(points: DataFrame, asked: DataFrame, value: str, sums: list[str], by: list[str] = ()) -> DataFrame:
    """by, value and, as sums, the totals of those points (by, value, sums) that are at or over each value asked for (by, value).

    Points and values asked for are sorted together once and totals read from running sums, so rows are those of points
    and of asked, never their product. Equal values are summed first; nulls among them count for nothing.
    """
    by = list(by)
    zero = [F.lit(0).cast("long").alias(s) for s in sums]
    every = points.where(F.col(value).isNotNull()).select(*by, value, *(F.col(s).cast("long").alias(s) for s in sums), F.lit(False).alias("_asked"))
    every = every.unionByName(asked.where(F.col(value).isNotNull()).select(*by, value, *zero, F.lit(True).alias("_asked")))
    merged = every.groupBy(*by, value).agg(*(F.sum(s).alias(s) for s in sums), F.max("_asked").alias("_asked"))
    run = running_sums(merged, [*(F.col(b).asc() for b in by), F.col(value).desc()], sums)
    told = run.where("_asked").drop("_asked")
    if not by:
        return told
    # Sums run on from one group into the next: take off what the groups before it have. One row a group.
    groups = points.groupBy(*by).agg(*(F.sum(F.when(F.col(value).isNotNull(), F.col(s))).alias(s) for s in sums))
    w = Window.orderBy(*(F.col(b).asc() for b in by)).rowsBetween(Window.unboundedPreceding, -1)
    before = groups.unionByName(asked.select(*by, *zero)).groupBy(*by).agg(*(F.sum(F.coalesce(s, F.lit(0))).alias(s) for s in sums))
    before = before.select(*by, *(F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_{s}") for s in sums))
    return told.join(before, by).select(*by, value, *((F.col(s) - F.col(f"_{s}")).alias(s) for s in sums))


def running_by_key(df: DataFrame, key: str, order: list[Column], how: str, value: str, name: str, at: list[str] = (), upto: int = 0) -> DataFrame:
    """df with ``name``: the running sum, max or last value (not null) of ``value`` among its key's rows, up to and with each.

    ``upto`` of -1 leaves the row itself out.
    Rows are dealt by ranges of key and order, so a key that has most rows is spread over tasks; a range goes on with
    what its first key had before, one row a range. No two rows of a key may tie. For ``last`` the order is that of the
    columns ``at``, ascending. Null keys are one key.
    """
    spark = df.sparkSession
    k, v = F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("key")), F.col(value)
    ordered = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col(key).asc_nulls_first(), *order)
    parts = stored(ordered.withColumn("_part", F.spark_partition_id()))
    there = v.isNotNull()
    whole = {"sum": F.sum(v), "max": F.max(v), "last": F.max_by(v, F.when(there, F.struct(*at))) if at else None}[how]
    each = parts.groupBy("_part", k.alias("_k")).agg(whole.alias("_v"))
    ends = each.groupBy("_part").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi"), F.max_by("_v", "_k").alias("v")).orderBy("_part").collect()
    both = {"sum": lambda a, b: (a or 0) + (b or 0), "max": lambda a, b: b if a is None else a if b is None else max(a, b), "last": lambda a, b: a if b is None else b}[how]
    carried, state = [], None
    for r in ends:
        goes_on = state is not None and state[0] == r["lo"]
        carried.append((r["_part"], r["lo"]["key"], state[1] if goes_on else None))
        state = (r["hi"], both(state[1], r["v"]) if goes_on and r["lo"] == r["hi"] else r["v"])
    kinds = dict(each.select("_v", F.col("_k.key").alias("key")).dtypes)
    carry = spark.createDataFrame(carried or [(-1, None, None)], f"_part int, _first {kinds['key']}, _carry {kinds['_v']}")
    w = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    mine = {"sum": F.sum(v), "max": F.max(v), "last": F.last(v, ignorenulls=True)}[how].over(w)
    before = F.when(F.col(key).eqNullSafe(F.col("_first")), F.col("_carry"))
    joined = {"sum": F.coalesce(mine, F.lit(0)) + F.coalesce(before, F.lit(0)), "max": F.greatest(mine, before), "last": F.coalesce(mine, before)}[how]
    return parts.join(F.broadcast(carry), "_part").withColumn(name, joined).drop("_part", "_first", "_carry")
