"""Streams give what the same rows give as a table: over restarts, in any order of files, without doubles."""

import random

from pyspark.sql import functions as F

from corpusloom.streaming import jobs, queue

LEASE = 9


def job_rows(n=700, seed=1):
    rng = random.Random(seed)
    weights = dict(zip(queue.KINDS, (3, 6, 2, 6, 2, 1), strict=True))
    rows = [(rng.randrange(12), i, 1000 + rng.randrange(300), rng.choices(list(weights), weights.values())[0]) for i in range(n)]
    return sorted(rows, key=lambda r: r[2])


def plain(rows, lease, until):
    """States by hand, one event at a time, without the library's fold."""
    names, most, out = ["ingestion", "chunking", "embedding"], [3, 3, 2], []
    for job in sorted({r[0] for r in rows}):
        k, status, tries, held, after = 0, "none", 0, None, None
        for at, i, kind in [*sorted((r[2], r[1], r[3]) for r in rows if r[0] == job), (until, None, None)]:
            if status == "running" and held < at:
                status, gone, held = "queued", held, None
                out.append((job, None, gone, "lease_expired", names[k], status, tries, None, after))
            if kind is None:
                continue
            if kind == "ensure":
                if status in ("none", "failed"):
                    status, tries, after = "queued", 0, None
            elif kind == "claim":
                if status == "queued" and (after is None or after <= at):
                    status, tries, held, after = "running", tries + 1, at + lease, None
            elif status == "running":
                if kind == "heartbeat":
                    held = at + lease
                elif kind == "succeed":
                    held = None
                    status = "succeeded" if k == 2 else "queued"
                    if k < 2:
                        k, tries = k + 1, 0
                elif kind == "fail" and tries < most[k]:
                    status, held, after = "queued", None, at + 2**tries
                else:
                    status, held, after = "failed", None, None
            out.append((job, i, at, kind, names[k], status, tries, held, after))
    return out


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


def test_transitions_equal_a_plain_loop(spark):
    rows = job_rows()
    df = spark.createDataFrame([*rows, rows[5], (None, 1, 2, "claim"), (1, 2, None, "claim")], queue.EVENTS).repartition(5)
    got = _sorted(queue.transitions(df, LEASE, 2000).collect())
    assert got == _sorted(plain(rows, LEASE, 2000))
    assert {r[5] for r in got} >= {"queued", "running", "failed", "succeeded"} and any(r[3] == "lease_expired" for r in got) and any(r[4] == "embedding" for r in got)
    assert queue.transitions(df.limit(0), LEASE, 5).count() == 0


def test_queue_stream_equals_the_table_over_restarts(spark, tmp_path):
    """Three runs with new files between; files come out of order within the watermark; a far event at the end lets all out."""
    rows = job_rows()
    parts = [rows[:250], rows[250:450], rows[450:] + [(99, 10_000, 5000, "ensure"), (99, 10_001, 5001, "ensure")]]
    landed, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in parts:
        random.Random(3).shuffle(part)
        for half in (part[::2], part[1::2]):  # halves overlap in time
            spark.createDataFrame(half, queue.EVENTS).coalesce(1).write.mode("append").parquet(landed)
        queue.run_queue(spark, landed, out, checkpoint, LEASE, "400 seconds")
        queue.run_queue(spark, landed, out, checkpoint, LEASE, "400 seconds")  # nothing new: nothing twice
    got = _sorted(spark.read.parquet(out).where("job <> 99").collect())
    assert got == _sorted(plain(rows, LEASE, 4000))


def test_newest_states_of_a_stream(spark, tmp_path):
    """Files land between runs, one of them twice; each key keeps its newest row."""
    schema, rng = "k long, at long, v string", random.Random(6)
    rows = [(rng.randrange(9), i, f"v{i}") for i in range(120)]
    landed, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(landed)
        jobs.latest_states(spark, landed, schema, out, checkpoint, "k", "at")
    jobs.latest_states(spark, landed, schema, out, checkpoint, "k", "at")
    want = {k: (k, at, v) for k, at, v in rows}
    assert sorted(map(tuple, jobs.read_states(spark, out, "k", "at").select("k", "at", "v").collect())) == sorted(want.values())


def test_windowed_counts_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    base = 1_700_000_000
    events = spark.range(300).select(F.timestamp_seconds(F.lit(base) + F.col("id") * 7).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"))
    events = events.unionByName(spark.createDataFrame([(base + 900_000, "end", 0.0)], "t long, event_type string, value double").select(F.timestamp_seconds("t").alias("ts"), "event_type", "value"))
    landed, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.coalesce(1).write.parquet(landed)
    stream = jobs.windowed_counts(spark.readStream.schema(events.schema).parquet(landed))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    whole = jobs.windowed_counts(events).where("event_type <> 'end'")
    assert _sorted(spark.read.parquet(out).where("event_type <> 'end'").collect()) == _sorted(whole.collect())
