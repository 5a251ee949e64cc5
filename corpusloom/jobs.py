"""Registered queries over job queues and published snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import files as sourcefiles
from corpusloom.operators import relational as R
from corpusloom.operators.stages import released, shared_folder, stored
from corpusloom.queries import query, read
from corpusloom.sources.published import ChunkStore
from corpusloom.streaming import queue

LEASE = 12

_EVENTS = """e AS (SELECT user_id AS job, event_id AS id, epoch_us(ts) // 3600000000 AS "at", CASE event_type WHEN 'signup' THEN 'ensure' WHEN 'view' THEN 'claim'
 WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'claim' ELSE 'heartbeat' END WHEN 'error' THEN CASE WHEN event_id % 7 = 0 THEN 'break' ELSE 'fail' END ELSE 'succeed' END AS kind FROM events)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as those of a job, an hour for a second."""
    t, even, seventh = F.col("event_type"), F.col("event_id") % 2 == 0, F.col("event_id") % 7 == 0
    kind = F.when(t == "signup", "ensure").when(t == "view", "claim").when(t == "click", F.when(even, "claim").otherwise("heartbeat"))
    kind = kind.when(t == "error", F.when(seventh, "break").otherwise("fail")).otherwise("succeed")
    at = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), at.alias("at"), kind.alias("kind"))


@query(f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY "at", id) AS n FROM e),
m(stage, name, most) AS (VALUES (1, 'ingestion', 3), (2, 'chunking', 3), (3, 'embedding', 2)),
run AS (SELECT DISTINCT job, 0::BIGINT AS n, NULL::BIGINT AS id, 0::BIGINT AS "at", '' AS kind, 1 AS stage, 'none' AS status, 0::BIGINT AS attempts, NULL::BIGINT AS lease, NULL::BIGINT AS next_at,
  NULL::BIGINT AS gone, 1 AS was_stage, 0::BIGINT AS was_attempts, NULL::BIGINT AS was_next FROM e
 UNION ALL SELECT job, n, id, "at", kind, CASE WHEN act = 'done' AND stage < 3 THEN stage + 1 ELSE stage END,
  CASE act WHEN 'new' THEN 'queued' WHEN 'take' THEN 'running' WHEN 'done' THEN CASE WHEN stage < 3 THEN 'queued' ELSE 'succeeded' END WHEN 'again' THEN 'queued' WHEN 'end' THEN 'failed' ELSE st END,
  CASE WHEN act = 'new' OR act = 'done' AND stage < 3 THEN 0 WHEN act = 'take' THEN attempts + 1 ELSE attempts END,
  CASE WHEN act IN ('take', 'hold') THEN "at" + {LEASE} WHEN act IN ('done', 'again', 'end') OR gone IS NOT NULL THEN NULL ELSE lease END,
  CASE WHEN act IN ('new', 'take', 'end') THEN NULL WHEN act = 'again' THEN "at" + (1 << attempts) ELSE next_at END, gone, stage, attempts, next_at
 FROM (SELECT *, CASE WHEN kind = 'ensure' AND st IN ('none', 'failed') THEN 'new' WHEN kind = 'claim' AND st = 'queued' AND coalesce(next_at <= "at", true) THEN 'take' WHEN st <> 'running' THEN '' WHEN kind = 'heartbeat' THEN 'hold'
   WHEN kind = 'succeed' THEN 'done' WHEN kind = 'fail' AND attempts < most THEN 'again' WHEN kind IN ('fail', 'break') THEN 'end' ELSE '' END AS act
  FROM (SELECT run.job, o.n, o.id, o."at", o.kind, run.stage, most, run.attempts, run.lease, run.next_at, CASE WHEN status = 'running' AND run.lease < o."at" THEN run.lease END AS gone,
    CASE WHEN status = 'running' AND run.lease < o."at" THEN 'queued' ELSE status END AS st FROM run JOIN o ON o.job = run.job AND o.n = run.n + 1 JOIN m USING (stage)))),
told AS (SELECT job, id, "at", kind, stage, status, attempts, lease, next_at FROM run WHERE n > 0
 UNION ALL SELECT job, NULL, gone, 'lease_expired', was_stage, 'queued', was_attempts, NULL, was_next FROM run WHERE gone IS NOT NULL
 UNION ALL SELECT job, NULL, lease, 'lease_expired', stage, 'queued', attempts, NULL, next_at FROM (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY job ORDER BY n DESC) = 1) WHERE status = 'running' AND lease < (SELECT max("at") FROM e))
SELECT job, id, "at", kind, name AS stage, status, attempts, lease, next_at FROM told JOIN m USING (stage)""")
def x01_job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every event did to its job, through three stages, and the leases that ran out."""
    events = job_events(spark, sf_dir)
    return queue.transitions(events, LEASE, events.agg(F.max("at")).first()[0])


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of all source files: in the second some have moved and others changed."""
    k = F.col("doc_id")
    rows = sourcefiles.source_files(spark, sf_dir).withColumn("path", F.when(k % 13 == 0, F.concat(F.lit("vendor/"), "path")).otherwise(F.col("path")))
    rows = rows.withColumn("text", F.when(k % 17 == 0, "  \n").otherwise(F.col("text")))
    changed = F.when((k % 5 == 0) & (k % 17 != 0), F.concat("text", F.lit("\nend.\n"))).otherwise(F.col("text"))
    moved = F.when(k % 7 == 3, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return rows.select("path", "text"), rows.select(moved.alias("path"), changed.alias("text"))


@query(f"""WITH {sourcefiles._FILES}, r AS (SELECT doc_id AS k, CASE WHEN doc_id % 13 = 0 THEN 'vendor/' ELSE '' END || path AS path, CASE WHEN doc_id % 17 = 0 THEN '  ' || chr(10) ELSE text END AS text FROM files),
pair AS (SELECT 'first' AS snapshot, k, path, text, false AS had FROM r
 UNION ALL SELECT 'second', k, CASE WHEN k % 7 = 3 THEN 'moved/' ELSE '' END || path, CASE WHEN k % 5 = 0 AND k % 17 <> 0 THEN text || chr(10) || 'end.' || chr(10) ELSE text END, k % 7 <> 3 AND (k % 5 <> 0 OR k % 17 = 0) FROM r),
s AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'generated_or_dependency_path' WHEN trim(text, ' ' || chr(10)) = '' THEN 'empty_file' END AS reason FROM pair)
SELECT snapshot, path, CASE WHEN reason IS NULL THEN 'succeeded' ELSE 'skipped' END AS status, reason, strlen(text) AS size, reason IS NULL AND had AS reused,
 CASE WHEN reason IS NULL THEN strlen(text) END AS chunk_bytes, CASE WHEN reason IS NULL THEN sha256(text) END AS joined_sha256 FROM s""")
def k03_published_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots published one after the other, the first then dropped and its own files collected; what each showed."""
    store = ChunkStore(spark, f"{shared_folder(spark)}/published-{uuid.uuid4().hex}")
    first, second = _snapshots(spark, sf_dir)

    def shown(name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk")))
        joined = F.array_join(F.transform(ordered, lambda c: c["chunk"]), "")
        whole = store.chunks(name).groupBy("file_key").agg(F.sum(F.col("byte_end") - F.col("byte_start")).alias("chunk_bytes"), F.sha2(joined, 256).alias("joined_sha256"))
        return store.members(name).join(whole, "file_key", "left").select(F.lit(name).alias("snapshot"), "path", "status", "reason", "size", "reused", "chunk_bytes", "joined_sha256")

    store.publish("first", first)
    with released(spark):
        seen = stored(shown("first"))
    store.publish("second", second)
    store.drop("first")
    store.collect_garbage()
    return seen.unionByName(shown("second"))


@query("""WITH old AS (SELECT user_id, max(event_id) AS version, arg_max(event_type, event_id) AS kind FROM events WHERE event_type <> 'error' GROUP BY user_id), new AS (SELECT user_id, max(event_id) AS version, arg_max(event_type, event_id) AS kind FROM events WHERE value > 70 GROUP BY user_id)
SELECT user_id, version, kind, true AS present FROM new UNION ALL SELECT user_id, version, kind, false FROM old WHERE user_id NOT IN (SELECT user_id FROM new)""")
def k10_synchronized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension of users brought up to date with a later look at them."""
    e = read(spark, sf_dir, "events")
    last = lambda rows: rows.groupBy("user_id").agg(F.max("event_id").alias("version"), F.max_by("event_type", "event_id").alias("kind"))
    return R.synchronized(last(e.where("event_type <> 'error'")), last(e.where("value > 70")), ["user_id"])
