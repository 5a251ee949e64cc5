"""Jobs that go through stages by events: claims with leases, retries with back-off, one stage after the other.

One fold of a job's events in time order says what each does. Over a table it runs over sorted rows, over a stream in
keyed state: there events wait until the watermark has passed them, so that files may come in any order, and a lease that
runs out is told by a timer, even if nothing more is heard of the job.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Stages in order, and how often each is tried.
STAGES = [("ingestion", 3), ("chunking", 3), ("embedding", 2)]
KINDS = ["ensure", "claim", "heartbeat", "succeed", "fail", "break"]
EVENTS = "job long, id long, at long, kind string"
SCHEMA = "job long, id long, at long, kind string, stage string, status string, attempts long, lease long, next_at long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class Job:
    """Where a job stands. Times are seconds; lease: till when a running one is held; next_at: from when a queued one may be claimed."""

    stage: int = 0
    status: str = "none"
    attempts: int = 0
    lease: int | None = None
    next_at: int | None = None

    def row(self, job: int, event: int | None, at: int, kind: str) -> tuple:
        return job, event, at, kind, STAGES[self.stage][0], self.status, self.attempts, self.lease, self.next_at

    def expire(self, now: int) -> int | None:
        """Back into the queue if its lease ran out before now; attempts stay. When that was."""
        if self.status != "running" or self.lease >= now:
            return None
        at, self.status, self.lease = self.lease, "queued", None
        return at

    def apply(self, kind: str, at: int, lease: int) -> None:
        """What an event does at its time; one that doesn't fit the status does nothing.

        ensure queues a job that is none, or a failed one anew; claim runs a queued one that is due; heartbeat holds it
        longer; succeed queues the next stage, or ends the last; fail (of a passing cause) queues it again after 2 to
        the attempts seconds while it may be tried again, break ends it.
        """
        if kind == "ensure" and self.status in ("none", "failed"):
            self.status, self.attempts, self.next_at = "queued", 0, None
        elif kind == "claim" and self.status == "queued" and (self.next_at is None or self.next_at <= at):
            self.status, self.attempts, self.lease, self.next_at = "running", self.attempts + 1, at + lease, None
        elif self.status != "running":
            return
        elif kind == "heartbeat":
            self.lease = at + lease
        elif kind == "succeed":
            last = self.stage == len(STAGES) - 1
            self.status, self.lease = "succeeded" if last else "queued", None
            if not last:
                self.stage, self.attempts = self.stage + 1, 0
        elif kind in ("fail", "break"):
            again = kind == "fail" and self.attempts < STAGES[self.stage][1]
            self.status, self.lease = "queued" if again else "failed", None
            self.next_at = at + 2**self.attempts if again else None


def fold(job: int, state: Job, events: Iterable[tuple[int, int, str]], lease: int) -> Iterator[tuple]:
    """Rows (SCHEMA) of a job's events (at, id, kind) in order: one an event, and one for each lease that ran out before it."""
    for at, event, kind in events:
        gone = state.expire(at)
        if gone is not None:
            yield state.row(job, None, gone, "lease_expired")
        state.apply(kind, at, lease)
        yield state.row(job, event, at, kind)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    cols = zip(*rows, strict=True) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(cols, SCHEMA.split(", "), strict=True)], NAMES)


def transitions(events: DataFrame, lease: int, until: int | None = None) -> DataFrame:
    """SCHEMA for a table of EVENTS: what each event did to its job, in the order of at, then id.

    Leases that run out before ``until`` after a job's last event are told too. Jobs are dealt to tasks and read in
    order, so a task holds one job's state at a time, however many events it has. Rows without job, time or kind are
    left out; events repeated with their id count once.
    """
    known = events.select(*(c.split()[0] for c in EVENTS.split(", "))).where("job is not null and at is not null and kind is not null").distinct()
    ordered = known.repartition("job").sortWithinPartitions("job", "at", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, state = None, Job()

        def end() -> list[tuple]:
            gone = state.expire(until) if job is not None and until is not None else None
            return [] if gone is None else [state.row(job, None, gone, "lease_expired")]

        for b in batches:
            rows: list[tuple] = []
            for j, i, at, kind in zip(*(b.column(c).to_pylist() for c in ("job", "id", "at", "kind")), strict=True):
                if j != job:
                    rows += end()
                    job, state = j, Job()
                rows += fold(j, state, [(at, i, kind)], lease)
            yield _batch(rows)
        yield _batch(end())

    return ordered.mapInArrow(run, SCHEMA)


def transition_stream(events: DataFrame, lease: int, late: str = "1 minute") -> DataFrame:
    """transitions of a stream of EVENTS with a time column ts (that of at): rows come once the watermark has passed them.

    State of a job: where it stands, and its events that the watermark hasn't passed. Events later than that, and ones
    repeated while they wait, are dropped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        stand, waiting = (json.loads(x) for x in held.get) if held.exists else ({}, [])
        state, now = Job(**stand), held.getCurrentWatermarkMs() // 1000
        new = {(int(r.at), int(r.id), r.kind) for p in parts for r in p.itertuples() if int(r.at) >= now}
        due = sorted(new | {tuple(w) for w in waiting})
        ready, waiting = [e for e in due if e[0] < now], [e for e in due if e[0] >= now]
        rows = list(fold(key[0], state, ready, lease))
        gone = state.expire(now)
        if gone is not None:
            rows.append(state.row(key[0], None, gone, "lease_expired"))
        held.update((json.dumps(asdict(state)), json.dumps(waiting)))
        times = [w[0] for w in waiting[:1]] + ([state.lease] if state.status == "running" else [])
        if times:
            held.setTimeoutTimestamp((max(min(times), now) + 1) * 1000)
        if rows:
            yield pd.DataFrame(rows, columns=NAMES).astype({c: "Int64" for c in ("job", "id", "at", "attempts", "lease", "next_at")})

    known = events.where("job is not null and at is not null and kind is not null").withWatermark("ts", late)
    return known.groupBy("job").applyInPandasWithState(step, SCHEMA, "state string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def run_queue(spark: SparkSession, landed: str, out: str, checkpoint: str, lease: int, late: str = "1 minute") -> None:
    """Read the event files that have landed (EVENTS as Parquet) and write their transitions to out; goes on where it ended.

    The checkpoint holds state and what was read, and the sink what was written, so a run that is stopped and started
    again gives each row once.
    """
    stream = spark.readStream.schema(EVENTS).parquet(landed).withColumn("ts", F.timestamp_seconds("at"))
    query = transition_stream(stream, lease, late).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
