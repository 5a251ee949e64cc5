"""Admission of requests by a rolling-window limiter that requests share by key."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 60_000_000
SCHEMA = "key long, id long, at long, tokens long, admitted_at long, waited long"


class Limiter:
    """When one key's requests are let in, in turn. Times are microseconds.

    Two requests are at least a minute / ``requests`` apart, and no minute (open at its end) has more than ``requests``
    of them or more than ``tokens`` tokens; a request that is let in makes those behind it wait.
    """

    def __init__(self, requests: int, tokens: int):
        self.requests, self.tokens, self.apart = requests, tokens, -(-WINDOW // requests)
        self.window: deque[tuple[int, int]] = deque()
        self.used, self.last = 0, None

    def admit(self, at: int, tokens: int) -> int | None:
        """The time a request that came at ``at`` is let in; None if it is too large for any minute and is refused."""
        if tokens > self.tokens:
            return None
        now = at if self.last is None else max(at, self.last + self.apart)
        while True:
            while self.window and now - self.window[0][0] >= WINDOW:
                self.used -= self.window.popleft()[1]
            if len(self.window) < self.requests and self.used + tokens <= self.tokens:
                break
            now = self.window[0][0] + WINDOW
        self.window.append((now, tokens))
        self.used, self.last = self.used + tokens, now
        return now


def admissions(requests: DataFrame, per_minute: int, tokens_per_minute: int) -> DataFrame:
    """SCHEMA for requests (key, id, at in microseconds, tokens): when each is let in (null: refused) and how long it waited.

    Whether a request waits depends on all before it with its key, so a key is one sequence, in the order of at, then
    id. Keys are dealt to tasks and a task reads its rows in that order, one batch at a time: what it holds is the last
    minute of one key, at most ``per_minute`` requests, however many a key has. Null keys share a limiter, null tokens
    count as 0, requests without a time are left out.
    """
    rows = requests.where("at is not null").select("key", "id", "at", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "at", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, limiter = object(), None
        for b in batches:
            keys, at, tokens = (b.column(c).to_pylist() for c in ("key", "at", "tokens"))
            out: list[int | None] = []
            for k, t, n in zip(keys, at, tokens, strict=True):
                if limiter is None or k != key:
                    key, limiter = k, Limiter(per_minute, tokens_per_minute)
                out.append(limiter.admit(t, n))
            waited = [None if o is None else o - t for o, t in zip(out, at, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), b.column("at"), b.column("tokens"), pa.array(out, pa.int64()), pa.array(waited, pa.int64())], [c.split()[0] for c in SCHEMA.split(", ")])

    return ordered.select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.col("at").cast("long").alias("at"), "tokens").mapInArrow(run, SCHEMA)
