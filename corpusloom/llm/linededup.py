"""Line dedup: levelled sorted runs of line hashes. A batch merge-anti-joins the runs, adds its own, and runs are compacted.

A run is a table of the 128-bit hashes of lines that no earlier run has, bucketed and sorted by them, so that a batch is
shuffled once by hash and meets every run without shuffling that again. ``fanout`` runs of a level are merged into one of
the next level: a hash is rewritten as often as there are levels, and a batch meets fewer than ``fanout`` runs a level.
Built-in functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, partitions, remove, scratch, shared_dir, text_or_empty

#: What is stripped at both ends of a line: ASCII's space and \t to \r.
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased and no other letter. lower() does just that to ASCII."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def line_hashes(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, text_hash, line (from 0), h1, h2 of every line whose key has at least ``least`` code points."""
    text = text_or_empty("text")
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line", "_line"))
    keys = lines.select("doc_id", "text_hash", "line", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= least)
    return keys.select("doc_id", "text_hash", "line", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit("second"), "_key").alias("h2"))


class LineRuns:
    """Runs of the line hashes seen so far, by level; they live in the shared folder until ``close``.

    ``add`` takes a batch's ``line_hashes`` and returns what it loses. An earlier batch wins over a later one, within a
    batch the smallest doc_id; null is above all, and rows of one doc_id are one document. Batches may be empty.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout, self.buckets = spark, fanout, partitions(spark)
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, df: DataFrame) -> tuple[str, str]:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).option("compression", "zstd").saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        remove(self.spark, run[1])

    def _hashes(self, run: tuple[str, str]) -> DataFrame:
        return self.spark.table(run[0]).where("not seen").select(*HASH)

    def add(self, lines: DataFrame) -> DataFrame:
        """doc_id, text_hash, dropped (sorted line numbers) of the batch's documents that lose lines; a written table."""
        ids = [F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unnamed")]
        found = lines.groupBy(*HASH).agg(*ids)
        marks = []
        for i, run in enumerate(r for level in self.levels for r in level):
            found = found.join(self._hashes(run).withColumn(f"in{i}", F.lit(True)), HASH, "left")
            marks.append(F.col(f"in{i}").isNotNull())
        seen = F.lit(False)
        for m in marks:
            seen = seen | m
        shared = F.coalesce((F.col("first") < F.col("last")) | F.col("unnamed"), F.lit(False)) & F.col("first").isNotNull()
        judged = found.select(*HASH, "first", seen.alias("seen"), (seen | shared).alias("told"))
        run = self._write(judged)
        # Read by path, not as a bucketed table: both sides are then shuffled and a frequent line's rows can be split.
        told = self.spark.read.schema(judged.schema).parquet(run[1]).where("told").select(*HASH, "first", "seen")
        lost = lines.join(told, HASH).where(F.col("seen") | ~F.col("doc_id").eqNullSafe(F.col("first")))
        dropped = F.sort_array(F.collect_set("line")).alias("dropped")
        out = materialize(lost.groupBy("doc_id", "text_hash").agg(dropped), "line-drops")
        self._admit(run)
        return out

    def _admit(self, run: tuple[str, str], level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fanout:
            return
        old, self.levels[level] = self.levels[level], []
        merged = self._hashes(old[0])
        for r in old[1:]:
            merged = merged.unionByName(self._hashes(r))
        self._admit(self._write(merged.withColumn("seen", F.lit(False)).repartition(self.buckets, *HASH)), level + 1)
        for r in old:
            self._drop(r)

    def close(self) -> None:
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []


def _batch(docs: DataFrame, batches: int) -> Column:
    """Number of a row's batch: ranges of doc_id of about equal size, ascending; a null is in the last."""
    at = [i / batches for i in range(1, batches)]
    cuts = docs.select(F.percentile_approx("doc_id", at, 1000).alias("cuts")).first()["cuts"] if at else None
    batch = F.lit(0)
    for c in cuts or []:
        batch = batch + F.coalesce(F.col("doc_id") > c, F.lit(True)).cast("int")
    return batch


def drop_repeated_lines(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs (doc_id: a whole number, text, any other columns) without lines that a smaller doc_id has.

    Lines are compared by ``line_key``, and only those with keys of at least ``least`` code points; the rest stay as they
    are, joined by \\n. Adds ``n_lines`` (before) and ``n_dropped``, which replace columns of these names. The table is
    treated in ``batches`` ranges of ascending doc_id, whose number changes no result. Null texts count as empty, which is
    one line; a null doc_id is above all others; rows of one doc_id are one document and each lose what that loses, so
    equal rows stay. Keys equal in 128 bits of hash count as equal.
    """
    spark = docs.sparkSession
    hashed = line_hashes(docs, least).withColumn("batch", _batch(docs, batches))
    with scratch() as keep:
        lines = materialize(hashed, "line-hashes", by=["batch"])
        runs, lost = LineRuns(spark, fanout), []
        try:
            for b in range(batches):
                lost.append(runs.add(lines.where(F.col("batch") == b).drop("batch")))
                keep.append(lost[-1])
        finally:
            runs.close()
    drops = lost[0]
    for d in lost[1:]:
        drops = drops.unionByName(d)
    return without_lines(docs, drops)


def without_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """docs without the line numbers ``dropped`` of drops (doc_id, text_hash, dropped), with n_lines and n_dropped."""
    text = text_or_empty("text")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_hash"))
    gone = drops.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"), "dropped")
    met = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_hash") == F.col("_gone_hash")), "left")
    split = met.select("_row", "dropped", F.split(text_or_empty(F.col("_row.text")), "\n").alias("_lines"))
    d, lines = F.col("dropped"), F.col("_lines")
    # Stretches of kept lines between the dropped ones: one pass, however many lines a text has.
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(d, i - 1) + 1)
    stretch = lambda i: F.slice(lines, begin(i) + 1, F.coalesce(F.get(d, i), F.size(lines)) - begin(i))
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(d)), stretch)), "\n")
    out = split.select("_row", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(d), F.lit(0)).cast("long").alias("n_dropped"), F.when(d.isNull(), text_or_empty(F.col("_row.text"))).otherwise(kept).alias("_kept"))
    others = [F.col("_kept").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*others, "n_lines", "n_dropped")


def kept_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is left of each text."""
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))
