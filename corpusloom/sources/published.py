"""Chunks of source snapshots, published: files are chunked once and shared, a snapshot shows all of its files or none.

Chunks and memberships are written as Parquet into folders of their own, which nobody reads until a manifest names them.
A manifest is one small file with a number; it is put in place by a rename that fails if the number is taken, and
readers take the highest. So a publish that dies leaves what was visible, and one that is repeated replaces itself.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import languages as L
from corpusloom.functions import text as T
from corpusloom.operators import sourcecode as S
from corpusloom.operators.stages import released, stored

CHUNKS = (
    "file_key string, path string, content_sha256 string, chunk_id string, chunk_index long, byte_start long, byte_end long, line_start long, line_end long,"
    " chunk string, contextualized string, token_count long, strategy string"
)
#: Chunks as they are written: of ``contextualized``, which ends with the chunk, only what stands before it. Older folders have it whole.
WRITTEN = CHUNKS.replace("contextualized", "before")
#: A folder with garbage is rewritten in so many parts, so that a part's shuffle is small.
PARTS = 4
MEMBERS = "path string, status string, reason string, file_key string, size long, reused boolean"


@dataclass
class Manifest:
    """What is visible: the number, the members' folder of each snapshot, the folders with chunks."""

    number: int = 0
    snapshots: dict[str, str] = field(default_factory=dict)
    chunks: list[str] = field(default_factory=list)


class ChunkStore:
    """A folder of published snapshots, chunked with one profile of options."""

    def __init__(self, spark: SparkSession, folder: str, options: S.Options | None = None, budget: int | None = None):
        self.spark, self.folder, self.options, self.budget = spark, folder.rstrip("/"), options or S.Options(), budget
        self.profile = json.dumps([asdict(self.options), budget], sort_keys=True)
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._files = hadoop.FileContext.getFileContext(self._fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())

    # Manifests.

    def manifest(self) -> Manifest:
        home = self._path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(home)] if self._fs.exists(home) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return Manifest()
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{max(numbers):09d}"))
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()

    def _commit(self, change: Callable[[Manifest], Manifest]) -> Manifest:
        """Put the changed manifest in place under the next number; where another publisher took that, change what it put."""
        while True:
            now = self.manifest()
            new = change(Manifest(now.number, dict(now.snapshots), list(now.chunks)))
            new.number = now.number + 1
            draft, place = (self._path(f"{self.folder}/manifests/{n}") for n in (f"draft-{uuid.uuid4().hex}", f"{new.number:09d}"))
            stream = self._fs.create(draft)
            stream.write(bytearray(json.dumps(asdict(new)).encode()))
            stream.close()
            try:
                none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._files.rename(draft, place, none)
                return new
            except Exception as e:  # Py4J wraps it
                self._fs.delete(draft, False)
                if "FileAlreadyExists" not in str(e):
                    raise

    # Reading.

    def _chunks(self, m: Manifest) -> DataFrame:
        if not m.chunks:
            return self.spark.createDataFrame([], CHUNKS)
        rows = self.spark.read.schema(f"{WRITTEN}, contextualized string").parquet(*m.chunks)
        whole = F.coalesce("contextualized", F.concat("before", "chunk"))
        return rows.withColumn("contextualized", whole).select(*(c.split()[0] for c in CHUNKS.split(", ")))

    def members(self, snapshot: str) -> DataFrame:
        """MEMBERS of a snapshot: each entry's status, the reason if it isn't succeeded, and the key of its chunks."""
        return self.spark.read.schema(MEMBERS).parquet(self.manifest().snapshots[snapshot])

    def chunks(self, snapshot: str) -> DataFrame:
        """CHUNKS of a snapshot's files, whichever snapshot had them first."""
        return self._chunks(self.manifest()).join(self.members(snapshot).where("file_key is not null").select("file_key"), "file_key", "left_semi")

    # Writing.

    def publish(self, snapshot: str, entries: DataFrame) -> dict[str, int]:
        """Chunk a snapshot's entries (path, text) and make it visible; returns counts of its files by status and of new chunks.

        Entries with a reason to skip are members without chunks. Files that a visible snapshot has, by path and
        content, are not chunked again. A snapshot without a chunked file is an error and isn't published. A path that
        stands twice counts once, with its first text in order; null paths are left out, null texts are empty files.
        """
        with released(self.spark):
            return self._publish(snapshot, entries)

    def _publish(self, snapshot: str, entries: DataFrame) -> dict[str, int]:
        """Texts are shuffled once, by path, and meet the known files there; those to chunk are written, chunked as they are read, and deleted."""
        m = self.manifest()
        text = F.coalesce("text", F.lit(""))
        once = entries.where("path is not null").groupBy("path").agg(F.min(text).alias("text"))
        had = self._chunks(m).select("path", "file_key").groupBy("path").agg(F.collect_set("file_key").alias("keys"))
        reason = F.coalesce(T.skip_reason(F.col("path")), T.content_problem(F.col("text")))
        key = F.sha2(F.concat_ws("\0", F.lit(self.profile), "path", "content_sha256"), 256)
        known = once.withColumn("content_sha256", F.sha2("text", 256)).withColumn("file_key", key).join(had, "path", "left")
        known = known.withColumn("had", F.coalesce(F.array_contains("keys", F.col("file_key")), F.lit(False))).withColumn("reason", reason)
        need = F.when(F.col("reason").isNull() & ~F.col("had"), F.col("text"))
        work, *staged = (f"{self.folder}/{kind}/{uuid.uuid4().hex}" for kind in ("work", "chunks", "members"))
        try:
            judged = known.select("path", need.alias("text"), F.octet_length("text").cast("long").alias("size"), "reason", "content_sha256", "file_key", "had", F.monotonically_increasing_id().alias("doc_id"))
            judged.write.option("compression", "zstd").parquet(work)
            judged = self.spark.read.schema(judged.schema).parquet(work)
            files = judged.where("text is not null").select("doc_id", "path", "text", "file_key", "content_sha256")
            cut = S.chunk_sources(L.detect_sources(files), self.options, self.budget, ["file_key", "content_sha256", "path"]).where("error is null")
            place = F.concat_ws(":", "file_key", F.col("chunk_index").cast("string"), F.col("byte_start").cast("string"), F.col("byte_end").cast("string"))
            before = F.expr("left(contextualized, length(contextualized) - length(chunk))")
            out = cut.withColumns({"chunk_id": T.uuid5(F.sha2(place, 256)), "before": before})
            out.select(*(c.split()[0] for c in WRITTEN.split(", "))).write.option("compression", "zstd").parquet(staged[0])
            new = self.spark.read.schema(WRITTEN).parquet(staged[0])
            made = new.select("file_key").distinct().withColumn("made", F.lit(True))
            both = judged.drop("text").join(made, "file_key", "left")
            fine = F.col("reason").isNull() & (F.col("made").isNotNull() | F.col("had"))
            failed = F.lit("no_chunks") if self.budget is None else F.lit("embedding_input_too_large")
            status = F.when(F.col("reason").isNotNull(), "skipped").when(fine, "succeeded").otherwise("failed")
            rows = both.select("path", status.alias("status"), F.when(~fine, F.coalesce("reason", failed)).alias("reason"), F.when(fine, F.col("file_key")).alias("file_key"), "size", (fine & F.col("made").isNull()).alias("reused"))
            rows.write.parquet(staged[1])
        finally:
            self._fs.delete(self._path(work), True)
        told = self.spark.read.schema(MEMBERS).parquet(staged[1])
        counts = {r["status"]: r["n"] for r in told.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}  # three at most
        if not counts.get("succeeded"):
            for s in staged:
                self._fs.delete(self._path(s), True)
            raise ValueError("no_chunkable_files")
        chunks = new.count()

        def add(m: Manifest) -> Manifest:
            m.snapshots[snapshot] = staged[1]
            m.chunks.append(staged[0])
            return m

        self._commit(add)
        return {s: counts.get(s, 0) for s in ("succeeded", "skipped", "failed")} | {"chunks": chunks, "reused": told.where("reused").count()}

    def drop(self, snapshot: str) -> None:
        """Make a snapshot invisible; files that others have stay."""

        def less(m: Manifest) -> Manifest:
            m.snapshots.pop(snapshot, None)
            return m

        self._commit(less)

    def collect_garbage(self) -> int:
        """Rewrite folders of chunks without those of files that no snapshot or an earlier folder has, and delete all folders no manifest names; returns rows dropped.

        A folder without such files stays as it is. Not while a publish is under way, whose folders no manifest names
        yet, nor while old manifests are being read.
        """
        with released(self.spark):
            return self._collect()

    def _collect(self) -> int:
        m = self.manifest()
        live, earlier = self.spark.createDataFrame([], "file_key string"), None
        for folder in m.snapshots.values():
            live = live.unionByName(self.spark.read.schema(MEMBERS).parquet(folder).where("file_key is not null").select("file_key"))
        live, folders, dropped = stored(live.distinct()), {}, 0
        for folder in m.chunks:
            rows = self._chunks(Manifest(chunks=[folder]))
            files = stored(rows.groupBy("file_key").agg(F.count(F.lit(1)).alias("n")))
            kept = files.join(live, "file_key", "left_semi")
            kept = stored(kept if earlier is None else kept.join(earlier, "file_key", "left_anti"))
            earlier = kept.select("file_key") if earlier is None else earlier.unionByName(kept.select("file_key"))
            before, after = (x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (files, kept))
            dropped += before - after
            folders[folder] = folder if after == before else f"{self.folder}/chunks/{uuid.uuid4().hex}" if after else None
            if after and after < before:
                whole = rows.withColumn("before", F.expr("left(contextualized, length(contextualized) - length(chunk))")).select(*(c.split()[0] for c in WRITTEN.split(", ")))
                for i in range(PARTS):
                    part = F.pmod(F.xxhash64("file_key"), F.lit(PARTS)) == i
                    whole.where(part).join(kept.where(part).select("file_key"), "file_key", "left_semi").select(whole.columns).write.mode("append").option("compression", "zstd").parquet(folders[folder])

        def swap(m: Manifest) -> Manifest:
            m.chunks = [f for c in m.chunks if (f := folders.get(c, c))]
            return m

        m = self._commit(swap)
        named = {self._path(p).getName() for p in [*m.chunks, *m.snapshots.values()]}
        for kind in ("chunks", "members", "work"):
            home = self._path(f"{self.folder}/{kind}")
            for s in self._fs.listStatus(home) if self._fs.exists(home) else []:
                if s.getPath().getName() not in named:
                    self._fs.delete(s.getPath(), True)
        return dropped
