"""Source snapshots: tar archives to file tables, manifests to entries, and their comparison.

A task only lists an archive's members; which of them are files of the snapshot, and whether the archive is sound, are
column expressions and aggregates over the member rows.
"""

from __future__ import annotations

import hashlib
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

_MEMBERS = "archive string, name string, kind string, size long, sha256 string, content binary"


def unsafe_path(path: Column) -> Column:
    """Whether a path is empty or absolute, has a backslash, or goes up."""
    return F.coalesce((path == "") | path.startswith("/") | path.contains("\\") | path.rlike(r"(^|/)\.\.(/|$)"), F.lit(True))


def file_problem(path: Column, size: Column, content: Column, largest: int) -> Column:
    """Why a file isn't taken, or null: its path, a size other than the manifest's, too many bytes, or no UTF-8."""
    return (
        F.when(unsafe_path(path), "unsafe_path")
        .when(F.octet_length(content) != size, "manifest_size_mismatch")
        .when(size > largest, "file_too_large_for_chunking")
        .when(~F.is_valid_utf8(content.cast("string")), "invalid_utf8")
    )


def route(size: Column, large: int, largest: int) -> Column:
    """How a file of this size is chunked: ordinary, large (on its own, from ``large`` bytes), or not at all (too_large, over ``largest``)."""
    return F.when(size > largest, "too_large").when(size >= large, "large").otherwise("ordinary")


#: Bytes of members that make up a batch, about.
BATCH = 16 << 20


def members(spark: SparkSession, path: str) -> DataFrame:
    """One row for each member of the tar archives (any compression) under path; kind is file, link, directory or other."""
    names, kinds = [c.split()[0] for c in _MEMBERS.split(", ")], (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())

    def rows(archive: str, tar: tarfile.TarFile) -> Iterator[tuple]:
        for m in tar:
            kind = "link" if m.issym() or m.islnk() else "directory" if m.isdir() else "file" if m.isfile() else "other"
            content = tar.extractfile(m).read() if kind == "file" else None
            yield archive, m.name.removeprefix("./"), kind, m.size, hashlib.sha256(content).hexdigest() if kind == "file" else None, content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for archive, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                with tarfile.open(fileobj=io.BytesIO(raw.as_buffer()), mode="r:*") as tar:
                    for row in rows(archive, tar):
                        held.append(row)
                        size += len(row[-1] or b"") + 200
                        if size >= BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _MEMBERS)


def files(rows: DataFrame, most_files: int = 100_000, most_bytes: int = 1 << 30, largest: int = 20 << 20) -> DataFrame:
    """archive, path, size, sha256, content of the members (see members) that are files, without the root folder.

    Directories, links and files outside a root are left out. Unsafe names, other kinds, more than one root, a path
    that stands twice, a file over ``largest``, and too many files or bytes are errors of the whole archive.
    """
    path = F.regexp_replace("name", "^[^/]+/", "")
    inside = rows.withColumn("root", F.when(F.col("name").contains("/"), F.substring_index("name", "/", 1)))
    taken = (F.col("kind") == "file") & F.col("name").contains("/")
    each = inside.groupBy("archive", path.alias("path")).agg(
        F.max(F.when(unsafe_path(F.col("name")), F.concat(F.lit("unsafe path: "), "name"))).alias("unsafe"),
        F.max(F.when(F.col("kind") == "other", F.concat(F.lit("unsupported entry: "), "name"))).alias("other"),
        F.max(F.when(taken & (F.col("size") > largest), F.concat(F.lit("file too large: "), "name"))).alias("large"),
        F.count_if(taken).alias("n"), F.sum(F.when(taken, F.col("size")).otherwise(0)).alias("bytes"), F.min("root").alias("lo"), F.max("root").alias("hi"),
    )
    whole = each.groupBy("archive").agg(
        F.coalesce(
            F.max("unsafe"), F.max("other"), F.max("large"), F.max(F.when(F.col("n") > 1, F.concat(F.lit("duplicate entry: "), "path"))),
            F.when(F.min("lo") != F.max("hi"), "more than one root"), F.when(F.sum("n") > most_files, "too many files"),
            F.when(F.sum("bytes") > most_bytes, "too many bytes"), F.when(F.sum("n") == 0, "no files"),
        ).alias("problem")
    )
    # From the archives' side, so that one without files is judged too.
    both = whole.join(rows.where(taken).select("archive", path.alias("_path"), "size", "sha256", "content"), "archive", "left")
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("string")).otherwise(F.col("_path"))
    return both.select("archive", checked.alias("path"), "size", "sha256", "content").where("path is not null")


def read_archives(spark: SparkSession, path: str, most_files: int = 100_000, most_bytes: int = 1 << 30) -> DataFrame:
    """Files of all tar archives under path (see files)."""
    return files(members(spark, path), most_files, most_bytes)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries (path, size, sha256) of JSON manifests of version 1; another version is an error."""
    schema = "version int, files array<struct<path string, size long, sha256 string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    good = F.when(F.col("version") == 1, F.col("files")).otherwise(F.raise_error(F.lit("unsupported manifest version")))
    return raw.select(F.explode(good).alias("f")).select("f.*")


def differences(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entries that only one side has, with side; empty means verified."""
    cols = ["path", "size", "sha256"]
    a, b = entries.select(*cols), manifest.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("entries")).unionByName(b.exceptAll(a).withColumn("side", F.lit("manifest")))


def publish_manifest(entries: DataFrame, folder: str) -> tuple[int, int]:
    """Write the manifest (version 1) of an archive's files (path, size, sha256) into folder, by path; returns files and bytes.

    A manifest is one document; archives have a bounded number of files (see files). No files are an error, and a
    failed write leaves no manifest, as Spark's committer puts it in place at the end.
    """
    entry = F.struct("path", "size", "sha256")
    whole = entries.agg(F.array_sort(F.collect_list(entry)).alias("files"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    totals = whole.select("n", "bytes").first()
    if not totals["n"]:
        raise ValueError("empty_archive")
    whole.select(F.to_json(F.struct(F.lit(1).alias("version"), "files")).alias("value")).coalesce(1).write.mode("overwrite").text(folder)
    return totals["n"], totals["bytes"]


def verified(spark: SparkSession, archive: str, manifest: str) -> DataFrame:
    """Files of an archive whose manifest has the same ones; else an error, snapshot_manifest_mismatch."""
    got = read_archives(spark, archive)
    if not differences(got, read_manifest(spark, manifest)).isEmpty():
        raise ValueError("snapshot_manifest_mismatch")
    return got


def loaded(entries: DataFrame, largest: int) -> DataFrame:
    """entries (path, size, content, any others) with text and reason: why a file isn't chunked, by its name, bytes or content, or null.

    The name's and the bytes' problems come before the content's; text is null where they have one.
    """
    problem = file_problem(F.col("path"), F.col("size"), F.col("content"), largest)
    checked = entries.withColumn("reason", problem)
    text = checked.withColumn("text", F.when(F.col("reason").isNull(), F.col("content").cast("string")))
    return text.withColumn("reason", F.coalesce("reason", T.content_problem(F.col("text"))))
