"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own setting: a query's shuffle files are removed when it ends; lost ones are made again by stage retries.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: While a table is written, batches for Python hold so much; a batch stands in the executor and in its Python worker.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may leave it unset and gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_corpusloom_dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark._corpusloom_dir = base
    return base.rstrip("/")


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables materialized inside are deleted at the end, but for those put into the list it gives."""
    _scratch.append([])
    keep: list[DataFrame] = []
    try:
        yield keep
    finally:
        for df in _scratch.pop():
            if df not in keep:
                discard(df)


def materialize(df: DataFrame, name: str, compression: str = "zstd", by: Sequence[str] = ()) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The write's shuffle files go when it ends, as the table stands for them. ``by``: columns that name its folders.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    held = {CLEANUP: "true", BATCH[0]: BATCH[1]}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df.write.option("compression", compression).partitionBy(*by).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that no later step reads."""
    remove(df.sparkSession, df._corpusloom_path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array as one uint8 array, and n+1 offsets; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32, n + 1, arr.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``limit`` bytes of text each; a longer row comes alone. Bounds a task's memory."""
    for b in batches:
        _, offs = buffers(b.column(column))
        start = 0
        while start < b.num_rows:
            stop = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), b.num_rows)
            yield b.slice(start, stop - start)
            start = stop


def global_rank(df: DataFrame, keys: list[Column], name: str) -> tuple[DataFrame, int]:
    """Add ``rank``: the row's place, from 0, in the order of keys; also returns the number of rows.

    Rows are range-partitioned and sorted; the partitions' sizes (one number each) give the offsets, so no task
    holds more than its range. Rows equal in all keys are ranked in any order.
    """
    spark = df.sparkSession
    mid = F.monotonically_increasing_id()
    ordered = materialize(
        df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("_mid", mid), name
    )
    part, place = F.shiftright("_mid", 33).cast("int"), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offs = spark.createDataFrame(starts or [(0, 0)], "_p int, _start long")  # one row for each partition
    out = ordered.withColumn("_p", part).join(F.broadcast(offs), "_p").withColumn("rank", F.col("_start") + place)
    return out.drop("_p", "_start", "_mid"), total
