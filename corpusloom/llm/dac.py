"""Directly addressable codes: token ids in chunk levels with continuation bitmaps and rank directories.

A segment holds whole documents. Level 0 has the low chunk of every id, each further level the next chunk of the ids
that continue. Bit i of a level's bitmap tells whether entry i continues; the number of set bits before each block of
512 gives its place on the next level, so any token is read from a few bytes, without decoding a block.

Files are segments one behind the other, as they are, without compression: a token of a file is read by seeking to the
bytes it needs (see TokenReader and read_token), and Spark reads whole files (see read_tokens). A segment ends with a
line feed, which is what Spark's writer of raw rows puts behind each.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, partitions, pieces, scratch, shared_dir
from corpusloom.llm.tokens import encoder

MAGIC, BLOCK = b"DAC2", 512
#: A segment is closed once it holds so many tokens; a file has at most so many segments.
SEGMENT_TOKENS, FILE_SEGMENTS = 1 << 16, 256
#: Magic, bytes of the segment, its part, its number and first token within the part, documents, tokens.
HEADER = "<4sQIQQIQ"
HEADER_BYTES = struct.calcsize(HEADER)
INDEX = "file string, at long, first long, n_tokens long"


def pack_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, part: int = 0, seg: int = 0, start: int = 0) -> bytes:
    """One segment's bytes but for the line feed: header, document directory, number of levels, levels."""
    out = [np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()]
    out.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes())
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, rest.size, BLOCK), dtype=np.uint32))]) if rest.size else np.zeros(1)
        levels.append(struct.pack("<Q", rest.size) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    body = b"".join([*out, struct.pack("<I", len(levels)), *levels])
    return struct.pack(HEADER, MAGIC, HEADER_BYTES + len(body) + 1, part, seg, start, len(doc_ids), ids.size) + body


class TokenReader:
    """Tokens of one segment, each from a few bytes; read(at, n) gives n bytes of the file, at is where the segment begins."""

    def __init__(self, read: Callable[[int, int], bytes], at: int = 0):
        self.read = read
        magic, _, _, _, _, n_docs, self.size = struct.unpack(HEADER, read(at, HEADER_BYTES))
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at += HEADER_BYTES + 17 * n_docs + 8
        (n_levels,) = struct.unpack("<I", read(at, 4))
        at += 4
        self.levels = []  # where a level's chunks, bits and ranks begin
        for _ in range(n_levels):
            (n,) = struct.unpack("<Q", read(at, 8))
            bits = at + 8 + n
            ranks = bits + -(-n // 8)
            self.levels.append((at + 8, bits, ranks))
            at = ranks + 4 * (-(-n // BLOCK) + 1)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value, shift = 0, 0
        for low, bits, ranks in self.levels:
            value |= self.read(low + i, 1)[0] << shift
            block = i // BLOCK
            before = np.frombuffer(self.read(bits + block * BLOCK // 8, (i >> 3) + 1 - block * BLOCK // 8), np.uint8).copy()
            if not before[-1] >> (i & 7) & 1:
                break
            before[-1] &= (1 << (i & 7)) - 1
            i, shift = struct.unpack("<I", self.read(ranks + 4 * block, 4))[0] + int(np.bitwise_count(before).sum()), shift + 8
        return value


class Segment:
    """A segment's image, read in place."""

    def __init__(self, image: bytes):
        magic, self.length, self.part, self.seg, self.start, n_docs, self.size = struct.unpack_from(HEADER, image)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at = HEADER_BYTES
        ids = np.frombuffer(image, "<i8", n_docs, at)
        none = np.frombuffer(image, np.uint8, n_docs, at := at + 8 * n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, none, strict=True)]
        self.starts = np.frombuffer(image, "<u8", n_docs + 1, at := at + n_docs)
        (n_levels,) = struct.unpack_from("<I", image, at := at + 8 * (n_docs + 1))
        at += 4
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", image, at)
            low = np.frombuffer(image, np.uint8, n, at := at + 8)
            bits = np.frombuffer(image, np.uint8, -(-n // 8), at := at + n)
            ranks = np.frombuffer(image, "<u4", -(-n // BLOCK) + 1, at := at + bits.size)
            at += 4 * ranks.size
            self.levels.append((low, bits, ranks))

    def tokens(self) -> np.ndarray:
        """All ids, level by level."""
        places, out = np.arange(self.size), np.zeros(self.size, np.uint32)
        for k, (low, bits, _) in enumerate(self.levels):
            out[places] |= low.astype(np.uint32) << np.uint32(8 * k)
            places = places[np.unpackbits(bits, count=low.size, bitorder="little").astype(bool)]
        return out


def segments(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """Where each segment of a file begins, and its bytes."""
    at, whole = 0, memoryview(data)
    while at < len(whole):
        length = struct.unpack_from(HEADER, whole, at)[1]
        yield at, whole[at : at + length]
        at += length


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, added: bool = False, path: str | None = None) -> str:
    """Tokenize every whole text, append end_id, write files of segments in ascending doc_id order; returns their folder.

    Without a path it is one of the shared folder. Parts ascend with doc_id, as do segments within a part. Null texts
    count as empty; a null doc_id comes first and stays null; rows with one doc_id follow each other in the order of
    their texts. With ``added``, tokens of the file that stand in a text have their own id (see Encoder).
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer, added), TaskContext.get().partitionId()
        doc_ids, held, seg, start, n = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            image = pack_segment(doc_ids, np.array([len(x) for x in held]), np.concatenate(held), part, seg, start)
            return pa.RecordBatch.from_arrays([pa.array([image], pa.binary())], ["image"])

        for b in pieces(batches, "text", 4 << 20):
            for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                doc_ids.append(d)
                held.append(np.append(ids, np.uint32(end_id)))
                n += held[-1].size
                if n >= SEGMENT_TOKENS:
                    yield close()
                    doc_ids, held, seg, start, n = [], [], seg + 1, start + n, 0
        if doc_ids:
            yield close()

    # As text without a codec, rows are written byte for byte, with a line feed behind each.
    raw = ordered.mapInArrow(run, "image binary").select(F.col("image").cast("string").alias("value"))
    raw.write.option("compression", "none").option("lineSep", "\n").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)
    with scratch():
        _indexed(spark, path).sortWithinPartitions("first").write.parquet(f"{path}/_index")
    return path


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """file, at, first, n_tokens of every segment: where it begins in its file, and in the sequence of all ids.

    One row a segment, written once beside the token files; none of these is read for it again.
    """
    return spark.read.schema(INDEX).parquet(f"{path}/_index")


def _indexed(spark: SparkSession, path: str) -> DataFrame:
    """token_index from the headers of the files just written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = [(at, *struct.unpack_from(HEADER, image)) for at, image in segments(data.as_buffer())]
                at, _, _, part, _, start, _, n = zip(*rows, strict=True) if rows else [()] * 8
                cols = [pa.array(x, pa.int64()) for x in (at, part, start, n)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), *cols], ["file", "at", "part", "start", "n_tokens"])

    headers = _files(spark, path).select("path", "content").mapInArrow(run, "file string, at long, part long, start long, n_tokens long")
    got = materialize(headers, "segment-headers")  # the files are read once for them
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    offsets = got.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return got.join(F.broadcast(offsets), "part").select("file", "at", (F.col("part_start") + F.col("start")).alias("first"), "n_tokens")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def read_token(spark: SparkSession, index: DataFrame, k: int) -> int:
    """Id number k of all, by seeking in one file; index as of token_index."""
    hit = index.where((F.col("first") <= k) & (F.col("first") + F.col("n_tokens") > k)).first()
    if hit is None:
        raise IndexError(k)
    file = spark._jvm.org.apache.hadoop.fs.Path(hit["file"])
    stream = file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(file)

    def read(at: int, n: int) -> bytes:
        stream.seek(at)
        return bytes(stream.readNBytes(n))

    try:
        return TokenReader(read, hit["at"])[k - hit["first"]]
    finally:
        stream.close()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written files.

    start counts all ids before the document's; the parts' totals (one row each) give the parts' offsets.
    """
    index = token_index(spark, path)
    firsts = index.where("at = 0").select("file", "first")  # a file's segments follow each other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data in zip(b.column("first").to_pylist(), b.column("content"), strict=True):
                for _, image in segments(data.as_buffer()):
                    s = Segment(image)
                    ids = s.tokens().astype("<u4")
                    ends = s.starts.astype(np.int64)
                    crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.doc_ids, pa.int64()), pa.array(ends[:-1] + first), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    first += s.size

    placed = _files(spark, path).join(F.broadcast(firsts), F.col("path") == F.col("file")).select("first", "content")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
