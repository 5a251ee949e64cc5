"""Text chunking as table functions: one row in, its chunks out, by offsets in the batch's buffers.

A chunking is a set of places where a text may be cut and a longest stretch; ``hops`` takes the furthest place in reach,
by binary search. Chunks of a text follow each other without gaps.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_SCHEMA = "doc_id long, chunk_index long, total_chunks long, byte_start long, byte_end long, line_start long, line_end long, chunk string"
#: White space that ECMAScript's trim() takes away, in UTF-8, without \n; a line of nothing else is blank.
SPACE = rb"(?:[\t\x0b\x0c\r ]|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf)"
BLANK = re.compile(b"^" + SPACE + rb"*(?:\n|\Z)", re.M)


def hops(start: int, end: int, places: np.ndarray, most: int, otherwise: np.ndarray) -> list[int]:
    """Cuts from start to end: each the furthest of the sorted places within ``most``, else of ``otherwise``, else at ``most``."""
    out = [start]
    while end - out[-1] > most:
        for stops in (places, otherwise):
            at = int(stops[np.searchsorted(stops, out[-1] + most, "right") - 1]) if stops.size and stops[0] <= out[-1] + most else 0
            if at > out[-1]:
                break
        else:
            at = out[-1] + most
        out.append(at)
    if end > out[-1]:
        out.append(end)
    return out


def paragraph_ends(raw: np.ndarray) -> np.ndarray:
    """Ends of a text's paragraphs: behind blank lines, and at the end."""
    blank = [m.end() for m in BLANK.finditer(raw.tobytes()) if m.end() > m.start()]
    return np.unique(np.array([*blank, raw.size]))


def packed_cuts(raw: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Cuts of a text into chunks of at most ``most`` bytes: behind blocks, whose ``ends`` are given, where such are in reach.

    A block that is too long is cut on its own, behind the last line that fits or else before a character; its parts
    then count as places to cut, as the ends of blocks do.
    """
    lines = np.unique(np.append(np.flatnonzero(raw == 10) + 1, raw.size))
    characters = np.flatnonzero((raw & 0xC0) != 0x80)
    places, begin = [ends], 0
    for e in ends[np.diff(np.append(0, ends)) > most]:
        begin = int(ends[np.searchsorted(ends, e) - 1]) if e > ends[0] else 0
        places.append(np.array(hops(begin, int(e), lines, most, characters)))
    return np.array(hops(0, raw.size, np.unique(np.concatenate(places)), most, characters))


def paragraph_cuts(raw: np.ndarray, most: int) -> np.ndarray:
    """Cuts of a text into chunks of at most ``most`` bytes: behind blank lines where such are in reach."""
    return packed_cuts(raw, paragraph_ends(raw), most)


def gathered(batches: Iterator[pa.RecordBatch], each: Callable[[pa.RecordBatch, int, bytes], list[list]], schema: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """What ``each`` gives for the rows with a text, as lists by column of schema, many texts (about limit bytes) a batch."""
    parts = [c.split() for c in schema.split(", ")] if ", " in schema else [schema.split()]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[p[1]] for p in parts]
    names, columns, size = [p[0] for p in parts], [[] for _ in parts], 0
    for b in batches:
        texts = b.column("text")
        for i in range(b.num_rows):
            data = (texts[i].as_py() or "").encode()
            if not data:
                continue
            for column, more in zip(columns, each(b, i, data), strict=True):
                column += more
            size += len(data)
            if size >= limit:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                columns, size = [[] for _ in parts], 0
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def chunk_text(docs: DataFrame, most: int = 1024) -> DataFrame:
    """Chunks of at most ``most`` UTF-8 bytes for every text of docs (doc_id, text); null and empty texts have none."""

    def each(b: pa.RecordBatch, i: int, data: bytes) -> list[list]:
        raw = np.frombuffer(data, np.uint8)
        cuts = paragraph_cuts(raw, most)
        lo, hi, n = cuts[:-1], cuts[1:], cuts.size - 1
        breaks = np.flatnonzero(raw == 10)
        first, last = np.searchsorted(breaks, lo) + 1, np.searchsorted(breaks, hi - 1) + 1
        chunks = [data[x:y].decode("utf-8", "replace") for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
        return [[b.column("doc_id")[i].as_py()] * n, list(range(n)), [n] * n, *(c.tolist() for c in (lo, hi, first, last)), chunks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(batches, each, CHUNK_SCHEMA)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, CHUNK_SCHEMA)


def window_lines(sizes: np.ndarray, target: int, overlap: float) -> list[tuple[int, int]]:
    """Line ranges (first, behind the last): as many lines as ``target`` holds, one at least.

    The next range begins so that at least ``overlap`` of the last one is repeated, but behind its first line.
    """
    upto = np.concatenate([[0], np.cumsum(sizes)])
    out, lo = [], 0
    while not out or out[-1][1] < sizes.size:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + target, "right")) - 1)
        out.append((lo, hi))
        again = max(round(float(upto[hi] - upto[lo]) * overlap), 1)
        lo = max(lo + 1, int(np.searchsorted(upto, upto[hi] - again, "right")) - 1)
    return out


def line_windows(docs: DataFrame, target: int = 4000, overlap: float = 0.2) -> DataFrame:
    """Windows of whole lines of at most ``target`` characters (see window_lines): doc_id, chunk_index, start_line, end_line, chunk."""
    names = ["doc_id", "chunk_index", "start_line", "end_line", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                lines = (text or "").splitlines(keepends=True) or [""]
                ranges = window_lines(np.fromiter(map(len, lines), np.int64), target, overlap)
                lo, hi = (np.array(x) for x in zip(*ranges, strict=True))
                chunks = pa.array(["".join(lines[x:y]) for x, y in ranges], pa.string())
                cols = [pa.array([doc_id] * lo.size, pa.int64()), pa.array(np.arange(lo.size)), pa.array(lo + 1), pa.array(hi), chunks]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_index long, start_line long, end_line long, chunk string")


def line_blocks(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, block (from 0), id, line: a text's lines as blocks of a corpus; the id is that of path, place and line. Null texts have none."""
    lines = docs.select("doc_id", path, F.posexplode(F.split("text", "\n")).alias("block", "line"))
    name = F.sha2(F.concat_ws(":", path, F.col("block").cast("string"), "line"), 256)
    return lines.select("doc_id", F.col("block").cast("long").alias("block"), name.alias("id"), "line")
