"""Media columns: Netpbm and BMP images in a binary column, decoded to numpy, area-resized, tiled and hashed.

Decoding is per row inside Arrow batches; Spark partitions the work. Null media gives null features; of a malformed
image the column error tells what is wrong, and its features are null.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import buffers, materialize, pieces

WIDTH = 64


def encode_netpbm(a: np.ndarray) -> bytes:
    """A uint8 array of (rows, columns) as binary PGM, of (rows, columns, 3) as binary PPM."""
    return b"P%d\n%d %d\n255\n" % (5 if a.ndim == 2 else 6, a.shape[1], a.shape[0]) + a.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """PBM, PGM or PPM, plain (P1-P3) or binary (P4-P6), as an array of samples; comments are skipped. Bits: 1 is black, given as 0."""
    kind, pos, fields = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    want = 2 if kind in (b"P1", b"P4") else 3
    while len(fields) < want:
        while pos < len(data) and (data[pos : pos + 1].isspace() or data[pos : pos + 1] == b"#"):
            pos = data.find(b"\n", pos) if data[pos : pos + 1] == b"#" else pos + 1
            if pos < 0:
                raise ValueError("cut off Netpbm header")
        end = pos
        while data[end : end + 1].isdigit():
            end += 1
        if end == pos:
            raise ValueError("bad Netpbm header")
        fields.append(int(data[pos:end]))
        pos = end
    w, h, most = fields[0], fields[1], fields[2] if want == 3 else 1
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * depth
    if not 1 <= most <= 65535:
        raise ValueError("Netpbm maximum out of range")
    if n > 8 * len(data):
        raise ValueError("cut off Netpbm samples")
    if kind in (b"P1", b"P2", b"P3"):
        body = b"\n".join(line.split(b"#")[0] for line in data[pos:].split(b"\n"))
        digits = [x - 48 for x in body if x in b"01"] if kind == b"P1" else body.split()
        samples = [int(x) for x in digits[:n]]
        if samples and not 0 <= min(samples) <= max(samples) <= most:
            raise ValueError("Netpbm sample out of range")
        a = np.array(samples, np.uint16 if most > 255 else np.uint8)
    elif kind == b"P4":
        stride = (w + 7) // 8
        raw = np.frombuffer(data, np.uint8, stride * h, pos + 1).reshape(h, stride)
        a = np.unpackbits(raw, axis=1)[:, :w].ravel()
    else:
        a = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, pos + 1)
    if a.size != n:
        raise ValueError("cut off Netpbm samples")
    if want == 2:
        a = (1 - a) * 255
    return a.reshape((h, w, 3) if depth == 3 else (h, w)).astype(np.uint16 if most > 255 else np.uint8, copy=False)


def encode_bmp(a: np.ndarray) -> bytes:
    """A uint8 array as BMP: 8 bits with a grey palette, or 24 bits for (rows, columns, 3)."""
    h, w = a.shape[:2]
    bits, palette = (24, b"") if a.ndim == 3 else (8, b"".join(bytes((i, i, i, 0)) for i in range(256)))
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * bits // 8] = (a[..., ::-1] if a.ndim == 3 else a).reshape(h, -1)
    at = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, rows.size, 2835, 2835, len(palette) // 4, 0)
    return head + info + palette + rows[::-1].tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits, bottom-up or top-down; grey palettes give two dimensions."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    at, size = struct.unpack_from("<II", data, 10)
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packed}")
    down, h = h < 0, abs(h)
    stride = (w * bits // 8 + 3) // 4 * 4
    if w < 0 or at + stride * h > len(data):
        raise ValueError("cut off BMP samples")
    rows = np.frombuffer(data, np.uint8, stride * h, at).reshape(h, stride)
    rows = rows if down else rows[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        if 14 + size + 4 * used > len(data):
            raise ValueError("cut off BMP palette")
        table = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(used, 4)[:, 2::-1]
        out = table[rows[:, :w]]
        return np.ascontiguousarray(out[..., 0]) if (table == table[:, :1]).all() else out
    step = bits // 8
    return rows[:, : w * step].reshape(h, w, step)[..., 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def decoded(data: bytes) -> tuple[np.ndarray | None, str | None]:
    """The samples, or what is wrong with the image."""
    try:
        return decode(data), None
    except (ValueError, IndexError, OverflowError, struct.error) as e:
        return None, str(e) or type(e).__name__


def integral_lines(a: np.ndarray, wanted: np.ndarray, band: int = 1 << 20) -> np.ndarray:
    """Lines of the image's integral (sums of all samples above and to the left) at the wanted rows, ascending.

    Samples are summed in bands of about ``band``, so an image of any size takes that much and the lines. Colours are
    averaged to grey.
    """
    h, w = a.shape[:2]
    out, carry, step = np.zeros((wanted.size, w + 1)), np.zeros((1, w)), max(1, band // max(w, 1))
    for top in range(0, h, step):
        part = a[top : top + step]
        grey = part.astype(np.float64).mean(axis=2) if a.ndim == 3 else part
        sums = np.cumsum(np.concatenate([carry, grey]), axis=0, dtype=np.float64)
        mine = np.flatnonzero((wanted > top) & (wanted <= top + len(part)))
        out[mine, 1:] = np.cumsum(sums[wanted[mine] - top], axis=1)
        carry = sums[-1:]
    return out


def area_resize(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean over each target cell's exact area, by an integral image read at fractional corners. Colours are averaged to grey first."""
    h, w = a.shape[:2]
    if not h or not w:
        return np.zeros((rows, cols))

    def at(n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(n + 1) * (most / n)
        low = np.minimum(x.astype(np.int64), most - 1)
        return low, x - low

    (y, fy), (x, fx) = at(rows, h), at(cols, w)
    wanted = np.unique(np.concatenate([y, y + 1]))
    sums = integral_lines(a, wanted)
    line = sums[np.searchsorted(wanted, y)] * (1 - fy)[:, None] + sums[np.searchsorted(wanted, y + 1)] * fy[:, None]
    corner = line[:, x] * (1 - fx) + line[:, x + 1] * fx
    cells = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return cells * (rows * cols / (h * w))


def difference_hash(a: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each of 8 by 9 cells is darker than its right neighbour."""
    cells = np.round(area_resize(a, 8, 9), 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def media_features(df: DataFrame, column: str = "media", tile: int = 16) -> DataFrame:
    """df with media_bytes, media_sha256, feature (difference hash), tile_npy (tile x tile grey samples as NPY) and error.

    Columns of df by these names are replaced; null media gives nulls. A malformed image has its bytes counted and
    hashed, null features and the reason in error, and doesn't stop the others.
    """
    made = ["media_bytes", "media_sha256", "feature", "tile_npy", "error"]
    new = "media_bytes long, media_sha256 string, feature string, tile_npy binary, error string"
    keep = [c for c in df.columns if c not in made]
    base = df.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, column):
            rows = []
            for data in b.column(column).to_pylist():
                if data is None:
                    rows.append((None,) * 5)
                    continue
                own = len(data), hashlib.sha256(data).hexdigest()
                a, error = decoded(data)
                if a is None:
                    rows.append((*own, None, None, error))
                    continue
                small = np.clip(np.rint(area_resize(a, tile, tile)), 0, 255).astype(np.uint8)
                rows.append((*own, difference_hash(a), npy(small), None))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [*keep, *made]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{fields}, {new}")


def _padded(data: bytes) -> np.ndarray:
    size = max(WIDTH, -(-len(data) // WIDTH) * WIDTH)
    out = np.zeros(size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(-1, WIDTH)


def store_texts(docs: DataFrame, kind: str = "pgm") -> DataFrame:
    """doc_id, n_bytes, media: every text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a grey image 64 samples wide.

    Null texts count as empty. The images are written to the shared folder and the written table is returned.
    """
    encode = {"pgm": encode_netpbm, "bmp": encode_bmp}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            raw, offs = buffers(b.column("text"))
            media = [encode(_padded(raw[i:j].tobytes())) for i, j in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(offs)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, media binary"
    )
    return materialize(made, "media")


def text_media(docs: DataFrame, kind: str = "pgm") -> DataFrame:
    """Store every whole text of docs as an image, read the stored bytes back and return their digests and features.

    Null texts count as empty; rows repeat as they do in docs; an empty table gives an empty one.
    """
    stored = store_texts(docs, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "media"):
            rows = []
            for data in b.column("media").to_pylist():
                payload = decode(data).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:])))
            n, sha, tail = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(n, pa.int64()), pa.array(sha), pa.array(tail, pa.int64())],
                ["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32"],
            )

    back = stored.mapInArrow(
        run, "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long"
    )
    return media_features(back).drop("media", "error")
