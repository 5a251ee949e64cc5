"""Centroid clustering of whole-number vectors: float32 screening with rigorous rounding-error intervals, then exact integers.

A fast float32 matrix product gives every (vector, centroid) distance up to a proven bound. A centroid whose interval
lies wholly above another's is out; where more than one is left, these are computed again in exact integers and the
smaller number wins a tie. So results are those of exact arithmetic, whatever the order of sums or the machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, scratch

#: Rows of a matrix product; bounds a task's memory.
BLOCK = 8192
#: Components up to this size have distances that 64-bit integers hold; vectors beyond it are computed with Python's integers.
SMALL = 1 << 26
LARGEST = (1 << 63) - 1
#: Sums of components are shipped as two decimals, of this base.
BASE = 10**25


def quantized(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """Which rows are kept (``dim`` components, none null or non-finite), their floor(scale * x), and rows with large ones apart.

    The second is an int64 array over kept rows; rows of the third (by kept number) are zero there.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == dim)
    values = column.take(pa.array(at)).flatten()
    holes = np.asarray(values.is_null()).reshape(-1, dim)
    x = np.asarray(values.fill_null(0).cast(pa.float64())).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & ~holes.any(axis=1)
    x, at = x[good], at[good]
    with np.errstate(over="ignore"):
        big = np.flatnonzero((np.abs(x) * scale > SMALL).any(axis=1))
    apart = {int(i): [_floor(v, scale) for v in x[i].tolist()] for i in big}
    x[big] = 0
    return at, np.floor(x * scale).astype(np.int64), apart


def _floor(x: float, scale: int) -> int:
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each int64 vector's nearest centroid; components within SMALL."""
    v32, c32 = vectors.astype(np.float32), centroids.astype(np.float32)
    dot = (v32 @ c32.T).astype(np.float64)
    c2 = (centroids * centroids).sum(axis=1)
    # Rounding of both factors, of products and of d - 1 additions in any order: at most gamma * sum |x_i c_i|, which
    # Cauchy bounds by the product of norms; the last factor covers the float64 steps here.
    n = vectors.shape[1] + 3
    gamma = n * 2.0**-24 / (1 - n * 2.0**-24)
    v2 = (vectors * vectors).sum(axis=1)
    norms = np.sqrt(v2.astype(np.float64))[:, None] * np.sqrt(c2.astype(np.float64))[None, :]
    estimate = c2[None, :].astype(np.float64) - 2 * dot
    slack = 2 * gamma * norms * (1 + 1e-9) + (np.abs(estimate) + c2[None, :] + 2 * np.abs(dot)) * 2.0**-50 + 1e-30
    lower, upper = estimate - slack, estimate + slack
    open_ = lower <= upper.min(axis=1, keepdims=True)
    best = open_.argmax(axis=1)
    left = np.flatnonzero(open_.sum(axis=1) > 1)
    if left.size:
        row, number = np.nonzero(open_[left])
        exact = ((vectors[left[row]] - centroids[number]) ** 2).sum(axis=1)
        order = np.lexsort((number, exact, row))
        first = np.unique(row[order], return_index=True)[1]
        best[left] = number[order][first]
    return best, ((vectors - centroids[best]) ** 2).sum(axis=1)


def _nearest_large(vector: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    distance, number = min((sum((a - b) ** 2 for a, b in zip(vector, c, strict=True)), j) for j, c in enumerate(centroids))
    return number, distance


def _assigned(batch: pa.RecordBatch, centroids: list[list[int]], dim: int, scale: int) -> Iterator[tuple]:
    """Blocks of a batch: kept rows, their integers, those apart, cluster and squared distance (of Python's integers where large)."""
    small = all(abs(x) <= SMALL for c in centroids for x in c)
    known = np.array(centroids, np.int64) if small else None
    for start in range(0, batch.num_rows, BLOCK):
        at, ints, apart = quantized(batch.column("vector").slice(start, BLOCK), dim, scale)
        if not small:
            apart = {i: apart.get(i) or ints[i].tolist() for i in range(len(ints))}
            best, distance = np.zeros(len(ints), np.int64), np.zeros(len(ints), np.int64)
        else:
            best, distance = nearest(ints, known) if len(ints) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for i, v in apart.items():
            best[i], far = _nearest_large(v, centroids)
            distance[i] = min(far, LARGEST)
        yield at + start, ints, apart, best, distance


def _moved(vectors: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> list[list[int]]:
    """Each centroid's vectors' floor(sum / count) by component; a centroid without vectors stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(centroids), [[0] * dim for _ in centroids]
        for b in batches:
            for _, ints, apart, best, _ in _assigned(b, centroids, dim, scale):
                for j in np.unique(best):
                    mine = best == j
                    mine[list(apart)] = False
                    counts[j] += int(mine.sum())
                    sums[j] = [s + int(x) for s, x in zip(sums[j], ints[mine].sum(axis=0), strict=True)]
                for i, v in apart.items():
                    counts[best[i]] += 1
                    sums[best[i]] = [s + x for s, x in zip(sums[best[i]], v, strict=True)]
        rows = [(j, i, counts[j], *divmod(sums[j][i], BASE)) for j in range(len(centroids)) if counts[j] for i in range(dim)]
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38), pa.decimal128(38)]
            cols[3:] = [[Decimal(x) for x in c] for c in cols[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["cluster", "place", "n", "high", "low"])

    parts = vectors.mapInArrow(run, "cluster int, place int, n long, high decimal(38,0), low decimal(38,0)")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        out[r["cluster"]][r["place"]] = (int(r["high"]) * BASE + int(r["low"])) // r["n"]  # as many rows as there are centroids and components
    return out


def _start(vectors: DataFrame, k: int, dim: int, scale: int) -> list[list[int]]:
    """The k kept vectors with the least SHA-256 of ``1:<vec_id>``; equal ids by their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                at, ints, apart = quantized(b.column("vector").slice(start, BLOCK), dim, scale)
                ids = b.column("vec_id").slice(start, BLOCK).take(pa.array(at)).to_pylist()
                keyed = [(hashlib.sha256(f"1:{v}".encode()).hexdigest(), i) for i, v in enumerate(ids) if v is not None]
                best = sorted(best + [(h, apart.get(i) or ints[i].tolist()) for h, i in keyed])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([",".join(map(str, v)) for _, v in best], pa.string())], ["hash", "vector"])

    firsts = vectors.mapInArrow(run, "hash string, vector string").orderBy("hash", "vector").limit(k).collect()
    return [list(map(int, r["vector"].split(","))) for r in firsts]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for vectors (vec_id, embedding).

    Kept are vectors of exactly ``dim`` components, none null or non-finite; each becomes floor(scale * x). Centroids
    start as the k kept vectors with the least hash of their id (fewer vectors: fewer centroids; equal ids: by components
    as text), move ``rounds`` times to floor(sum / count), and vectors are assigned once more. Distances are squared
    Euclidean, ties go to the smaller number. Vectors of a null vec_id are clustered but start no centroid; without any
    kept id there are no rows. Repeated rows count each. Distances and inertias beyond 2**63 - 1 are told as that, but
    are compared exactly. The driver holds k * dim sums a round and nothing else.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"))
    schema = "vec_id long, cluster int, distance long"
    centroids = _start(rows, k, dim, scale)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(rows.select("vector"), centroids, dim, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if centroids else ():
            for at, _, _, best, distance in _assigned(b, centroids, dim, scale):
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)).cast(pa.int64()), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    with scratch() as keep:
        told = materialize(rows.mapInArrow(run, schema), "assigned")
        keep.append(told)
    exact = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("total")).collect()  # one row a centroid
    whole = min(sum(int(r["total"]) for r in exact), LARGEST)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(r["cluster"], min(int(r["total"]), LARGEST), whole, digests[r["cluster"]]) for r in exact]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
