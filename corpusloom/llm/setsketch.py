"""Near-duplicate links by SetSketch registers.

Register i of a set is the truncated logarithm, in steps of a base near 1, of the least exponential value its elements
draw in lane i. Registers merge by maximum and agree about as often as two sets overlap, so bands of them are keys for
candidates. A candidate pair is first judged by a likelihood over the counts of smaller, equal and larger registers,
then confirmed on the full shingle sets.

Texts with equal sets form one class. The classes of a small bucket are all compared. In a larger one every class is
compared with one hub, the class that shares most buckets; classes that larger buckets connect, directly or not, are one
group, so each class is in one group only. Its classes that are still in different components are then compared in
blocks (see _across), so that no link between components is lost. Rows grow with a group's members times its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import buffers, materialize, pieces, scratch
from corpusloom.llm.components import components
from corpusloom.llm.hashing import mix, shingles

#: 32 bands of 4 registers miss a pair of similarity 0.8 with probability 5e-8.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Register value: floor(1 - log(x) / log(BASE)), kept within 0 and LIMIT + 1; x is exponential with rate RATE.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: A pair is verified unless its likelihood estimate lies so far under the threshold (over six standard errors).
SLACK = 0.22
#: The classes of buckets of up to so many are all compared.
ALL_PAIRS = 8
#: Members of a block on average, and their shingles, at most; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 19
#: Bytes of text that are hashed at once; a task's arrays take some fifty times as much.
PIECE = 1 << 19
#: Pairs of a block's members whose differences in common are counted at once, and how many of these.
CELLS = 1 << 18
#: Pairs whose likelihoods are computed at once; bounds a task's memory.
GRID_PAIRS = 1024

_LANES = np.random.default_rng(7).integers(0, 1 << 64, (2, REGISTERS), dtype=np.uint64)
_LANES[0] |= np.uint64(1)


def registers(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(n, REGISTERS) uint16 registers of the sets values[offs[i]:offs[i+1]]; an empty set has zeros."""
    full = np.flatnonzero(np.diff(offs) > 0)
    out = np.zeros((offs.size - 1, REGISTERS), np.uint16)
    if not full.size:
        return out
    for i in range(REGISTERS):
        least = np.minimum.reduceat(values * _LANES[0, i] + _LANES[1, i], offs[full])
        u = (least >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        x = -np.log1p(-u) / RATE
        out[full, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of register rows, given the sets' sizes.

    With relative sizes u and v of the sets (u + v = 1), register a is larger with probability p(u - v*J), smaller with
    p(v - u*J) and else equal, where p(x) = -log(1 - x*(BASE-1)/BASE) / log(BASE); J is found on a grid.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less
    u = n_a / np.maximum(n_a + n_b, 1)
    grid = np.linspace(0, 1, 201)
    j = np.minimum(grid, np.minimum(u / (1 - u), (1 - u) / u)[:, None])

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)

    up, down = p(u[:, None] - (1 - u)[:, None] * j), p((1 - u)[:, None] - u[:, None] * j)
    equal = np.clip(1 - up - down, 1e-9, 1)
    score = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(equal)
    return j[np.arange(j.shape[0]), score.argmax(axis=1)]


def set_keys(values: np.ndarray, offs: np.ndarray) -> list[bytes | None]:
    """16 bytes that name each set, None for an empty one."""
    n = np.diff(offs)
    sums = np.zeros((2, values.size + 1), np.uint64)
    np.cumsum(values, out=sums[0, 1:])
    np.cumsum(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1, 1:])
    key = mix(sums[:, offs[1:]] - sums[:, offs[:-1]] + n.astype(np.uint64))
    return [k.tobytes() if m else None for k, m in zip(np.ascontiguousarray(key.T), n, strict=True)]


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, mark (the text's hash), n_shingles, key, regs, bands for every row; key names the set, null without words."""
    rows = _rows(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            values, offs = shingles(*buffers(b.column("text")), size)
            n, keys, regs = np.diff(offs), set_keys(values, offs), registers(values, offs)
            bands = np.zeros((n.size, BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix(bands * np.uint64(0x100000001B3) + regs[:, r::ROWS].astype(np.uint64) + np.uint64(r))
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("mark"), pa.array(n), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(n.size + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel())),
                ],
                ["doc_id", "mark", "n_shingles", "key", "regs", "bands"],
            )

    return rows.mapInArrow(run, "doc_id long, mark long, n_shingles long, key binary, regs binary, bands array<long>")


def _likely(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, n_a, n_b, regs_a, regs_b) that the likelihood doesn't rule out, as a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The grid has 201 values a pair, several times over: few pairs at a time.
        for b in (whole.slice(i, GRID_PAIRS) for whole in batches for i in range(0, whole.num_rows, GRID_PAIRS)):
            a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("regs_a", "regs_b"))
            j = estimate(a, c, b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(j >= threshold - SLACK))

    return pairs.mapInArrow(run, "a binary, b binary")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, each as two rows of hashes, are similar enough."""
    x, y = (x, y) if x.size <= y.size else (y, x)
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    both = int((y[:, at] == x).all(axis=0).sum())
    return 100 * both >= percent * (len(x[0]) + len(y[0]) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union; shingles are compared by 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "set_a"):
            good = []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
                x, y = (np.frombuffer(v, np.uint64).reshape(2, -1) for v in (x, y))
                good.append(_linked(x, y, percent))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    a = sets.select(F.col("key").alias("a"), F.concat("set", "again").alias("set_a"))
    b = sets.select(F.col("key").alias("b"), F.concat("set", "again").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """key, n, set, again of the wanted classes (key, doc_id, mark), made anew from that document's whole text.

    set is packed as a 64-bit hash a shingle, in order, and again as a second hash of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            *values, offs = shingles(*buffers(b.column("text")), size, 2)
            packed = [pa.array([v[i:j].tobytes() for i, j in zip(offs[:-1], offs[1:], strict=True)], pa.binary()) for v in values]
            own = [k == m for k, m in zip(b.column("key").to_pylist(), set_keys(values[0], offs), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.diff(offs)), *packed], ["key", "n", "set", "again"]).filter(pa.array(own, pa.bool_()))

    w = wanted.select("key", F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark"))
    mine = _rows(docs).join(w, (F.col("mark") == F.col("w_mark")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    return mine.select("key", "text").dropDuplicates().mapInArrow(run, "key binary, n long, set binary, again binary")


def _joined(whole: pa.Table, percent: int) -> pa.Table:
    """Links a, b, one for every two components of the rows (block, key, root, set, again) that meet; two blocks are compared with each other, one with itself.

    What two sets share is counted from their differences: with m shingles that more than half of the rows have, of
    which i and j lack some, and k differences (own or lacking) in common, they share m - lacks_i - lacks_j + k.
    """
    keys, block = whole.column("key").to_pylist(), whole.column("block").to_numpy()
    one, two = ([np.frombuffer(v, np.uint64) for v in whole.column(c).to_pylist()] for c in ("set", "again"))
    comp = whole.column("root").combine_chunks().dictionary_encode().indices.to_numpy().copy()
    n = np.array([v.size for v in one])
    member = np.repeat(np.arange(n.size), n)
    ids = np.unique(np.concatenate(one), return_inverse=True)[1]
    often = np.bincount(ids)
    usual = 2 * often > n.size
    lacking = np.ones((n.size, int(usual.sum())), bool)  # fewer than two cells a shingle, as each of these is in half of the sets
    has = usual[ids]
    lacking[member[has], (np.cumsum(usual) - 1)[ids[has]]] = False
    lacks = lacking.sum(axis=1)
    own = ~has & (often[ids] > 1)
    row, col = np.nonzero(lacking)
    who, what = np.concatenate([member[own], row]), np.concatenate([ids[own], np.flatnonzero(usual)[col]])
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    place = np.full(n.size, -1)
    place[right] = np.arange(right.size)
    listed = np.flatnonzero(place[who] >= 0)
    listed = listed[np.argsort(what[listed], kind="stable")]
    at = np.searchsorted(what[listed], np.arange(often.size + 1))  # where each difference's members stand
    listed = place[who[listed]]
    place[:] = -1
    place[left] = np.arange(left.size)
    mine = np.flatnonzero(place[who] >= 0)
    mine = mine[np.argsort(place[who[mine]], kind="stable")]
    who, what = place[who[mine]], what[mine]
    count = at[what + 1] - at[what]
    begins = np.searchsorted(who, np.arange(left.size + 1))
    cost = np.concatenate([[0], np.cumsum(count)])[begins]
    out: list[tuple[bytes, bytes]] = []
    start = 0
    while start < left.size:
        stop = min(int(np.searchsorted(cost, cost[start] + CELLS, "right")) - 1, start + CELLS // right.size, left.size)
        stop = max(stop, start + 1)
        here = slice(begins[start], begins[stop])
        c = count[here]
        met = listed[np.repeat(at[what[here]] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        common = np.bincount(np.repeat(who[here] - start, c) * right.size + met, minlength=(stop - start) * right.size)
        some = left[start:stop]
        both = common.reshape(-1, right.size) + int(usual.sum()) - lacks[some][:, None] - lacks[right]
        near = (100 * both >= percent * (n[some][:, None] + n[right] - both)) & (comp[some][:, None] != comp[right])
        for k in np.flatnonzero(near.any(axis=1)):
            i, others = some[k], right[near[k]]
            while (others := others[comp[others] != comp[i]]).size:
                j, others = others[0], others[1:]
                if _linked(np.stack([one[i], two[i]]), np.stack([one[j], two[j]]), percent):
                    out.append((keys[i], keys[j]))
                    comp[comp == comp[j]] = comp[i]
        start = stop
    return pa.table([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["a", "b"])


def _across(groups: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Links a, b of a group's members (gid, key), confirmed on their sets, that join all of its components that a link can join.

    Every two members of different components are compared, in blocks of bounded size: a task holds two blocks. In a
    group of several blocks the members of its largest component are only compared with the others. From two blocks
    come fewer links than they have members.
    """
    sized = sets.select("key", "n")
    rooted = groups.join(label.withColumnRenamed("node", "key"), "key", "left").join(sized, "key").withColumn("root", F.coalesce("root", "key"))
    parts = rooted.groupBy("gid", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    most = F.max(F.struct("c", "root", "n"))
    mixed = parts.groupBy("gid").agg(F.count(F.lit(1)).alias("roots"), F.sum("c").alias("c"), F.sum("n").alias("n"), most.alias("most")).where("roots > 1")

    def blocks(c: Column, n: Column) -> Column:
        return F.ceil(F.greatest(c / BLOCK, n / BLOCK_SHINGLES))

    alone = blocks(F.col("c"), F.col("n")) == 1
    rest = blocks(F.col("c") - F.col("most.c"), F.col("n") - F.col("most.n"))
    mixed = mixed.select(
        "gid", F.when(~alone, F.col("most.root")).alias("main"), F.when(alone, 1).otherwise(rest).alias("rest"),
        F.when(alone, 0).otherwise(blocks(F.col("most.c"), F.col("most.n"))).alias("more"),
    )
    live = materialize(rooted.join(mixed, "gid"), "live")
    main, salt = F.coalesce(F.col("root") == F.col("main"), F.lit(False)), F.xxhash64("key")
    block = F.when(main, F.col("rest") + F.pmod(salt, F.col("more"))).otherwise(F.pmod(salt, F.col("rest")))
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest") + F.when(main, 0).otherwise(F.col("more")) - 1))
    dealt = live.select("gid", "key", "root", block.alias("block"), meets.alias("meets"))
    dealt = dealt.join(sets.drop("n"), "key").withColumns({"i": F.least("block", "meets"), "j": F.greatest("block", "meets")}).drop("meets")
    return dealt.groupBy("gid", "i", "j").applyInArrow(lambda whole: _joined(whole, percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents are linked when their sets of distinct word shingles (words lower-cased in A-Z, split at ASCII white
    space; fewer words than ``size``: all as one) have 100 * intersection >= percent * union; component_id is the
    smallest doc_id reachable. Null, empty and blank texts have no shingles and no links. Repeated rows are linked by
    their texts; a row with a null doc_id gets the component of its text, and is kept only where no row of it has an
    id. An empty table gives no rows.
    """
    with scratch() as keep:
        keep.append(out := materialize(_classes(docs, size, percent), "components"))
    return out


def _classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    sketched = materialize(sketch(docs, size), "sketches")
    # Equal sets have equal registers and bands, so any row of a class gives these.
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("rep")
    alike = [F.first(c).alias(c) for c in ("n_shingles", "regs", "bands")]
    reps = sketched.where("key is not null").groupBy("key").agg(rep, *alike)
    reps = materialize(reps.select("key", "rep.doc_id", "rep.mark", "n_shingles", "regs", "bands"), "reps")
    buckets = reps.select("key", F.explode("bands").alias("bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = materialize(buckets.join(crowded, "bucket"), "buckets")
    few, many = shared.where(F.col("c") <= ALL_PAIRS), shared.where(F.col("c") > ALL_PAIRS)
    met = few.alias("x").join(few.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.key") < F.col("y.key")))
    met = met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    fame = many.groupBy("key").agg(F.sum("c").alias("fame"))
    famed = many.join(fame, "key")
    hubs = famed.groupBy("bucket").agg(F.max(F.struct("fame", "key"))["key"].alias("hub"))
    members = materialize(many.join(hubs, "bucket").select("hub", "key").distinct(), "members")
    star = members.where("key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b"))
    regs = reps.select("key", "n_shingles", "regs")
    left = regs.select(F.col("key").alias("a"), F.col("n_shingles").alias("n_a"), F.col("regs").alias("regs_a"))
    right = regs.select(F.col("key").alias("b"), F.col("n_shingles").alias("n_b"), F.col("regs").alias("regs_b"))
    fits = (F.lit(100) * F.least("n_a", "n_b")) >= (F.lit(percent) * F.greatest("n_a", "n_b"))
    pairs = met.unionByName(star).distinct().join(left, "a").join(right, "b").where(fits)
    near = materialize(_likely(pairs, percent / 100), "likely")
    wanted = near.select(F.col("a").alias("key")).unionByName(near.select(F.col("b").alias("key"))).unionByName(members.select("key"))
    sets = materialize(_sets(docs, reps.select("key", "doc_id", "mark").join(wanted, "key", "left_semi"), size), "sets")
    label = components(materialize(_confirmed(near, sets, percent), "links"))
    groups = components(star).select(F.col("root").alias("gid"), F.col("node").alias("key"))
    links = materialize(_across(groups, sets, label, percent), "across")
    # Components so far are stars already, so that only what joins them takes rounds.
    roots = label if links.isEmpty() else components(label.toDF("a", "b").unionByName(links))
    ids = reps.select("key", F.col("doc_id").alias("rep")).join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = ids.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = ids.join(lowest, "root").select("key", "component_id")
    out = sketched.select("doc_id", "n_shingles", "key").join(final, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
