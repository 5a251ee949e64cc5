"""Suffix-array deduplication by bucket-pointer refinement over sampled suffixes.

1. Sampling: every window of the repeat length chooses one suffix, its least q-gram by a hash, about one suffix in
   seventeen. Equal windows choose the same suffix at the same offset, so this loses nothing. Suffixes whose q-gram
   occurs in one document only are settled and leave.
2. Equal surroundings: the windows that chose one suffix form its context. Of equal contexts only the least document's
   goes on; all windows of the others are settled.
3. Bucket-pointer refinement, only where a q-gram still has several contexts: these are dealt by q-gram, and a task
   orders all their suffixes. First buckets hold suffixes with the same eight bytes; each suffix points to the first
   slot of its bucket. A bucket is refined by sorting its suffixes on the bucket pointers of the suffixes ``reach``
   bytes later; the pointers so updated are what the next pass sorts on, so reach doubles until it is the repeat length.
   Buckets of one suffix are settled. Windows in one bucket at the end are equal, and the least document keeps them.

Hashes choose suffixes and deal them; which windows are equal in a bucket is decided by their bytes. Every step deals
its rows once, sorted, and streams through them; very long texts are taken in overlapping stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import buffers, discard, materialize, partitions, pieces
from corpusloom.llm.hashing import mix, prefix, stretches

_U = np.uint64
#: Bytes of the q-gram that a suffix is chosen and dealt by; at most half the repeat length is used.
GRAM = 20
#: Bytes of a first bucket, as one number.
FIRST = 8
#: Bytes of a text that are looked at together, and bytes of contexts that are refined together (one q-gram's at least).
STRETCH, REFINED = 4 << 20, 2 << 20


class Anchors:
    """Sampled suffixes of a batch of texts: at; first window lo, number of windows runs, q-gram's hash route, for each."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, length: int):
        self.length = length
        self.sums, self.inverse = prefix(raw)
        q, n = max(1, min(GRAM, length // 2)), raw.size - length + 1
        self.runs = self.lo = self.at = np.zeros(0, np.int64)
        self.route = np.zeros(0, _U)
        if n <= 0:
            return
        at = np.arange(raw.size - q + 1)
        first = stretches(self.sums, self.inverse, at, at + q)
        # The least q-gram of a window, the leftmost of equals: the high half of the hash, then the place.
        least = (first & _U(0xFFFFFFFF00000000)) | at.astype(_U)
        span, width = 1, length - q + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: span - width], least[width - span :])
        chosen = (least & _U(0xFFFFFFFF)).astype(np.int64)
        ends = np.repeat(offs[1:], np.diff(offs))
        start = np.flatnonzero(np.arange(n) + length <= ends[:n])
        chosen = chosen[start]
        new = np.ones(start.size, bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
        begin = np.flatnonzero(new)
        self.at = chosen[begin]
        self.lo = start[begin]
        self.runs = np.diff(np.append(begin, start.size))
        self.route = first[self.at]

    def contexts(self) -> np.ndarray:
        """A hash of all that an anchor's windows cover, and where in it the anchor is."""
        end = self.lo + self.runs - 1 + self.length
        whole = stretches(self.sums, self.inverse, self.lo, end)
        edge = stretches(self.sums, self.inverse, self.at, end) * _U(0x9E3779B97F4A7C15)
        return mix(whole ^ mix(edge + ((self.at - self.lo) * 65536 + self.runs).astype(_U)))


def refine(raw: np.ndarray, offs: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers of all suffixes of the texts raw[offs[i]:offs[i+1]], refined to ``length`` bytes.

    Suffixes with so many bytes left in their text have the same pointer exactly if these bytes are the same, and
    pointers are in the order of the bytes; the others have none (-1).
    """
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(raw.size)
    reach = min(FIRST, length)
    code = np.zeros(max(raw.size - reach + 1, 0), _U)
    for k in range(reach):
        code |= raw[k : k + code.size].astype(_U) << _U(8 * (reach - 1 - k))
    pointer = np.full(raw.size, -1, np.int64)

    def assign(place: np.ndarray, new: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Point the suffixes, in order, to the first slot of their buckets; returns those that share one."""
        slot = np.maximum.accumulate(np.where(new, base, 0))
        pointer[place] = slot
        alone = new & np.append(new[1:], True)
        return place[~alone]

    active = np.flatnonzero(left >= reach)
    active = active[np.argsort(code[active])]
    new = np.ones(active.size, bool)
    new[1:] = code[active[1:]] != code[active[:-1]]
    active = assign(active, new, np.arange(active.size))
    while reach < length:
        step = min(reach, length - reach)
        active = active[left[active] >= reach + step]  # shorter ones stay as they are: no later pass reads them
        active = active[np.argsort(pointer[active] << 32 | pointer[active + step])]  # a batch has under 2**31 suffixes
        own, later = pointer[active], pointer[active + step]
        bucket, new = np.ones(active.size, bool), np.ones(active.size, bool)
        bucket[1:] = own[1:] != own[:-1]
        new[1:] = bucket[1:] | (later[1:] != later[:-1])
        # A bucket keeps its slots: parts of it follow each other from its first slot on.
        inside = np.arange(active.size) - np.maximum.accumulate(np.where(bucket, np.arange(active.size), 0))
        active = assign(active, new, own + inside)
        reach += step
    pointer[left < length] = -1
    return pointer


def _text_mark(text: str) -> Column:
    """Tells rows of one doc_id apart: half a hash of the text."""
    return F.shiftright(F.xxhash64(text), 32).cast("int")


def _place(mark: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A row's mark and an offset in its text (under 2**31) as one number."""
    return mark.astype(np.int64) << 32 | lo


def _mark_and_lo(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (place >> 32).astype(np.int32), (place & 0xFFFFFFFF).astype(np.int32)


def _extent(before: np.ndarray, n: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Of a context: bytes before the anchor, windows, and how often it follows itself (a text of one short period)."""
    return before << 48 | n << 32 | times


def _windows(extent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a context, and how often it follows itself."""
    return (extent >> 32) & 0xFFFF, extent & 0xFFFFFFFF


def _owner(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, at, "right") - 1


def _stretched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Slices of the batches, their bytes and offsets, and where these begin in the text: 0 but in a text longer than STRETCH."""
    for b in pieces(batches, "text", 1 << 20):
        raw, offs = buffers(b.column("text"))
        if raw.size <= STRETCH:
            yield b, raw, offs, 0
            continue
        for base in range(0, raw.size, STRETCH):
            part = raw[base : base + STRETCH + length - 1]
            yield b, part, np.array([0, part.size]), base


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    """route, doc, tag: the q-grams of anchors, once a document and piece.

    tag 1: other documents of the piece have it too; 2 and more: so it is, and the row needn't meet others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs, _ in _stretched(batches, length):
            found = Anchors(raw, offs, length)
            if not found.at.size:
                continue
            doc, route = b.column("doc").to_numpy()[_owner(offs, found.lo)], found.route
            order = np.lexsort((doc, route))
            doc, route = doc[order], route[order]
            head, once = np.ones(route.size, bool), np.ones(route.size, bool)
            head[1:] = route[1:] != route[:-1]
            once[1:] = head[1:] | (doc[1:] != doc[:-1])
            doc, route, head = doc[once], route[once], head[once]
            group, begin = np.cumsum(head) - 1, np.flatnonzero(head)
            many = np.diff(np.append(begin, route.size))[group] > 1
            tag = np.where(many, np.where(head, 1, 2 + np.arange(route.size)), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(doc), pa.array(tag)], ["route", "doc", "tag"])

    return rows.mapInArrow(run, "route long, doc long, tag int")


def _shared(anchors: DataFrame) -> DataFrame:
    """doc, route of the q-grams that several documents have, from rows dealt and sorted by route and document; groups stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, doc, several = None, None, False  # the last route, its last document, and whether it is known as shared

        def out(doc: np.ndarray, route: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(route)], ["doc", "route"])

        for b in batches:
            if not b.num_rows:
                continue
            r, d, known = (b.column(k).to_numpy() for k in ("route", "doc", "tag"))
            head = np.ones(r.size, bool)
            head[1:] = r[1:] != r[:-1]
            begin, group = np.flatnonzero(head), np.cumsum(head) - 1
            many = (np.maximum.reduceat(d, begin) != d[begin]) | (np.maximum.reduceat(known, begin) > 0)
            if route is not None and r[0] == route:
                many[0] |= several or doc != d[0]
                if many[0] and not several:
                    yield out(np.array([doc]), np.array([route]))
            once = many[group]
            once[1:] &= head[1:] | (d[1:] != d[:-1])
            if once.any():
                yield out(d[once], r[once])
            route, doc, several = r[-1], d[-1], bool(many[-1])

    return anchors.mapInArrow(run, "doc long, route long")


def _flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and values of a list column, flat."""
    lists = b.column(name)
    sizes = np.diff(lists.offsets.to_numpy())
    if lists.null_count:
        sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    return np.repeat(np.arange(b.num_rows), sizes), lists.flatten()


def _heads(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys and document, and which rows of it have a larger document than the first with their keys."""
    order = np.lexsort((doc, *keys[::-1]))
    new = np.ones(order.size, bool)
    for k in keys:
        new[1:] &= k[order][1:] == k[order][:-1]
    new[1:] = ~new[1:]
    new[:1] = True
    first = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1] if order.size else doc
    return order, doc[order] > first


def _pair(row: np.ndarray, route: np.ndarray) -> np.ndarray:
    return mix(route + row.astype(_U) * _U(0x9E3779B97F4A7C15))


def _contexts(rows: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """route, context, doc, place, extent: the contexts of the shared anchors; settled where a smaller document of the piece has the context.

    place holds the row's mark and the first window, extent see _extent. Settled ones needn't meet others.
    """
    lists = shared.groupBy("doc").agg(F.collect_set("route").alias("routes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs, base in _stretched(batches, length):
            found = Anchors(raw, offs, length)
            if not found.at.size:
                continue
            row, routes = _flat(b, "routes")
            owner = _owner(offs, found.lo)
            good = np.flatnonzero(np.isin(_pair(owner, found.route), _pair(row, routes.to_numpy().view(_U))))
            if not good.size:
                continue
            owner, route, context = owner[good], found.route[good], found.contexts()[good]
            lo, n, before = found.lo[good], found.runs[good], (found.at - found.lo)[good]
            # In a text of one short period a context follows itself: one row for all.
            new = np.ones(good.size, bool)
            new[1:] = (route[1:] != route[:-1]) | (context[1:] != context[:-1]) | (lo[1:] != lo[:-1] + n[:-1]) | (owner[1:] != owner[:-1])
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, good.size))
            owner, route, context, lo, n, before = (x[begin] for x in (owner, route, context, lo, n, before))
            doc, mark = b.column("doc").to_numpy()[owner], b.column("mark").to_numpy()[owner]
            order, settled = _heads([route, context], doc)
            route = route[order]
            route[settled] = mix(route[settled] + np.flatnonzero(settled).astype(_U))
            place = _place(mark, base + lo - offs[owner])[order]
            cols = (route.view(np.int64), context[order].view(np.int64), doc[order], place, _extent(before, n, times)[order])
            names = ["route", "context", "doc", "place", "extent", "settled"]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(settled)], names)

    return rows.join(lists, "doc").mapInArrow(run, "route long, context long, doc long, place long, extent long, settled boolean")


def _judged(contexts: DataFrame) -> DataFrame:
    """route, doc, mark, lo, extent, whole: contexts that a smaller document has too, and the first of each where a route has several.

    The rows come sorted by route, context and document; only the rows of a route's last context that lead it are
    held from batch to batch.
    """
    names = ["route", "context", "doc", "place", "extent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, several = [np.zeros(0, np.int64)] * 5, False  # leaders of the last context; several: they have gone out

        def out(cols: list[np.ndarray], pick: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
            route, _, doc, place, extent = (c[pick] for c in cols)
            out = (np.where(whole[pick], 0, route), doc, *_mark_and_lo(place), extent, whole[pick])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["route", "doc", "mark", "lo", "extent", "whole"])

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(c).to_numpy() for c in names]
            settled = b.column("settled").to_numpy(zero_copy_only=False)
            cols, old = [np.concatenate(x) for x in zip(held, new, strict=True)], held[0].size
            settled = np.concatenate([np.zeros(old, bool), settled])
            route, context, doc = cols[:3]
            next_route, head = np.ones(route.size, bool), np.ones(route.size, bool)
            next_route[1:] = route[1:] != route[:-1]
            head[1:] = next_route[1:] | (context[1:] != context[:-1])
            begin, in_route = np.flatnonzero(head), np.cumsum(next_route) - 1
            whole = (doc > doc[begin][np.cumsum(head) - 1]) | settled
            many = np.bincount(in_route, head)[in_route] > 1
            if old and several:
                many[in_route == 0] = True
            gone = np.zeros(route.size, bool)
            gone[:old] = several
            pick = ((whole | many) & ~gone) & ~(whole & (np.arange(route.size) < old))
            if pick.any():
                yield out(cols, pick, whole)
            lead = np.arange(route.size) >= begin[-1]
            lead &= ~whole
            several = bool(many[-1])
            held = [c[lead] for c in cols] if lead.any() else [np.zeros(0, np.int64)] * 5

    return contexts.mapInArrow(run, "route long, doc long, mark int, lo int, extent long, whole boolean")


def _open_contexts(rows: DataFrame, judged: DataFrame, length: int) -> DataFrame:
    """route, doc, place, extent, bytes of the contexts that are not settled."""
    lists = judged.where("not whole").groupBy("doc", "mark").agg(F.collect_list(F.struct("route", "lo", "extent")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            raw, offs = buffers(b.column("text"))
            row, runs = _flat(b, "runs")
            lo, extent = (runs.field(k).to_numpy().astype(np.int64) for k in ("lo", "extent"))
            size = _windows(extent)[0] - 1 + length
            ends = np.cumsum(size)
            take = np.repeat(lo + offs[row] - ends + size, size) + np.arange(size.sum())
            data = pa.Array.from_buffers(
                pa.binary(), size.size, [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[take]))]
            )
            place = _place(b.column("mark").to_numpy()[row], lo)
            cols = [runs.field("route"), pa.array(b.column("doc").to_numpy()[row]), pa.array(place), pa.array(extent), data]
            yield pa.RecordBatch.from_arrays(cols, ["route", "doc", "place", "extent", "bytes"])

    return rows.join(lists, ["doc", "mark"]).mapInArrow(run, "route long, doc long, place long, extent long, bytes binary")


def _later(contexts: DataFrame, length: int) -> DataFrame:
    """doc, mark, lo, hi: stretches of windows that a smaller document has; contexts come dealt and sorted by route."""

    def spans(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, offs = buffers(b.column("bytes"))
        doc, place = b.column("doc").to_numpy(), b.column("place").to_numpy()
        n, times = _windows(b.column("extent").to_numpy())
        pointer = refine(raw, offs, length)
        begin = np.cumsum(n) - n
        row = np.repeat(np.arange(n.size), n)
        j = np.arange(row.size) - begin[row]
        window = pointer[offs[:-1][row] + j]
        # Windows of one bucket that belong to one route are equal with the anchor at the same place.
        order, found = _heads([window], doc[row])
        later = np.zeros(row.size, bool)
        later[order] = found
        edge = np.zeros(row.size + 1, np.int8)
        edge[:-1] = later
        first = later & ((j == 0) | ~np.append(False, later[:-1]))
        last = later & ((j == n[row] - 1) | ~np.append(later[1:], False))
        lo, hi, of = j[first], j[last] + 1, row[first]
        # A whole context stands for all that follow it; of others each has its own part.
        all_of = (hi - lo == n[of]) & (times[of] > 1)
        again = np.where(all_of, 1, times[of])
        k = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
        lo, hi, of, all_of = (np.repeat(x, again) for x in (lo, hi, of, all_of))
        mark, start = _mark_and_lo(place[of])
        lo, hi = start + k * n[of] + lo, start + np.where(all_of, times[of] * n[of], k * n[of] + hi) - 1 + length
        return pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(mark), pa.array(lo), pa.array(hi)], ["doc", "mark", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size < REFINED:
                continue
            both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            route = both.column("route").to_numpy()
            cut = int(np.searchsorted(route, route[-1]))  # the last route may go on
            if cut:
                yield spans(both.slice(0, cut))
            held, size = [both.slice(cut)], 0
        if held:
            both = pa.Table.from_batches(held).combine_chunks().to_batches()
            if both:
                yield spans(both[0])

    return contexts.mapInArrow(run, "doc long, mark int, lo long, hi long")


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc, mark (see _text_mark), spans (array of struct lo, hi): byte stretches of a document that strings of ``length`` bytes cover which also start in a document with a smaller id.

    Spans may overlap. Documents without any are left out, and so are rows with a null id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).dropna()
    rows = rows.withColumn("mark", _text_mark("text"))
    n = partitions(spark)
    dealt = _anchors(rows.drop("mark"), length).repartition(n, "route", F.greatest("tag", F.lit(1))).sortWithinPartitions("route", "doc")
    shared = materialize(_shared(dealt), "anchors")
    judged = _judged(_contexts(rows, shared, length).repartition(n, "route").sortWithinPartitions("route", "context", "doc"))
    judged = materialize(judged, "contexts")
    discard(shared)
    dealt = _open_contexts(rows, judged, length).repartition(n, "route").sortWithinPartitions("route")
    single = materialize(_later(dealt, length), "windows")
    lo, n, times = F.col("lo").cast("long"), F.shiftright("extent", 32).bitwiseAND(F.lit(0xFFFF)), F.col("extent").bitwiseAND(F.lit(0xFFFFFFFF))
    whole = judged.where("whole").select("doc", "mark", lo.alias("lo"), (lo + n * times - 1 + length).alias("hi"))
    return whole.unionByName(single).groupBy("doc", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 50, carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """docs without the bytes that repeat a smaller document: doc_id, n_bytes, n_removed, n_spans, kept (binary) and the carried columns.

    Null texts count as empty; texts shorter than ``length`` stay. Rows with a null id neither lose bytes nor make
    others lose them; rows that share an id don't count as smaller than each other. Removal may cut a character: kept
    is the bytes left. An empty table gives no rows.
    """
    spans = repeated_spans(docs, length)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry
    )
    here = (F.col("doc_id") == F.col("_doc")) & (_text_mark("text") == F.col("_mark"))
    both = rows.join(spans.toDF("_doc", "_mark", "spans"), here, "left").select("doc_id", "text", "spans", *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            raw, offs = buffers(b.column("text"))
            row, spans = _flat(b, "spans")
            lo, hi = (np.minimum(spans.field(k).to_numpy() + offs[row], offs[row + 1]) for k in ("lo", "hi"))
            edge = np.bincount(lo, minlength=raw.size + 1)[: raw.size + 1] - np.bincount(hi, minlength=raw.size + 1)[: raw.size + 1]
            gone = np.cumsum(edge[:-1]) > 0
            if characters:  # bytes of a character share its first byte's number
                number = np.cumsum((raw & 0xC0) != 0x80)
                gone = np.bincount(number, gone, minlength=number.size + 1)[number] > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            begins[offs[:-1][np.diff(offs) > 0]] = gone[offs[:-1][np.diff(offs) > 0]]  # a run ends with its text
            runs = np.concatenate([[0], np.cumsum(begins)])
            left, n = offs - removed[offs], np.diff(offs)
            kept = pa.Array.from_buffers(
                pa.binary(), b.num_rows, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[~gone]))]
            )
            cols = [b.column("doc_id"), pa.array(n), pa.array(n - np.diff(left)), pa.array(np.diff(runs[offs])), kept]
            yield pa.RecordBatch.from_arrays([*cols, *[b.column(c) for c in carry]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carry])

    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name in carry)
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + more)


def kept_digest(removed: DataFrame) -> DataFrame:
    """remove_repeats' rows with kept_sha256 for the bytes themselves."""
    return removed.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


__all__ = ["Anchors", "kept_digest", "refine", "remove_repeats", "repeated_spans"]
