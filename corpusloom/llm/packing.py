"""Hierarchical multi-length packing of documents into token sequences.

Each document's ids are cut into full windows and a remainder. The remainder goes to the tier (a power of two) that
just holds it. Long tiers are packed first; each gap takes whole documents of shorter tiers, an exact fit before the
longest that fits, and only then a cut one. So every sequence ends at a power of two and needs no padding. Step groups
gather sequences of one tier with the same number of tokens in each.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import pieces
from corpusloom.llm.tokens import encoder

#: Remainders that a task holds while it packs; more gives fewer cuts.
POOL = 4096
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
)


class Packer:
    """Packs (document, start, ids) remainders of one task; pieces come out as tuples, ids stay with their document."""

    def __init__(self, window: int, step_tokens: int, part: int):
        self.window, self.step_tokens, self.part = window, step_tokens, part
        self.pool: dict[int, list] = {}
        self.lengths: list[int] = []  # the pool's distinct lengths in order
        self.held = self.n_sequences = 0
        self.by_tier: dict[int, int] = {}

    def tier(self, n: int) -> int:
        return min(self.window, 1 << max(n - 1, 0).bit_length())

    def put(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        if ids.size not in self.pool:
            bisect.insort(self.lengths, ids.size)
            self.pool[ids.size] = []
        self.pool[ids.size].append((doc, start, ids))
        self.held += 1

    def take(self, n: int) -> tuple:
        got = self.pool[n].pop()
        if not self.pool[n]:
            del self.pool[n]
            self.lengths.pop(bisect.bisect_left(self.lengths, n))
        self.held -= 1
        return got

    def sequence(self, tier: int, members: list[tuple]) -> Iterator[tuple]:
        """The rows of one sequence; its step group holds step_tokens // tier sequences of this tier and task."""
        n = self.by_tier[tier] = self.by_tier.get(tier, -1) + 1
        # Unique over tasks: the task in the high bits, then the tier, then the number of the group.
        group = (self.part << 36) | (tier.bit_length() << 30) | (n // max(1, self.step_tokens // tier))
        number = (self.part << 36) | self.n_sequences
        self.n_sequences += 1
        offset = 0
        for (doc_id, total), start, ids in members:
            yield doc_id, start, ids.size, zlib.crc32(ids.astype("<u4").tobytes()), total, number, offset, tier, group
            offset += ids.size

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        doc, full = (doc_id, ids.size), ids.size // self.window * self.window
        for i in range(0, full, self.window):
            yield from self.sequence(self.window, [(doc, i, ids[i : i + self.window])])
        if full < ids.size:
            self.put(doc, full, ids[full:])
        if self.held >= POOL:
            yield from self.pack(POOL // 2)

    def pack(self, leave: int) -> Iterator[tuple]:
        """Pack until ``leave`` remainders are left; at 0 what is left at last is cut at powers of two."""
        while self.held > leave:
            first = self.take(self.lengths[-1])
            tier, members, gap = self.tier(first[2].size), [first], 0
            gap = tier - first[2].size
            while gap and self.held:
                at = bisect.bisect_right(self.lengths, gap)
                if at:
                    members.append(self.take(self.lengths[at - 1]))
                    gap -= members[-1][2].size
                else:
                    doc, start, ids = self.take(self.lengths[0])
                    members.append((doc, start, ids[:gap]))
                    self.put(doc, start + gap, ids[gap:])
                    gap = 0
            if not gap:
                yield from self.sequence(tier, members)
                continue
            size = sum(m[2].size for m in members)
            while size:
                tier, cut = 1 << (size.bit_length() - 1), []
                need = tier
                while need:
                    doc, start, ids = members.pop(0)
                    if ids.size > need:
                        members.insert(0, (doc, start + need, ids[need:]))
                        ids = ids[:need]
                    cut.append((doc, start, ids))
                    need -= ids.size
                yield from self.sequence(tier, cut)
                size -= tier


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, step_tokens: int = 1 << 16, added: bool = False) -> DataFrame:
    """Tokenize every whole text with end_id behind it and pack all ids; one row for each piece (see SCHEMA).

    With ``added``, tokens of the file that stand in a text have their own id (see Encoder).

    Tasks pack what they read, without a shuffle: a piece needs nothing of other tasks, and only a task's last
    sequences are short. Null texts count as empty and give the end id alone; repeated rows and null ids are packed
    like others; an empty table gives no pieces. window must be a power of two.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, packer = encoder(tokenizer, added), Packer(window, step_tokens, TaskContext.get().partitionId())
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch(out: list[tuple]) -> pa.RecordBatch:
            cols = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in pieces(batches, "text", 4 << 20):
            out = []
            for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                out.extend(packer.add(d, np.append(ids, np.uint32(end_id))))
            if out:
                yield batch(out)
        if out := list(packer.pack(0)):
            yield batch(out)

    return rows.mapInArrow(run, SCHEMA)
