"""Benchmark decontamination: rare word pairs as seeds lead documents to test items, Smith-Waterman alignment scores them.

Words are runs of letters and digits of the lower-cased text, compared by 64-bit hashes. Of each item only the rarest
of its word pairs are seeds, just so many that no alignment with the wanted score can do without all of them (see
_least_pairs). Tasks align the stretches around seeds with the items at once, so only pairs that score enough are dealt
out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import hashing
from corpusloom.llm.common import buffers, materialize, pieces

#: Items are taken in blocks of about so many seeds; a block's seeds and words are sent to the tasks.
BLOCK_SEEDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items with fewer words only count where they stand whole.
SHORT = 4

_NONE = np.uint64(0)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, and the offsets of each text's."""
    spaced = np.where(_WORD[raw], raw, np.uint8(32)) if raw.size else raw
    starts, ends, at = hashing.words(spaced, offs)
    return hashing.word_hashes(raw, starts, ends), at


def _pairs(words: np.ndarray, at: np.ndarray, apart: int = 1) -> np.ndarray:
    """For each word the hash of it and the word ``apart`` places behind it; at a text's end one that no item has."""
    later = np.concatenate([words[apart:], np.zeros(min(apart, words.size), np.uint64)])
    out = hashing.mix(words * hashing._LANES[10] + later * hashing._LANES[11])
    out[np.arange(words.size) + apart >= np.repeat(at[1:], np.diff(at))] = _NONE
    return out


def _least_pairs(m: np.ndarray, least: float) -> np.ndarray:
    """How many of an item's m - 1 word pairs an alignment with the score must have, side by side or with one word between.

    Between two matched words that aren't such a pair there are an item's word left out or changed, or two words put in.
    With a pairs side by side, s with a word between, and t of the others by changed words: the score is at most
    2 + 2a + s + t, and 1 + a + s + 2t words at most are the item's; so 3a + s >= 2 * score - m - 3.
    """
    return np.ceil((2 * MATCH * m * least - m - 3) / 3 - 1e-9).astype(np.int64)


def item_words(items: DataFrame) -> DataFrame:
    """item_id, words (hashes) of every item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            words, at = _words(*buffers(b.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), lists], ["item_id", "words"]).filter(pa.array(np.diff(at) > 0))

    low = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text"))
    return low.where("item_id is not null").mapInArrow(run, "item_id long, words array<long>")


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the offsets of each."""
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    return pc.list_flatten(lists).to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score (MATCH, MISMATCH, GAP a word), and the passage's word where it ends (exclusive)."""
    steps = np.arange(passage.size + 1) * -GAP
    row, best, end = np.zeros(passage.size + 1, np.int64), 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.maximum.accumulate(new + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def _low(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))


def _found(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the known (sorted) ones, and their places there."""
    place = np.minimum(np.searchsorted(known, values), max(known.size - 1, 0))
    hit = np.flatnonzero(known[place] == values) if known.size else np.zeros(0, np.int64)
    return hit, place[hit]


def _frequencies(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """How often the known word pairs stand in the documents; tasks count first, and one number for each pair is gathered."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        count = np.zeros(known.size, np.int64)
        for b in pieces(batches, "text"):
            _, place = _found(known, _pairs(*_words(*buffers(b.column("text")))))
            count += np.bincount(place, minlength=known.size)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["k", "n"])

    got = _low(docs).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(known.size, np.int64)
    out[got.k.to_numpy()] = got.n.to_numpy()
    return out


def _rare_seeds(docs: DataFrame, words: np.ndarray, at: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of all items, and the item of each: the rarest word pairs, all but as many as an alignment must have less one.

    A word alone is its own seed; of other short items the rarest pair is enough, as they have to stand whole.
    """
    pairs, m, item = _pairs(words, at), np.diff(at), np.repeat(np.arange(at.size - 1), np.diff(at))
    item, pairs = item[pairs != _NONE], pairs[pairs != _NONE]
    # A pair that an item has twice is one seed, taken once for each time it counts.
    known, code = np.unique(pairs, return_inverse=True)
    often = _frequencies(docs, known)[code] if known.size else np.zeros(0, np.int64)
    order = np.lexsort((pairs, often, item))
    item, pairs = item[order], pairs[order]
    place = np.arange(item.size) - np.searchsorted(item, item)
    must = np.where(m < SHORT, m - 1, np.maximum(_least_pairs(m, least), 1))
    good = place < (m - 1 - must + 1)[item]
    single = np.flatnonzero(m == 1)
    seeds, holders = np.concatenate([pairs[good], words[at[:-1][single]]]), np.concatenate([item[good], single])
    both = np.unique(np.stack([seeds, holders.astype(np.uint64)], axis=1), axis=0)
    return both[:, 0], both[:, 1].astype(np.int64)


def _scored(docs: DataFrame, items: pa.Table, least: float) -> DataFrame:
    """doc_id, item_id, score, end_word of every stretch around shared seeds whose best alignment has the score."""
    texts, starts = _flat(items["words"])
    seeds, holders = _rare_seeds(docs, texts.view(np.uint64), starts, least)
    known, first = np.unique(seeds, return_index=True)
    names = items["item_id"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((known, np.append(first, seeds.size), holders, texts, starts, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, holders, texts, starts, names = sent.value
        m = np.diff(starts)
        # An alignment that scores enough is no longer than its item and as many words put in as its score allows.
        wide = m + np.ceil(m * MATCH * (1 - least) / -GAP).astype(np.int64)
        bits = np.zeros(1 << 20, bool)
        bits[(known >> np.uint64(44)).astype(np.int64)] = True
        own, must, some_single = _pairs(texts.view(np.uint64), starts), np.maximum(_least_pairs(m, least), 1), bool((m == 1).any())
        for b in pieces(batches, "text"):
            words, at = _words(*buffers(b.column("text")))
            grams, apart = _pairs(words, at), _pairs(words, at, 2)
            spot, seed = [], []
            for value in (grams, apart, words) if some_single else (grams, apart):
                maybe = np.flatnonzero(bits[(value >> np.uint64(44)).astype(np.int64)])
                hit, place = _found(known, value[maybe])
                spot.append(maybe[hit])
                seed.append(place)
            spot, seed = np.concatenate(spot), np.concatenate(seed)
            if not spot.size:
                continue
            # One row for each hit and item that has its seed; hits of one item near each other are one stretch.
            n = first[seed + 1] - first[seed]
            item = holders[np.repeat(first[seed] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            spot = np.repeat(spot, n)
            doc = np.searchsorted(at, spot, "right") - 1
            order = np.lexsort((spot, item, doc))
            item, spot, doc = item[order], spot[order], doc[order]
            new = np.ones(item.size, bool)
            new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (spot[1:] - spot[:-1] > 2 * wide[item[1:]] + 2)
            edge = np.append(np.flatnonzero(new), item.size)
            ids, values, out = b.column("doc_id"), words.view(np.int64), ([], [], [], [])
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                k, d = item[i], doc[i]
                lo, hi = max(at[d], spot[i] - wide[k]), min(at[d + 1], spot[j - 1] + 2 + wide[k])
                text, here, mine = texts[starts[k] : starts[k + 1]], values[lo:hi], own[starts[k] : starts[k + 1] - 1]
                if text.size < SHORT:
                    ends = [e for e in range(text.size, here.size + 1) if (here[e - text.size : e] == text).all()]
                    best, end = (MATCH * text.size, ends[0]) if ends else (0, 0)
                else:
                    if (np.isin(mine, grams[lo:hi]) | np.isin(mine, apart[lo:hi])).sum() < must[k] or np.isin(text, here).sum() < least * text.size:
                        continue  # no alignment can have the score
                    best, end = align(text, here)
                if (score := best / (MATCH * text.size)) >= least:
                    for c, v in zip(out, (ids[int(d)].as_py(), int(names[k]), score, int(lo - at[d]) + end), strict=True):
                        c.append(v)
            if out[0]:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "score", "end_word"])

    return _low(docs).mapInArrow(run, "doc_id long, item_id long, score double, end_word long")


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, end_word: pairs whose best alignment has at least ``least`` of the item's full score.

    For ``least`` of 0.5 and more no such pair is lost, however many documents or items have a seed and wherever words
    are changed, left out or put in; lower ones find only pairs with a seed. Items of fewer than SHORT words are found
    where they stand whole, items without words never. Null and empty texts match nothing, null item ids are left out;
    rows that share an item_id are items of their own, and the best score counts; rows that share a doc_id give its
    best score once; a null doc_id stays null. Empty tables give no rows.
    """
    made = materialize(item_words(items), "items")
    total = made.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_SEEDS))
    found = None
    for k in range(blocks):
        part = made.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()
        scored = _scored(docs, part, least)
        found = scored if found is None else found.unionByName(scored)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("end_word")).alias("e"))).alias("b"))
    return best.select("doc_id", "item_id", F.round("b.score", 6).alias("score"), (-F.col("b.e")).alias("end_word"))


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without the documents that contain a test item; rows with a null doc_id stay only where none of them does.

    Rows that share a doc_id go together; without items or with an empty table nothing goes.
    """
    name = "_bad"
    while name in docs.columns:
        name += "_"
    bad = materialize(contaminated(docs, items, **how).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad[name]), "left_anti")
