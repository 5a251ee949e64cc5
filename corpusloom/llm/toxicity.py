"""Toxicity: a support vector machine with a subsequence string kernel and Nystroem landmarks.

The string kernel of two words sums over common subsequences of three characters, each weighted by DECAY for every
place it spans, up to SPAN places, divided by the words' norms; so letters put in or left out between cost little. The
words' kernel is that to the POWER, 0 where the string kernel is at most FLOOR; a sentence's kernel is the sum over
its words. Landmarks are words and beginnings of words that tell labelled toxic documents from others, chosen one
after the other so that they cover different documents. Most words are nowhere near a landmark: a bound over all
landmarks at once settles them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, pieces

DECAY, SPAN, LONGEST, STEP = 0.7, 6, 24, 16
SYMBOLS = 40
POWER, FLOOR = 3, 0.4
#: Words of a sentence that are judged together; longer sentences are cut.
SENTENCE = 8
#: Words kept per worker with their scores.
KEPT = 500_000
_PAIRS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]
_LEET = str.maketrans("013457@$", "oieastas")
_NOT_WORD = re.compile(r"[\W_]+")


def normal(word: str) -> str:
    """Lower case, digits and signs that stand for letters as those, other signs removed."""
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    return _NOT_WORD.sub("", word.lower().translate(_LEET))


def _symbols(words: list[str]) -> np.ndarray:
    """(n, LONGEST + 2) symbol numbers, -1 beyond the end: a-z, marks for the word's two ends, other characters by hash.

    A hyphen at the end stands for any ending; normal words have none.
    """
    out = np.full((len(words), LONGEST + 2), -1, np.int16)
    for i, w in enumerate(words):
        end = [] if w[-1:] == "-" else [27]
        codes = [26, *((ord(c) - 97 if "a" <= c <= "z" else 28 + ord(c) % 12) for c in w[:LONGEST].rstrip("-")), *end]
        out[i, : len(codes)] = codes
    return out


def _spread(words: list[str], table: np.ndarray) -> np.ndarray:
    """Per word the weighted sum of table rows over its subsequences, divided by the word's norm; table is (SYMBOLS**3, ...)."""
    s = _symbols(words).astype(np.int32)
    s = s[:, : max(3, int((s >= 0).sum(axis=1).max(initial=0)))]
    total = np.zeros((len(words), *table.shape[1:]))
    norm = np.zeros(len(words))
    for a, b in _PAIRS:
        if b >= s.shape[1]:
            continue
        x, y, z = s[:, :-b], s[:, a : s.shape[1] - b + a], s[:, b:]
        there = z >= 0
        index = np.where(there, (x * SYMBOLS + y) * SYMBOLS + z, SYMBOLS**3 - 1)  # no subsequence has this number
        total += DECAY**b * table[index].sum(axis=1)
        norm += there.sum(axis=1) * DECAY ** (2 * b)
    return total / np.sqrt(np.maximum(norm, 1e-9)).reshape(-1, *[1] * (table.ndim - 1))


def _explicit(words: list[str]) -> np.ndarray:
    """(SYMBOLS**3, n): the words' subsequence weights, each word of norm about one."""
    s = _symbols(words).astype(np.int64)
    out, norm = np.zeros((SYMBOLS**3, len(words))), np.zeros(len(words))
    column = np.broadcast_to(np.arange(len(words))[:, None], s.shape)
    for a, b in _PAIRS:
        x, y, z = s[:, :-b], s[:, a : s.shape[1] - b + a], s[:, b:]
        there = z >= 0
        np.add.at(out, (((x * SYMBOLS + y) * SYMBOLS + z)[there], column[:, : z.shape[1]][there]), DECAY**b)
        norm += there.sum(axis=1) * DECAY ** (2 * b)
    return out / np.sqrt(np.maximum(norm, 1e-9))


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Subsequence kernel of two lists of normal words."""
    return _spread(a, _explicit(b))


def units(words: list[str]) -> list[str]:
    """Words for scoring: runs of single characters are also joined, so that spaced-out words count."""
    if not any(len(w) == 1 for w in words):
        return words
    out, run = [], []
    for w in [*words, ""]:
        if len(w) == 1:
            run.append(w)
            continue
        out.extend(["".join(run)] if len(run) > 2 else run)
        run = []
        if w:
            out.append(w)
    return out


@dataclass(frozen=True)
class Model:
    """table: the landmarks' subsequence weights; weights: the machine's, one a landmark; bias; the logistic function's slope and shift."""

    table: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0


def features(words: list[str], table: np.ndarray) -> np.ndarray:
    """(n, landmarks): the words' kernel with each landmark."""
    out = np.zeros((len(words), table.shape[1]))
    if not table.shape[1]:
        return out
    most = table.max(axis=1)
    for i in range(0, len(words), 4096):
        part = words[i : i + 4096]
        near = np.flatnonzero(_spread(part, most) > FLOOR)
        for j in range(0, near.size, 256):
            k = near[j : j + 256]
            value = _spread([part[x] for x in k], table)
            out[i + k] = np.where(value > FLOOR, value, 0.0) ** POWER
    return out


def _cut(word: str) -> list[str]:
    return [word[i : i + LONGEST] for i in range(0, max(1, len(word) - LONGEST + STEP), STEP)] if len(word) > LONGEST else [word]


class Scorer:
    """Decision values of texts: the largest sum of word scores in any sentence, half of the next two, and the bias."""

    def __init__(self, model: Model):
        self.model, self.kept = model, {}

    def _new(self, words: list[str]) -> list[float]:
        cut = [_cut(normal(w)) for w in words]
        value = features([x for c in cut for x in c], self.model.table) @ self.model.weights
        return np.maximum.reduceat(value, np.cumsum([0, *map(len, cut)])[:-1]).tolist()

    def decisions(self, texts: list[str | None]) -> np.ndarray:
        split = [units((t or "").split()) for t in texts]
        get = self.kept.get
        found = [list(map(get, words)) for words in split]
        missing = set()
        for words, values in zip(split, found, strict=True):
            if None in values:
                missing.update([w for w, v in zip(words, values, strict=True) if v is None])
        order = list(missing)
        new = dict(zip(order, self._new(order), strict=True)) if order else {}
        out = np.full(len(texts), self.model.bias)
        for i, (words, values) in enumerate(zip(split, found, strict=True)):
            if not words:
                continue
            if None in values:
                values = [new[w] if v is None else v for w, v in zip(words, values, strict=True)]
            v = np.array(values)
            if v.any():
                sums = np.sort(np.add.reduceat(v, np.arange(0, v.size, SENTENCE)))[::-1]
                out[i] += sums[0] + np.maximum(sums[1:3], 0).sum() / 2
        if len(self.kept) + len(new) > KEPT:
            self.kept = {}
        self.kept.update((w, v) for w, v in new.items() if len(w) <= 64)
        return out

    def logistic(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.model.slope * decisions + self.model.shift, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 20) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate descent; the bias is a constant feature."""
    x = np.hstack([x, np.ones((x.shape[0], 1))])
    alpha, w, square = np.zeros(x.shape[0]), np.zeros(x.shape[1]), (x * x).sum(axis=1)
    rng = np.random.default_rng(5)
    most = cost * np.where(y > 0, (y < 0).mean(), (y > 0).mean())
    for _ in range(rounds):
        for i in rng.permutation(x.shape[0]):
            step = np.clip(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0, most[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w[:-1], float(w[-1])


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by five; null ids aren't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _strings(word: str) -> list[str]:
    """A word's pieces, and the beginnings of the word."""
    return [*_cut(word), *(f"{word[:k]}-" for k in range(4, 9) if len(word) > k)]


def _cover(members: pd.DataFrame, odds: pd.Series, most: int) -> list[str]:
    """Strings by odds times the root of the documents they add; a document counts less with each string it has."""
    docs, strings = pd.factorize(members.doc_id)[0], members.s.to_numpy()
    of = {k: docs[v] for k, v in members.groupby("s").indices.items()}
    weight, out, names = np.ones(docs.max() + 1), [], sorted(of)
    first = 0.0
    while len(out) < most:
        gain = np.array([odds[s] * np.sqrt(weight[of[s]].sum()) for s in names])
        best = int(gain.argmax())
        first = max(first, gain[best])
        if gain[best] < 0.1 * first or not strings.size:
            break
        out.append(names[best])
        weight[of[names.pop(best)]] *= 0.25
        if not names:
            break
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = 2000, landmarks: int = 64) -> Model:
    """Train on at most ``most`` toxic and ``most`` other labelled documents that aren't held out, chosen by hash of the id.

    The driver gets at most 1000 candidate strings with their toxic documents, and 8 * ``most`` sentences of SENTENCE
    words; all texts are read whole in the tasks, and words longer than LONGEST in all their pieces, as in scoring.
    Where labels of one doc_id clash, or those of equal texts, the text counts as toxic; null labels and ids are left
    out. Without both kinds of label, or strings that tell them apart, the model scores every text alike.
    """
    none = Model(np.zeros((SYMBOLS**3, 0)), np.zeros(0))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic")).dropna()
    known = known.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("toxic"))
    chosen = known.where("toxic").orderBy(order).limit(most).unionByName(known.where("not toxic").orderBy(order).limit(most))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = text.join(F.broadcast(chosen), "doc_id")  # at most 2 * most ids
    rows = materialize(rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "labelled")
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return none

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            for d, toxic, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True):
                got = list({s for w in {normal(w) for w in units(t.split())} if w for s in _strings(w)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * len(got), pa.int64()), pa.array([toxic] * len(got), pa.bool_()), pa.array(got, pa.string())],
                    ["doc_id", "toxic", "s"],
                )

    every = rows.mapInArrow(strings, "doc_id long, toxic boolean, s string")
    count = every.groupBy("s").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (size[True] + 1)) - F.log((F.col("good") + 0.5) / (size[False] + 1))
    count = materialize(count.withColumn("odds", odds), "strings")
    rare = max(3, size[True] // 200)
    told = count.where((F.col("bad") >= rare) & (F.col("odds") > 2)).orderBy((-F.col("odds") * F.sqrt("bad")), "s").limit(1000)
    told = materialize(told, "told")
    strength = told.toPandas().set_index("s")["odds"]
    if strength.empty:
        return none
    members = every.where("toxic").join(F.broadcast(told.select("s")), "s").select("doc_id", "s").toPandas()
    telling = _cover(members, strength, landmarks)
    marked = set(telling)

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            for d, toxic, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True):
                words = [n for n in map(normal, units(t.split())) if n]
                cut = [words[i : i + SENTENCE] for i in range(0, len(words), SENTENCE)]
                hit = [any(not marked.isdisjoint(_strings(w)) for w in c) for c in cut]
                kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()))
                cols = ([d] * len(cut), [toxic] * len(cut), hit, cut)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "toxic", "hit", "words"])

    cut = materialize(rows.mapInArrow(sentences, "doc_id long, toxic boolean, hit boolean, words array<string>"), "sentences")
    pick = lambda which, n: [list(r.words) for r in cut.where(which).orderBy(F.xxhash64("doc_id", "words")).limit(n).select("words").collect()]
    positive = pick("toxic and hit", 4 * most)
    negative = pick("not toxic and hit", 2 * most) + pick("not toxic and not hit", 2 * most)
    # Also with a character put into the telling words: nothing that labels have, but what writers do to pass filters.
    rng = np.random.default_rng(3)
    blurred = []
    for s in positive[: len(positive) // 2]:
        new = []
        for w in s:
            if len(w) > 3 and not marked.isdisjoint(_strings(w)):
                i = int(rng.integers(1, min(len(w), 6)))
                w = w[:i] + "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)] + w[i:]
            new.append(w)
        blurred.append(new)
    sample = positive + blurred + negative
    y = np.array([1] * (len(positive) + len(blurred)) + [-1] * len(negative))
    points = telling
    flat = sorted({x for s in sample for w in s for x in _cut(w)})
    table = _explicit(points).astype(np.float32)
    own = features(points, table)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-4 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    near = features(flat, table) @ root
    place = {w: i for i, w in enumerate(flat)}
    x = np.array([near[[place[x] for w in s for x in _cut(w)]].sum(axis=0) for s in sample])
    beta, bias = _svm(x, y)
    model = Model(table, root @ beta, bias)
    # The logistic function of documents' largest decisions, by Newton steps on the chosen documents.
    got = _decided(rows, model, ["toxic"]).select("toxic", "decision").toPandas()
    d, target = got.decision.to_numpy(), got.toxic.to_numpy(float)
    share = np.where(target == 1, 0.25 / max(target.sum(), 1), 0.75 / max((1 - target).sum(), 1)) * target.size
    a, b = np.zeros(2), np.stack([d, np.ones_like(d)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(b @ a, -30, 30)))
        hess = (b * (share * p * (1 - p))[:, None]).T @ b + 1e-3 * np.eye(2)
        a = a - np.linalg.solve(hess, b.T @ (share * (p - target)) + 1e-3 * a)
    return Model(table, model.weights, bias, float(a[0]), float(a[1]))


def _decided(rows: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The carried columns with decision and score; rows must have text."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    base = rows.select(*carry, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in pieces(batches, "text", 4 << 20):
            d = scorer.decisions(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(d), pa.array(scorer.logistic(d))], [*carry, "decision", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in carry)
    return base.mapInArrow(run, f"{kinds}, decision double, score double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every row's whole text.

    Null and empty texts have the score of a text without words; equal texts score alike; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _decided(rows, model, ["doc_id"]).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
