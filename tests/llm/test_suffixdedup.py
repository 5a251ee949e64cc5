import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from corpusloom.llm import suffixdedup
from tests.llm.fixtures import empty, odd, odd_rows


def brute(rows, length):
    owners = {}
    for d, text in rows:
        t = (text or "").encode()
        for p in range(len(t) - length + 1):
            if d is not None:
                owners[t[p : p + length]] = min(owners.get(t[p : p + length], d), d)
    out = []
    for d, text in rows:
        t = (text or "").encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if d is not None and owners[t[p : p + length]] < d:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((-1 if d is None else d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages():
    rng = random.Random(11)
    some = lambda n, a="abcdefgh é": "".join(rng.choice(a) for _ in range(n))
    shared = [some(rng.choice([49, 50, 51, 60, 90, 200])) for _ in range(8)] + ["ab" * 60, "x" * 130]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(some(rng.randint(0, 80)))
            if rng.random() < 0.7:
                s = rng.choice(shared)
                i = rng.randint(0, 20)
                parts.append(s[i:] if rng.random() < 0.5 else s)
        rows.append((d * 3 % 61, "".join(parts)))
    return rows + rows[:3] + [(None, shared[0] * 2), (7, shared[3])]


@pytest.mark.parametrize("length", [50, 23])
def test_against_brute_force(spark, length):
    rows = passages() + [(r[0] if r[0] is None else r[0] + 1000, r[1]) for r in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffixdedup.kept_digest(suffixdedup.remove_repeats(docs, length)).collect()
    mine = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    want = brute(rows, length)
    assert mine == want


def test_odd_and_empty_tables(spark):
    got = suffixdedup.remove_repeats(odd(spark), 50, ("lang", "source", "n_chars")).collect()
    assert len(got) == len(odd_rows())
    assert suffixdedup.remove_repeats(empty(spark)).collect() == []


@pytest.mark.parametrize("length", [5, 8, 23, 50])
def test_refined_pointers_order_suffixes(length):
    rng = random.Random(length)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 150))) for _ in range(20)] + ["ab" * 60, "a" * 90]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    pointer = suffixdedup.refine(raw, offs, length)
    rows = [(texts[i][p : p + length], int(pointer[offs[i] + p])) for i in range(len(texts)) for p in range(len(texts[i]))]
    assert all((q == -1) == (len(w) < length) for w, q in rows)
    whole = [r for r in rows if r[1] >= 0]
    assert len({w for w, _ in whole}) == len(set(whole)) == len({q for _, q in whole})
    assert [w for w, _ in sorted(whole, key=lambda r: r[1])] == sorted(w for w, _ in whole)


def test_periodic_texts_and_stretches(spark, monkeypatch):
    rows = [(1, "x" * 900), (2, "x" * 1000 + "end of it"), (3, "start " + "abc" * 400), (4, "abc" * 100 + "tail"), (5, "bca" * 50 + "x" * 60)]
    rows += [(6, rows[0][1]), (7, "one two three four five six seven eight nine ten " * 30), (8, "six seven eight nine ten one two three four five " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for stretch in (suffixdedup.STRETCH, 128):
        monkeypatch.setattr(suffixdedup, "STRETCH", stretch)
        got = suffixdedup.kept_digest(suffixdedup.remove_repeats(docs, 50)).collect()
        assert sorted(map(tuple, got)) == brute(rows, 50)


def test_a_very_long_text_of_one_character(spark):
    n = 20 << 20
    docs = spark.createDataFrame([(1, "y" + "x" * 200), (2, "short")], "doc_id long, text string")
    long = spark.range(1).select((F.col("id") + 3).alias("doc_id"), F.expr(f"repeat('x', {n})").alias("text"))
    got = {r.doc_id: r for r in suffixdedup.remove_repeats(docs.union(long), 50).drop("kept").collect()}
    assert (got[3].n_removed, got[3].n_spans, got[1].n_removed, got[2].n_removed) == (n, 1, 0, 0)


def test_whole_characters_are_kept(spark):
    shared = "é" + "z" * 60
    rows = [(1, shared[0] + shared[1:]), (2, "own \ufffd sign è" + "z" * 60 + "漢字 end"), (3, "ê" + "z" * 59 + "\ufffd")]
    got = {r.doc_id: bytes(r.kept).decode() for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50, (), True).collect()}
    assert got[1] == rows[0][1] and got[2] == "own \ufffd sign è漢字 end" and got[3] == "ê\ufffd"
    cut = [(1, ("é" * 40)[0:40]), (2, "x" + "é" * 30 + "y")]  # the repeat starts inside no character, but ends where it may
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffixdedup.remove_repeats(spark.createDataFrame(cut, "doc_id long, text string"), 51, (), True).collect()}
    assert kept[2] in ("xy", "x" + "é" + "y", "x" + "é" * 2 + "y")
