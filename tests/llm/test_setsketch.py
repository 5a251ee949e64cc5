import random
import re

import numpy as np

from corpusloom.llm import setsketch
from corpusloom.llm.components import components
from tests.llm.fixtures import empty, odd, odd_rows

LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids) if ids and sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return out


def near_copies():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 40, 120]))]
        for k in range(rng.choice([1, 2, 9, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = word()
            rows.append((100 * g + k, " ".join(w).upper() if k % 2 else "\n".join(w)))
        chain = list(base)
        for k in range(5):
            chain = chain + [word() for _ in range(max(1, len(base) // 20))]
            rows.append((100 * g + 50 - k, " ".join(chain)))
    return rows


def test_against_brute_force(spark):
    rows = near_copies() + [(r[0], r[1]) for r in odd_rows()]
    for size in (4, 5):
        got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size).collect()
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(brute(rows, size, 80), key=key)


def test_odd_and_empty_tables(spark):
    assert len(setsketch.near_duplicates(odd(spark)).collect()) == len(odd_rows())
    assert setsketch.near_duplicates(empty(spark)).collect() == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 64, (2, 400), dtype=np.uint64)
    b[:300] = a[:300]
    union = np.union1d(a, b)
    one = lambda v: setsketch.registers(v, np.array([0, v.size]))
    assert (setsketch.merge(one(a), one(b)) == one(union)).all()
    got = setsketch.estimate(one(a), one(b), np.array([400]), np.array([400]))[0]
    assert abs(got - 300 / 500) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (None, 3), (200, 150), (150, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 200: 150, 150: 150}


def crowd(n, words, changed, seed):
    """n copies of one text that isn't among them, each with ``changed`` words of its own, all with one passage less or more."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**9)}" for _ in range(words)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(changed[k % len(changed)]):
            w[rng.randrange(words)] = f"own{rng.randrange(10**9)}"
        if k % 3 == 1:
            w[10:14] = ["one", "common", "passage", "here"]
        rows.append((seed * 10_000 + k, " ".join(w)))
    return rows


def test_large_groups_of_near_copies_lose_no_link(spark):
    # Copies that lie near, at and beyond the threshold from each other; more than the pairs of one group are compared at once.
    rows = crowd(90, 60, [1, 2, 3, 4], 1) + crowd(70, 80, [3], 2) + crowd(60, 40, [2, 0, 9], 3)
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 4, 80))


def test_candidates_grow_with_the_group_not_its_square(spark, monkeypatch):
    made = []
    across = setsketch._across

    def counted(*a):
        pairs = across(*a)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(setsketch, "_across", counted)
    rows = crowd(800, 80, [4], 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert setsketch.near_duplicates(docs, 4).count() == len(rows)
    assert made[0] < 25 * len(rows)


def test_regular_long_words_differ(spark):
    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate({97: 98, 98: 97})
    other = thue.translate({97: 98, 98: 97})
    docs = spark.createDataFrame([(1, f"p {thue} q r"), (2, f"p {other} q r")], "doc_id long, text string")
    assert sorted(r.component_id for r in setsketch.near_duplicates(docs, 4).collect()) == [1, 2]
