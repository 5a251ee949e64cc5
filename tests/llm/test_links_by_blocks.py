import numpy as np
import pyarrow as pa

from corpusloom.llm import setsketch
from corpusloom.llm.hashing import shingles
from tests.llm.test_setsketch import brute, crowd


def counted(monkeypatch):
    made, across = [], setsketch._across

    def run(*a):
        pairs = across(*a)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(setsketch, "_across", run)
    return made


def test_components_of_a_group_meet_by_fewer_links_than_members(spark, monkeypatch):
    made = counted(monkeypatch)
    rows = crowd(600, 60, [1, 2, 3], 7)
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 4, 80))
    assert 0 < made[0] < len(rows)


def test_groups_of_many_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    rows = crowd(90, 60, [1, 2, 3, 4], 1) + crowd(70, 80, [3], 2) + crowd(60, 40, [2, 0, 9], 3)
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 4, 80))


def test_two_blocks_are_joined_as_by_brute_force(monkeypatch):
    rows = crowd(50, 60, [1, 2, 3], 4) + crowd(20, 30, [0, 1], 6) + [(1, "x y"), (2, "one other text of seven words here")]
    texts = pa.array([t for _, t in rows]).cast(pa.binary())
    offs = np.concatenate([[0], np.cumsum([len(t.as_py()) for t in texts])])
    *values, at = shingles(np.frombuffer(b"".join(texts.to_pylist()), np.uint8), offs, 4, 2)
    keys = [b"%016d" % d for d, _ in rows]
    packed = [[v[i:j].tobytes() for i, j in zip(at[:-1], at[1:])] for v in values]
    want = {c: {r[0] for r in brute(rows, 4, 80) if r[2] == c} for c in {r[2] for r in brute(rows, 4, 80)}}
    for cells in (1, 100, 1 << 20):
        monkeypatch.setattr(setsketch, "CELLS", cells)
        for blocks in (1, 2):
            block = [d % blocks for d, _ in rows]
            got = setsketch._joined(pa.table({"block": block, "key": keys, "root": keys, "set": packed[0], "again": packed[1]}), 80)
            near = {k: {k} for k, _ in rows}
            for a, b in zip(*(map(int, got.column(c).to_pylist()) for c in "ab")):
                assert near[a] is not near[b] and (blocks == 1 or a % 2 != b % 2)
                near[a] |= near[b]
                for k in near[a]:
                    near[k] = near[a]
            if blocks == 1:
                assert {min(v): v for v in near.values()} == want
            else:
                assert all(v <= want[next(c for c in want if k in want[c])] for k, v in near.items())
