"""Edited copies of an item that very many documents hold: none of its seeds is rare, yet every copy is aligned."""

import random

import numpy as np

from corpusloom.llm import decontaminate


def test_edited_copies_of_a_common_item(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(7))
    items = [(0, [word() for _ in range(17)]), (1, [word() for _ in range(150)])]
    docs = [(d, [word() for _ in range(30)] + items[d % 2][1] + [word() for _ in range(30)]) for d in range(80)]
    for d in range(80, 240):
        item = items[d % 2][1]
        docs.append((d, [word() for _ in range(90)] + [word() if rng.random() < rng.choice((0.2, 0.3, 0.35)) else w for w in item] + [word()]))
    # whole only at one place: three words in a row, all others in pairs
    docs.append((500, [w for k, x in enumerate(items[0][1]) for w in ([word()] if k % 3 == 2 and k != 5 else [x])]))
    grams = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in items}
    code = lambda words: np.array([hash(w) for w in words], np.int64)
    want, few = {}, 0
    for d, w in docs:
        mine = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        for i, item in items:
            shared = len(grams[i] & mine)
            score, end = decontaminate.align(code(item), code(w))
            if shared and score / (2 * len(item)) >= 0.5:
                want[d, i] = round(score / (2 * len(item)), 6), end
                few += shared < 4
    assert few >= 3 and (500, 0) in want
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.end_word) for r in decontaminate.contaminated(frame, tests).collect()}
    assert got == want


def test_every_pair_of_the_score_is_found(spark):
    """200 documents x 20 items against alignment of all pairs: words changed at every place, left out and put in."""
    rng = random.Random(9)
    common = ["the", "of", "and", "to", "in", "is", "it", "was"]
    word = lambda: rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("abcdefghijk") for _ in range(5))
    items = [(i, [word() for _ in range(rng.choice([4, 5, 7, 12, 30]))]) for i in range(20)]
    docs = []
    for d in range(200):
        item, how = list(items[d % 20][1]), d // 20
        if how == 0:
            item = [word() if k % 3 == 2 else w for k, w in enumerate(item)]  # every third word replaced
        elif how == 1:
            item = [x for w in item for x in (w, word())]  # a word put in behind each
        elif how == 2:
            item = [w for k, w in enumerate(item) if k % 3 != 1]
        elif how < 8:
            for _ in range(rng.randint(0, len(item) // 2)):
                k = rng.randrange(len(item))
                item[k : k + 1] = rng.choice([[], [word()], [item[k], word()]])
                item = item or [word()]
        docs.append((d, [word() for _ in range(40)] + item + [word() for _ in range(40)]))
    code = lambda words: np.array([hash(w) for w in words], np.int64)
    want = {}
    for d, w in docs:
        for i, item in items:
            score, _ = decontaminate.align(code(item), code(w))
            if score >= len(item):
                want[d, i] = round(score / (2 * len(item)), 6)
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(4)
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(frame, tests).collect()}
    assert len(want) > 80 and got == want


def test_short_items_stand_whole(spark):
    docs = spark.createDataFrame([(1, "here is a unique phrase today"), (2, "unique thing, phrase"), (3, "Zyx."), (4, "one two three"), (5, "one two x three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "unique phrase"), (2, "zyx"), (3, "one two three"), (4, "..."), (5, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0)}
