import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, kneserney, toxicity
from tests.llm.fixtures import empty, odd, odd_rows

LABELS = "doc_id long, quality int, toxic int"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice(["ba", "ko", "ri", "tu", "ne"]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows, labels = [], []
    for i in range(240):
        junk = i % 6 == 5
        text = " ".join("#%&!" * 3 for _ in range(30)) if junk else prose(rng, rng.randint(20, 80), words)
        rows.append((i, text, "xx" if i % 2 else "yy", "s", 1, 1, "x"))
        if i % 3:
            labels.append((i, int(not junk), 0))
    return rows, labels


def reference_model(texts):
    """Interpolated modified Kneser-Ney over characters, by dictionaries."""
    counts = {4: Counter()}
    for t in texts:
        s = "\0\0\0" + t
        counts[4].update(s[i : i + 4] for i in range(len(s) - 3))
    for o in (3, 2, 1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    back = {}
    for o in (2, 3, 4):
        n = Counter(counts[o].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = {i: min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] else i / 2 for i in (1, 2, 3)}
        total, freed = defaultdict(float), defaultdict(float)
        for g, c in counts[o].items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3)]
        back[o] = d, total, freed
    ones = sum(counts[1].values())

    def p(g):
        if len(g) == 1:
            return counts[1][g] / ones * (1 - kneserney.UNSEEN) if g in counts[1] else kneserney.UNSEEN / 65536
        d, total, freed = back[len(g)]
        low = p(g[1:])
        c, ctx = counts[len(g)][g], g[:-1]
        return low if ctx not in total else (max(c - d[min(c, 3)], 0) if c else 0) / total[ctx] + freed[ctx] / total[ctx] * low

    return lambda t: sum(-math.log(p(("\0\0\0" + t)[i : i + 4])) for i in range(len(t)))


def test_kneser_ney_against_dictionaries(spark, corpus):
    rows = [*corpus[0][:40], (500, "zzqqxxyyww", "xx", "s", 1, 1, "x"), (501, "été Ünknown 漢😀", "xx", "s", 1, 1, "x"), (502, None, "xx", "s", 1, 1, "x")]
    docs = spark.createDataFrame(rows, odd(spark).schema).repartition(5)
    units = lambda t: t.encode("utf-16-le").decode("utf-16-le")
    model = kneserney.train(docs.where("doc_id < 30"))
    want = reference_model([units(r[1]) for r in rows[:30]])
    got = {r.doc_id: r for r in kneserney._scored(docs, model).collect()}
    assert len(got) == len(rows) and got[502].n_ == got[502].nll_ == 0
    for r in rows[:41]:  # texts that trained, others, and one of n-grams that training lacks
        assert got[r[0]].n_ == len(r[1]) and math.isclose(got[r[0]].nll_, want(r[1]), rel_tol=1e-6)
    assert got[501].n_ == len(rows[-2][1]) + 1  # a character beyond U+FFFF has two units
    assert got[500].nll_ / got[500].n_ > 2 * got[0].nll_ / got[0].n_


def test_limits_and_rejections_by_brute_force(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, odd(spark).schema).withColumn("mean", F.lit(1)).withColumn("_limit", F.lit("x")).withColumn("nll", F.lit(2)).withColumn("part", F.lit(3))
    good = {d for d, q, _ in labels if q}
    held = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()}
    want = reference_model([r[1] for r in rows if r[0] in good - held])
    nll = {r[0]: want(r[1]) for r in rows}
    mean, far = {}, defaultdict(list)
    for lang in ("xx", "yy"):
        mine = [r for r in rows if r[2] == lang and r[0] in good & held]
        mean[lang] = sum(nll[r[0]] for r in mine) / sum(len(r[1]) for r in mine)
        far[lang] = sorted((nll[r[0]] - mean[lang] * len(r[1])) / (len(r[1]) + kneserney.PRIOR) for r in mine)
    limit = {k: mean[k] + v[math.ceil(0.9 * len(v)) - 1] for k, v in far.items()}
    got = kneserney.classify(docs, kneserney.fit(docs, spark.createDataFrame(labels, LABELS), 0.9, least=5)).collect()
    assert len(got) == len(rows)
    for r in got:
        judged = (nll[r.doc_id] + kneserney.PRIOR * mean[r.lang]) / (len(r.text) + kneserney.PRIOR)
        assert math.isclose(math.log(r.limit), limit[r.lang], rel_tol=1e-6) and math.isclose(math.log(r.judged), judged, rel_tol=1e-6)
        assert math.isclose(math.log(r.perplexity), nll[r.doc_id] / len(r.text), rel_tol=1e-6)
        assert r.rejected == (judged > limit[r.lang] + 1e-9) and (r["mean"], r["_limit"], r["nll"], r["part"]) == (1, "x", 2, 3)


def test_quality_classifier(spark, corpus):
    docs = spark.createDataFrame(corpus[0], odd(spark).schema)
    labels = spark.createDataFrame(corpus[1], LABELS)
    got = kneserney.classify(docs, kneserney.fit(docs, labels, stretch=2.0)).collect()
    assert len(got) == len(corpus[0])
    assert all(r.rejected == (r.doc_id % 6 == 5) for r in got)


def test_quality_of_odd_and_empty_tables(spark, corpus):
    labels = spark.createDataFrame(corpus[1], LABELS)
    both = odd(spark).union(spark.createDataFrame(corpus[0], odd(spark).schema))
    got = kneserney.classify(odd(spark), kneserney.fit(both, labels)).collect()
    assert len(got) == len(odd_rows()) and not any(r.rejected for r in got if not r.text)
    none = kneserney.classify(odd(spark), kneserney.fit(odd(spark), labels.limit(0))).collect()
    assert not any(r.rejected for r in none)
    assert kneserney.classify(empty(spark), kneserney.fit(empty(spark), labels)).collect() == []


def test_decontamination(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(50, None), (51, "two words"), (None, "a b c d")]
    docs, want = [], set()
    for d in range(60):
        w = [word() for _ in range(100)]
        kind = d % 4
        if kind:
            item = items[d % 20][1].split()
            if kind == 2:  # every sixth word replaced, one left out, one put in
                item = [word() if k % 6 == 5 else x for k, x in enumerate(item)]
                del item[9]
                item.insert(15, word())
            if kind == 3:
                item = item[:8]  # a short quotation isn't a copy
            else:
                want.add((d, d % 20))
            w[40:40] = item
        docs.append((d, " ".join(w).upper() if d % 2 else ", ".join(w)))
    frame = spark.createDataFrame(docs + [(None, ""), (77, None)], "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_SEEDS, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", block)
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, tests).collect()} == want
    left = {r.doc_id for r in decontaminate.clean(frame, tests).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want} | {None, 77}
    assert decontaminate.contaminated(odd(spark), tests.where('item_id < 50')).collect() == []
    assert decontaminate.contaminated(frame, tests.limit(0)).collect() == []
    assert decontaminate.contaminated(empty(spark), tests).collect() == []


def test_alignment_against_full_matrix():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 14))
        h = np.zeros((a.size + 1, b.size + 1), int)
        for i in range(a.size):
            for j in range(b.size):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def brute_kernel(a, b):
    def weights(w):
        s, out, norm = "^" + w.rstrip("-") + ("" if w.endswith("-") else "$"), Counter(), 0.0
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    if k - i <= toxicity.SPAN:
                        out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i)
                        norm += toxicity.DECAY ** (2 * (k - i))
        return out, math.sqrt(norm)

    (x, n), (y, m) = weights(a), weights(b)
    return sum(v * y[k] for k, v in x.items()) / n / m


def test_string_kernel():
    words = ["idiot", "idixot", "id", "a", "losers", "lo-", "zzzzzz"]
    got = toxicity.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert math.isclose(got[i, j], brute_kernel(a, b), abs_tol=1e-9)
    assert toxicity.normal("I.d-1_0t!") == "idiot"
    assert toxicity.units(["i", "d", "i", "o", "t", "is", "a", "b"]) == ["idiot", "is", "a", "b"]


def test_toxicity(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice(["ba", "ko", "ri", "tu", "ne"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    insults = ["blockhead", "nincompoop", "scoundrel"]
    rows, labels = [], []
    for i in range(400):
        w, bad = [rng.choice(words) for _ in range(rng.randint(10, 60))], i % 4 == 0
        if bad:
            for _ in range(3):
                x = rng.choice(insults)
                w.insert(rng.randrange(len(w)), {0: x, 1: x[:3] + "-" + x[3:], 2: x[:4] + "x" + x[4:], 3: x.upper() + "!"}[(i // 4) % 4 if i > 200 else 0])
        rows.append((i, " ".join(w), "en", "s", 1, 1, "x"))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, odd(spark).schema)
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = sum(got[i].predicted == t for i, _, t in labels)
    assert right >= 392 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert len(toxicity.score(odd(spark), model).collect()) == len(odd_rows())
    assert toxicity.score(empty(spark), model).collect() == []
    blank = toxicity.fit(docs, spark.createDataFrame([], LABELS))
    assert {r.score for r in toxicity.score(odd(spark), blank).collect()} == {0.5}


def test_clashing_labels_are_toxic_whatever_their_order(spark):
    rows = [(i, ("you blockhead fool number" if i % 3 == 0 else "good morning to all of you") + f" {i % 50}", "en", "s", 1, 1, "x") for i in range(300)]
    docs = spark.createDataFrame(rows, odd(spark).schema)
    labels = [(i, 1, int(i % 3 == 0)) for i in range(300)] + [(i, 1, 0) for i in range(0, 60, 3)] + [(None, 1, 1), (7, 1, None)]
    one = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    two = toxicity.fit(docs.repartition(3), spark.createDataFrame(labels[::-1], LABELS).repartition(5))
    assert (one.table == two.table).all() and np.allclose(one.weights, two.weights) and math.isclose(one.bias, two.bias, abs_tol=1e-9)
    assert len(toxicity._strings("a" * 60)) > 3
