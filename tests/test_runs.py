"""Retrieval within corpora, sweeps from running sums, admission and best needles against plain loops."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import bleu, evaluation, limits, needles, projections, ranges, relational, retrieval

WORDS = "red green blue grey loom warp weft thread shuttle cloth".split()


def corpora(spark, n=240, seed=3):
    rng = random.Random(seed)
    docs = [(i % 3 if i % 3 else i % 7, i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))), rng.choice(WORDS)) for i in range(n)]
    asked = [(c, 1000 + 10 * c + j, " ".join(rng.choice(WORDS) for _ in range(3))) for c in range(8) for j in range(2)]
    return docs, asked


def test_bm25_by_corpus_equals_one_corpus_at_a_time(spark):
    docs, asked = corpora(spark)
    docs.append((1, 900, None, None))
    d = spark.createDataFrame(docs, "corpus long, doc_id long, text string, meta string")
    q = spark.createDataFrame([*asked, (99, 5000, "red"), (1, 5001, None)], "corpus long, item_id long, text string")
    both = {(r.item_id, r.doc_id): (r.corpus, r.score) for r in retrieval.bm25(d, q, by=["corpus"]).collect()}
    want = {}
    for c in range(8):
        alone = retrieval.bm25(d.where(F.col("corpus") == c).drop("corpus"), q.where(F.col("corpus") == c).drop("corpus"))
        want |= {(r.item_id, r.doc_id): (c, r.score) for r in alone.collect()}
    assert both == want and want
    plain = plain_bm25([x for x in docs if x[0] == 2], [x for x in asked if x[0] == 2][0][2])
    item = [x for x in asked if x[0] == 2][0][1]
    assert {k[1]: v[1] for k, v in want.items() if k[0] == item} == plain


def plain_bm25(docs, question):
    split = lambda t: Counter((t or "").split())
    terms = {i: Counter({w: float(n) for w, n in split(t).items()}) + Counter({w: 2.0 * n for w, n in split(m).items()}) for _, i, t, m in docs}
    df = Counter(w for t in terms.values() for w in t)
    mean = sum(sum(t.values()) for t in terms.values()) / len(terms)
    out = {}
    for i, t in terms.items():
        size = sum(t.values())
        s = sum(n * math.log(1 + (len(terms) - df[w] + 0.5) / (df[w] + 0.5)) * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * size / max(mean, 1))) for w, n in split(question).items() if t[w])
        if round(s, 6) > 0:
            out[i] = round(s, 6)
    return out


def test_bm25_reads_its_texts_once(spark, tmp_path):
    docs, asked = corpora(spark)
    spark.createDataFrame(docs, "corpus long, doc_id long, text string, meta string").write.parquet(str(tmp_path / "d"))
    tracked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            tracked.add(b.num_rows)
            yield b

    d = spark.read.parquet(str(tmp_path / "d")).mapInArrow(seen, "corpus long, doc_id long, text string, meta string")
    q = spark.createDataFrame(asked, "corpus long, item_id long, text string")
    assert retrieval.bm25(d, q, by=["corpus"]).count() > 0 and tracked.value == len(docs)
    tracked.value = 0
    assert retrieval.two_field_bm25(d.drop("corpus"), q).count() > 0 and tracked.value == len(docs)


def test_hybrid_stays_within_its_corpus(spark):
    docs, asked = corpora(spark)
    rng = random.Random(5)
    vec = lambda: [rng.random() for _ in range(4)]
    chunks = spark.createDataFrame([(*d, vec(), d[1] % 3) for d in docs], "corpus long, doc_id long, text string, meta string, vec array<double>, quality long")
    questions = spark.createDataFrame([(*a, vec()) for a in asked], "corpus long, item_id long, text string, qvec array<double>")
    got = retrieval.hybrid_within(chunks, questions, ["corpus"], limit=8, pool=5).collect()
    home = {d[1]: d[0] for d in docs}
    assert got and all(home[r.doc_id] == r.corpus == (r.item_id - 1000) // 10 and r.number <= 5 and r.rank <= 5 for r in got)


def test_target_rank_needs_path_and_all_lines(spark):
    ranked = spark.createDataFrame([(1, 1, "a", 1, 4), (1, 2, "b", 5, 9), (1, 3, "a", 5, 9), (1, 4, "a", 1, 99), (2, 1, None, 1, 9), (3, 1, "a", 3, 3)], "item_id long, rank long, path string, start_line long, end_line long")
    goals = spark.createDataFrame([(1, "a", 6, 9), (2, None, 2, 2), (3, "a", 3, 4), (4, "a", 1, 1)], "item_id long, path string, start_line long, end_line long")
    got = {r.item_id: (r.target_rank, r.reciprocal_rank) for r in retrieval.target_rank(ranked, goals).collect()}
    assert got == {1: (3, 0.333333), 2: (None, 0.0), 3: (None, 0.0), 4: (None, 0.0)}


def test_running_sums(spark):
    rows = [((i * 37) % 501, i % 5) for i in range(501)]
    got = ranges.running_sums(spark.createDataFrame(rows, "x long, n long").repartition(7), [F.col("x").desc()], ["n"]).collect()
    total = 0
    for x, n in sorted(rows, reverse=True):
        total += n
        assert next(r.n for r in got if r.x == x) == total
    assert ranges.running_sums(spark.createDataFrame([], "x long, n long"), [F.col("x").asc()], ["n"]).count() == 0


def test_sweeps_equal_plain_loops(spark):
    rng = random.Random(9)
    rows = [(i % 4, i // 9, int(rng.random() < 0.3), round(rng.random(), 2)) for i in range(400)] + [(0, 900, 1, None), (0, 901, None, 0.5), (1, 902, 0, 0.0)]
    marks = [0.0, 0.25, 0.5, 0.5, 0.99, 1.5]
    scored = spark.createDataFrame(rows, "w long, example long, gold long, score double")
    thresholds = spark.createDataFrame([(m,) for m in marks], "threshold double")
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in evaluation.sweep(scored, thresholds).collect()}
    for m in marks:
        c = Counter((g == 1, s >= m) for _, _, g, s in rows if g is not None and s is not None)
        assert got[m] == (c[True, True], c[False, True], c[True, False], c[False, False])
    rows = [r for r in rows if r[2] is not None]
    scored = spark.createDataFrame(rows, "w long, example long, gold long, score double")
    stats = {(r.w, r.relative, r.threshold): r for r in projections.sweep_statistics(scored, thresholds.distinct(), [0.0, 0.7, 1.0], ["w"]).collect()}
    assert len(stats) == 4 * 3 * 5
    for (w, relative, m), r in stats.items():
        examples = {}
        for a, e, g, s in rows:
            if a == w:
                examples.setdefault(e, []).append((g, s))
        n = tp = empty = negative = spared = 0
        for pairs in examples.values():
            best = max((s for _, s in pairs if s is not None), default=None)
            taken = [g for g, s in pairs if s is not None and s >= max(m, best * relative)]
            n, tp, empty = n + len(taken), tp + sum(taken), empty + (not taken)
            if max(g for g, _ in pairs) == 0:
                negative, spared = negative + 1, spared + (not taken)
        assert (r.tp, r.fp, r.empty_rate, r.negative_abstention, r.mean_chunks) == (tp, n - tp, round(empty / len(examples), 6), round(spared / negative, 6) if negative else 0.0, round(n / len(examples), 6))


def test_sweep_rows_dont_multiply(spark, capsys):
    scored = spark.range(1000).selectExpr("id % 50 as example", "id % 2 as gold", "id / 1000.0 as score")
    projections.sweep_statistics(scored, spark.range(100).selectExpr("id / 100.0 as threshold"), 0.5).explain()
    plan = capsys.readouterr().out
    assert plan.count("NestedLoopJoin") <= 1 and "CartesianProduct" not in plan  # only groups meet thresholds, which are the result's rows


def plain_admission(rows, requests, tokens):
    """Tries every microsecond that matters: the earliest at which all rules hold."""
    let, last, out = [], None, {}
    apart = -(-60_000_000 // requests)
    for at, i, n in sorted(rows):
        if n > tokens:
            out[i] = None
            continue
        start = at if last is None else max(at, last + apart)
        for t in sorted({start, *(a + 60_000_000 for a, _ in let)}):
            inside = [k for a, k in let if a > t - 60_000_000]
            if t >= start and len(inside) < requests and sum(inside) + n <= tokens:
                break
        let.append((t, n))
        last = out[i] = t
    return out


def test_admissions_equal_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.randrange(400) * 1_000_000 + rng.randrange(3), rng.choice([1, 5, 40, 90, 120])) for i in range(500)]
    for requests, tokens in ((7, 100), (60, 200), (1, 90)):
        got = limits.admissions(spark.createDataFrame([*rows, (1, 900, None, 3)], "key long, id long, at long, tokens long"), requests, tokens).collect()
        want = {}
        for key in {r[0] for r in rows}:
            want |= plain_admission([(at, i, n) for k, i, at, n in rows if k == key], requests, tokens)
        assert {r.id: r.admitted_at for r in got} == want
        assert all(r.waited == (None if r.admitted_at is None else r.admitted_at - r.at) for r in got)
    assert limits.admissions(spark.createDataFrame([], "key long, id long, at long, tokens long"), 5, 5).count() == 0


def test_best_needles_equal_all_pairs_and_score_few(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(6)) for _ in range(n))
    known = [(c, i, f"n{i}", text(rng.randint(1, 60))) for i, c in enumerate([0] * 40 + [1] * 20)] + [(0, 60, "twin", ""), (1, 61, "none", None)]
    known.append((0, 62, "copy", known[3][3]))
    answers = [(c, j, " ".join(known[j][3].split()[: rng.randint(1, 60)]) if j % 2 else text(20), f"n{j}") for j, c in enumerate([0] * 40 + [1] * 20)]
    answers += [(0, 90, "", "n1"), (0, 91, None, "n1"), (0, 92, "nothing shared", "n1"), (7, 93, "red1", "n1"), (0, 94, known[3][3], None)]
    a = spark.createDataFrame(answers, "corpus long, item_id long, text string, truth string")
    n = spark.createDataFrame(known, "corpus long, place long, name string, text string")
    got = {r.item_id: r for r in needles.best_needles(a, n, ["corpus"]).collect()}
    pairs = 0
    for c, i, t, truth in answers:
        best, name = 0.0, None
        for d, _, k, body in known:
            if c == d:
                pairs += 1
                s = bleu.sentence_bleu(t, body)
                if s > best:
                    best, name = s, k
        assert (got[i].best_target, got[i].best_similarity, got[i].pass_at_1) == (name, round(best, 6), float(name is not None and name == truth and best >= 0.8))
    scored = needles.possible_pairs(a, n, ["corpus"]).count()
    assert len(got) == len(answers) and scored < pairs / 3, (scored, pairs)


def test_bound_is_never_under_bleu(spark):
    rng = random.Random(8)
    rows = [(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))) for _ in range(600)]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("x", needles._words(F.col("a"))).withColumn("y", needles._words(F.col("b")))
    bound = needles.bleu_bound(F.col("x"), F.col("y"), needles._pairs_of(F.col("x")), needles._pairs_of(F.col("y")))
    for r in df.select("a", "b", bound.alias("bound")).collect():
        assert r.bound >= bleu.sentence_bleu(r.a, r.b), r


def test_dense_search_in_blocks_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(12)
    vectors = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)], rng.randrange(3)) for i in range(90)]
    queries = [(100 + i, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(3)]) for i in range(13)]

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 6) if size else 0.0

    want = {q: [d for _, _, d in sorted((-cosine(v, w) + 0.0, -quality, d) for d, v, quality in vectors)][:6] for q, w in queries}
    v = spark.createDataFrame(vectors, "doc_id long, vec array<float>, quality long").repartition(3)
    q = spark.createDataFrame(queries, "item_id long, qvec array<float>").repartition(2)
    for block, most in ((1024, 64 << 20), (7, 64 << 20), (7, 0)):
        monkeypatch.setattr(retrieval, "BLOCK_ROWS", block)
        monkeypatch.setattr(retrieval, "QUESTION_BYTES", most)
        got = retrieval.rank_channel(retrieval.dense_top(v, q, 6), None, 6).collect()
        assert {i: [r.doc_id for r in sorted((r for r in got if r.item_id == i), key=lambda r: r.rank)] for i in want} == want
    assert retrieval.dense_top(v, q.limit(0), 6).count() == 0 and retrieval.dense_top(v.limit(0), q, 6).count() == 0


def test_running_values_by_key_go_on_over_ranges(spark):
    """One key has most rows, some have one, some are null; values of all kinds against plain loops."""
    rng = random.Random(31)
    rows = [(rng.choice([5, 5, 5, 5, 1, 2, 7, 8, None]), i, rng.choice([None, rng.randrange(50)])) for i in range(300)] + [(100 + i, 1000 + i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, t long, v long").repartition(6)
    for how, upto in (("sum", 0), ("max", 0), ("last", 0), ("max", -1), ("sum", -1)):
        got = {r.t: r.out for r in ranges.running_by_key(df, "k", [F.col("t").asc()], how, "v", "out", ["t"], upto).collect()}
        for key in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
            for i, (_, t, _) in enumerate(mine):
                seen = [v for _, _, v in mine[: i + 1 + upto] if v is not None]
                want = sum(seen) if how == "sum" else (max(seen) if how == "max" else seen[-1]) if seen else None
                assert got[t] == want, (how, upto, key, t)
    assert ranges.running_by_key(df.limit(0), "k", [F.col("t").asc()], "sum", "v", "out").count() == 0


def test_places_and_nearest_events_of_a_busy_key(spark):
    rng = random.Random(32)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randrange(400)) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, id long, at long")
    order = {k: [r[1] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], -r[1]))] for k in (1, 2, 3)}
    got = {r.id: (r.key, r.rn) for r in relational.expired(df, ["key"], F.desc("at"), F.desc("id"), keep=3).collect()}
    assert got == {i: (k, n) for k, ids in order.items() for n, i in enumerate(ids, 1) if n > 3}
    events = [(rng.choice([1, 1, 2]), 1000 + i, rng.randrange(400)) for i in range(150)]
    e = spark.createDataFrame(events, "key long, event long, time long")
    before = {r.id: r.event for r in relational.nearest_before(df, e, "key").collect()}
    after = {r.id: r.event for r in relational.nearest_after(df, e, "key").collect()}
    for k, i, at in rows:
        earlier = [(t, n) for c, n, t in events if c == k and t <= at]
        later = [(t, n) for c, n, t in events if c == k and t >= at]
        assert before[i] == (max(earlier)[1] if earlier else None) and after[i] == (min(later)[1] if later else None)


def test_only_small_tables_are_broadcast(spark, monkeypatch, capsys):
    df = spark.createDataFrame([(i, "x" * 100, ["a"]) for i in range(50)], "k long, t string, a array<string>")

    def hinted():
        spark.range(9).withColumnRenamed("id", "k").join(retrieval.small(df), "k").explain("extended")
        return "broadcast" in capsys.readouterr().out.split("Physical Plan")[0].lower()

    assert hinted()
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 4000)
    assert not hinted()
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 49)
    assert not hinted()
