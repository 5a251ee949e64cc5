"""op11, op12 and op13 against their SQL on a small table and against plain Python on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import centroids, divergence, linededup
from corpusloom.llm import queries as llm
from tests.llm.fixtures import empty, odd, odd_rows

SF = "/root/testdata/sf0.001"
NEW = ["op11_source_divergence", "op12_line_runs", "op13_centroid_clusters"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(llm.oracle_sql()[name])
    got = llm.queries()[name](spark, SF).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall()) and got


# op12


def _plain_lines(rows, least=10):
    """(doc_id, n_lines, n_dropped, kept) a row; rows of one id are one document, a null id is above all."""
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    order = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or min(holders[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINES = [
    (5, "Some Repeated Line\nown line of five\n\n\nsome repeated line  "), (3, "  \tSOME repeated LINE\r\nshort\nshort"), (9, "some repeated line"),
    (None, "some repeated line\nonly without id"), (None, "only without id\nonly without id"), (7, "own line of five\nÄRGER in the line\nshort"),
    (8, "ärger in the line\nÄrger in the line\nÄRGER in the line\x0b"), (11, None), (12, ""), (13, "\n\n"), (9, "another row of nine\nsome repeated line"),
    (9, "some repeated line"), (2, "\xa0some repeated line"), (14, "123456789\n123456789\n1234567890"), (15, "123456789\n1234567890"), (1, "x" * 50_000 + "\n" + "y" * 12), (16, "y" * 12 + "\nend"),
    (17, "漢字漢字漢字漢字漢字\nline"), (18, "漢字漢字漢字漢字漢字"), (19, "漢字漢字漢字漢字漢"), (20, "漢字漢字漢字漢字漢"),
]


@pytest.mark.parametrize("batches", [1, 2, 5, 9])
def test_lines_equal_plain_python(spark, batches):
    docs = spark.createDataFrame([(*r, 1, "c") for r in LINES], "doc_id long, text string, n_lines int, dropped string").repartition(3)
    out = linededup.drop_repeated_lines(docs, 10, batches)
    assert out.columns == ["doc_id", "text", "dropped", "n_lines", "n_dropped"]
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect())
    assert got == Counter(_plain_lines(LINES))


def test_lines_of_odd_and_empty_tables(spark):
    got = linededup.drop_repeated_lines(odd(spark)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == Counter(_plain_lines([(r[0], r[1]) for r in odd_rows()]))
    assert linededup.drop_repeated_lines(empty(spark)).count() == 0


def test_runs_are_compacted_and_earlier_batches_win(spark):
    """Seven batches of their own: levels hold what binary counting says, no table is left, and first come keeps a line."""
    before = len(spark.catalog.listTables())
    runs, had = linededup.LineRuns(spark, fanout=2), set()
    for b in range(7):
        rows = [(100 - b, f"line of all batches\nline of batch {b // 2:010d}\nonly in batch {b:010d}")]
        lost = runs.add(linededup.line_hashes(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
        gone = set().union(*(r["dropped"] for r in lost))
        assert gone == {i for i, x in enumerate(rows[0][1].split("\n")) if x in had}
        had |= set(rows[0][1].split("\n"))
        assert [len(level) for level in runs.levels] == [int(d) for d in f"{b + 1:b}"[::-1]]
    assert len(spark.catalog.listTables()) == before + 3
    runs.close()
    assert len(spark.catalog.listTables()) == before


def test_one_line_in_a_third_of_all_rows(spark):
    rows = [(i, ("a very common line\n" if i % 3 else "") + f"line number {i // 2:07d}\ntail {i}") for i in range(3000)]
    got = linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == Counter(_plain_lines(rows))


def test_lines_stay_with_built_in_functions(spark, capsys):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    linededup.kept_digest(linededup.drop_repeated_lines(docs)).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("split(") <= 2 * plan.count("Project")  # the lines of a text are split once, not in the lambda
    assert "lambdafunction(slice(split" not in plan


# op11


def _plain_audit(rows, least=3, top=200):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = {c: c + 32 for c in range(65, 91)}
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        found = term.findall(text.translate(low))
        groups[lang].add(source)
        docs[lang].update(set(found))
        count[lang, source].update(found)
        count[lang].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(key, kept=kept):
            total = sum(count[key][t] for t in kept)
            return {t: 1 + 10**9 * (count[key][t] + 1) // (total + len(kept)) for t in kept}

        q = shares(lang)
        p = {s: shares((lang, s)) for s in sources}
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            own = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", own, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, t, v, i + 1) for i, (t, v) in enumerate(ranked)]
    return out


def test_audit_equals_plain_python(spark):
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "été", "ÉTÉ", "漢字", "don't", "x1y", "[z]", "\x7f", "ß", "ö", "K"]
    rows = [(" ".join(rng.choice(words, 6)) + f" w{i % 40}q", ["en", "de", None][i % 3], f"s{int(rng.integers(4)) if i % 2 else 0}") for i in range(120)]
    rows += [(None, None, None), ("", "fr", "a"), ("solo", "fr", "b"), (None, "fr", None), ("only one", "it", "x"), ("alpha " * 3000, "en", "s9")] + [("same row", "en", "s1")] * 3
    docs = spark.createDataFrame([(t, x, s, 5, "clash") for t, x, s in rows], "text string, lang string, source string, n int, term string")
    for top in (200, 2):
        got = divergence.audit_sources(docs, top=top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == sorted(_plain_audit(rows, top=top))


def test_counts_are_the_same_however_they_are_held(spark):
    text = "Alpha " * 50 + "é" * 90 + ", beta gamma " * 40
    docs = spark.createDataFrame([(text, "en", "a"), (text + "x", "en", "b"), ("alpha", "en", "b"), (None, None, "b")], "text string, lang string, source string")
    whole, told = divergence.term_counts(docs), divergence.term_counts(docs, held=1, long=7)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, told.collect()))
    assert ("en", "b", "alpha", 51, 2) in set(map(tuple, whole.collect()))


def test_shares_beyond_a_long_are_exact(spark):
    n = 9_000_000_000_000_000
    df = spark.createDataFrame([(n, 4 * n, 7), (5, 11, 3), (8_999_999_999, 9 * 10**9, 1)], "n long, total long, kept long")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(divergence._share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (a + 1) // (b + c) for a, b, c in [(n, 4 * n, 7), (5, 11, 3), (8_999_999_999, 9 * 10**9, 1)]]


def test_audit_of_odd_and_empty_tables(spark):
    got = divergence.audit_sources(odd(spark)).collect()
    assert sorted(map(tuple, got)) == sorted(_plain_audit([(r[1], r[2], r[3]) for r in odd_rows()]))
    assert divergence.audit_sources(empty(spark)).count() == 0


# op13


def _plain_clusters(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * x) if abs(x) < 2**900 else 0 for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)
    cents = [v for _, _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    told = [(i, *near(v)[::-1]) for i, v in kept]
    inner = Counter()
    for _, c, d in told:
        inner[c] += d
    clip = lambda x: min(x, 2**63 - 1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, c, clip(d), clip(inner[c]), clip(sum(inner.values())), sha[c]) for i, c, d in told]


def _vectors(kind):
    rng = np.random.default_rng(11)
    rows = [(int(i), rng.normal(0, 0.3, 64).astype(np.float32).tolist()) for i in range(150)]
    if kind == "ties":  # few different vectors: equal distances everywhere
        rows = [(i, [float((i * 7 + j) % 3 - 1) / 64 for j in range(64)]) for i in range(90)]
    if kind == "close":  # large components that differ in the last place of float32
        rows = [(i, [float(900_000 + (i * j) % 3) for j in range(64)]) for i in range(80)]
    if kind == "odd":
        rows += [(500, None), (501, []), (502, [0.5] * 63), (503, [0.5] * 65), (504, [None] + [0.1] * 63), (505, [math.nan] * 64), (506, [math.inf] + [0.0] * 63), (507, [0.0] * 64), (507, [0.0] * 64), (None, [0.25] * 64), (508, [1e30] + [0.0] * 63), (509, [-3e38] * 64)]
    if kind == "few":
        rows = rows[:5]
    return rows


@pytest.mark.parametrize("kind", ["plain", "ties", "close", "odd", "few"])
def test_clusters_equal_plain_python(spark, kind):
    rows = _vectors(kind)
    f32 = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, cluster int, vector string").repartition(5)
    got = sorted(map(str, map(tuple, centroids.cluster(df).collect())))
    assert got == sorted(map(str, _plain_clusters(f32)))


def test_no_vectors_no_rows(spark):
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")).count() == 0


def test_intervals_hold_and_leave_few_open(monkeypatch):
    """Screening never loses the nearest centroid, whatever the size of components."""
    rng = np.random.default_rng(5)
    for size in (3, 1000, 1 << 20, 1 << 26):
        v, c = rng.integers(-size, size + 1, (300, 64)), rng.integers(-size, size + 1, (16, 64))
        c[7] = c[3]
        v[:40] = (c[rng.integers(0, 16, 40)] + c[rng.integers(0, 16, 40)]) // 2  # midpoints: near ties
        exact = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        best, distance = centroids.nearest(v, c)
        assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
