"""Scopes, cascades, queues and counts over hand-made rows with nulls, repeats and empty tables."""

from pyspark.sql import functions as F

from corpusloom.operators import chunking, lineage, projections, relational, sourcecode
from corpusloom.sources import snapshots


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scopes_and_chains(spark):
    chunks = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, None)], "chunk long, file long")
    files = spark.createDataFrame([(10, 7), (11, 8), (12, None)], "fid long, repo long")
    members = spark.createDataFrame([(7,)], "rid long")
    assert rows(lineage.scoped(chunks, files, members, ("file", "fid"), ("repo", "rid")).select("chunk")) == [(1,), (2,)]
    chain = lineage.chained(chunks, (files, "file", "fid"), (members.withColumnRenamed("rid", "r"), "repo", "r"))
    assert rows(chain.select("chunk", "repo")) == [(1, 7), (2, 7)]
    assert rows(lineage.chained(chunks, (files, "file", "fid"), how="left_semi")) == [(1, 10), (2, 10), (3, 11)]
    assert rows(lineage.chained(members)) == [(7,)]


def test_cascade_keeps_what_does_not_hang_on_the_root(spark):
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 9), (4, None)], "a long, root long")
    b = spark.createDataFrame([(10, 1), (11, 3), (12, None), (13, 2)], "b long, pa long")
    c = spark.createDataFrame([(100, 10), (101, 11), (102, 12), (103, None)], "c long, pb long")
    left = lineage.cascade(spark.createDataFrame([(0,), (0,)], "k long"), (a, "root", "a"), (b, "pa", "b"), (c, "pb", "c"))
    assert [rows(x) for x in left] == [[(3, 9), (4, None)], [(11, 3), (12, None)], [(101, 11), (102, 12), (103, None)]]
    none = lineage.cascade(spark.createDataFrame([], "k long"), (a, "root", "a"))
    assert rows(none[0]) == rows(a)


def test_queues(spark):
    jobs = spark.createDataFrame([(1, "queued", None, 2), (2, "queued", 50, 0), (3, "queued", 51, 0), (4, "failed", 7, 3), (5, None, None, 1)], "id long, status string, lease_expires_at long, attempt_count long")
    assert sorted(r.id for r in lineage.due(jobs, F.lit(50)).collect()) == [1, 2]
    assert [(r.id, r.status, r.attempt_count, r.lease_expires_at) for r in lineage.requeued_failed(jobs).collect()] == [(4, "queued", 0, None)]
    have, want = spark.createDataFrame([("a",), (None,)], "k string"), spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert rows(lineage.ensured(want, have, "k")) == [("b", "queued")] and rows(lineage.to_remove(want, have, "k")) == [("b",)]
    events = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z")], "k string, n long, kind string")
    assert rows(lineage.last_outcomes(want, events, "k", "n", "kind")) == [("a", "y"), ("b", "missing")]


def test_counts(spark):
    d = spark.createDataFrame([("x", "k", 1, 1.0), ("x", "k", 2, None), ("x", "j", 3, 0.0), ("y", None, 4, None)], "g string, k string, n long, s double")
    assert rows(lineage.mean_pass(d, "s", "g")) == [("x", 0.5, 2), ("y", 0.0, 0)]
    assert rows(lineage.run_summary(d, F.col("n") > 2, F.col("s").isNotNull(), "g")) == [("x", 3, 1, 2), ("y", 1, 1, 0)]
    assert {r.g: r.sums for r in lineage.sums_by_key(d, "g", "k", "n").collect()} == {"x": {"j": 3, "k": 3}}
    assert rows(lineage.group_counters(d, "g", "k")) == [("x", 3, 2), ("y", 1, 0)]
    assert rows(lineage.retry_after(d, "g", F.col("n") >= 3, F.col("s"))) == [("x", 0.0), ("y", 0.0)]
    assert rows(lineage.retry_after(d, "g", F.col("n") == 1, F.col("s"))) == [("x", 1.0), ("y", 0.0)]
    assert lineage.mean_pass(d.limit(0), "s", "g").count() == 0


def test_routes_grades_fingerprints_and_blocks(spark):
    sizes = spark.createDataFrame([(0,), (10,), (99,), (100,), (None,)], "n long")
    assert [r[0] for r in sizes.select(snapshots.route(F.col("n"), 10, 99)).collect()] == ["ordinary", "large", "large", "too_large", "ordinary"]
    assert [r[0] for r in sizes.select(projections.grade_of(F.col("n"), 5, 50, 100)).collect()] == ["D", "C", "B", "A", "A"]
    facts = spark.createDataFrame([("p", "s", 3, "l"), ("p", "s", 3, "m")], "path string, sha string, size long, lang string")
    prints = [r[0] for r in facts.select(projections.file_fingerprint(F.col("path"), F.col("sha"), F.col("size"), F.col("lang"), F.struct(F.lit(1).alias("max")), 2)).collect()]
    assert len(set(prints)) == 2 and all(len(x) == 64 for x in prints)
    docs = spark.createDataFrame([(1, "a\n\nb", "p"), (2, None, "p"), (3, "", "q")], "doc_id long, text string, path string")
    assert [(r.doc_id, r.block, r.line) for r in chunking.line_blocks(docs, "path").orderBy("doc_id", "block").collect()] == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (3, 0, "")]


def test_synchronized_dimensions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, name string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "c")], "id long, name string")
    assert rows(relational.synchronized(old, new, ["id"])) == sorted([(2, "B", True), (3, "c", True), (1, "a", False), (None, "n", False)], key=str)
    assert rows(relational.synchronized(old.limit(0), new, ["id"])) == [(2, "B", True), (3, "c", True)]


def test_imports_and_entities_of_files(spark):
    text = 'import "os"\nfrom x import y\ndef os_path(os):\nclass from_x\nuse Thing\n'
    files = spark.createDataFrame([(1, text), (2, 'include <os>\n'), (3, None)], "doc_id long, text string")
    found = sourcecode.file_imports(files)
    assert rows(found) == [(1, 0, "os"), (1, 1, "from x import y"), (1, 2, "use Thing"), (2, 0, "os")]
    assert rows(sourcecode.marked_imports(found, sourcecode.file_entities(files))) == [(1, 0, "os", True), (1, 1, "from x import y", False), (1, 2, "use Thing", False), (2, 0, "os", False)]
    walked = spark.createDataFrame([(1, "class", 0, 9, "w"), (1, "type", 0, 9, "w"), (2, "class", 0, 9, "w")], "doc_id long, kind string, byte_start long, byte_end long, name string")
    tagged = spark.createDataFrame([("t", 1, "class", 0, 9)], "name string, doc_id long, kind string, byte_start long, byte_end long")
    assert rows(sourcecode.united_entities(tagged, walked)) == sorted([("t", 1, "class", 0, 9), ("w", 1, "type", 0, 9), ("w", 2, "class", 0, 9)], key=str)
