"""Records, runs and contexts by hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation, records


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_profile_sizes_and_key():
    p = records.Profile(input_tokens=2000, target=1500, margin=0.25)
    assert (p.budget, p.options.most) == (1500, 1050) and records.Profile().options.most == 1024
    assert records.Profile(input_tokens=100).options.most == 128
    assert p.key == records.Profile(input_tokens=2000, target=1500, margin=0.25).key != records.Profile().key and p.key.startswith("v1:") and len(p.key) == 19


def test_kinds(spark):
    cases = {
        "Import_Statement": "import", "using_directive": "import", "export_statement": "export", "protocol_declaration": "interface", "struct_item": "class", "enum_item": "enum",
        "type_alias_declaration": "type", "constructor_declaration": "class", "method_definition": "method", "function_definition": "function", "function_declarator": None, "function_call": None, "block": None,
    }
    assert values(spark, records.syntax_kind(F.col("t")), [(k,) for k in cases], "t string") == list(cases.values())
    tags = {"definition.method": "method", "definition.macro": "function", "definition.Namespace": "class", "definition.trait": "interface", "definition.enum": "enum", "definition.constant": "type", "definition.other": None}
    assert values(spark, records.tagged_kind(F.col("t")), [(k,) for k in tags], "t string") == list(tags.values())


def test_entities_of_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 30), (2, 0, 0, 5)], "doc_id long, chunk_index long, byte_start long, byte_end long")
    found = spark.createDataFrame([(1, 0, "a", "class", 0, 12), (1, 1, "b", "type", 10, 30), (1, 2, "c", "type", 29, 31), (2, 0, "d", "enum", 4, 5)], "doc_id long, number long, name string, kind string, byte_start long, byte_end long")
    got = {(r.doc_id, r.name): (r.chunk_index, r.partial) for r in records.chunk_entities(chunks, found).collect()}
    assert got == {(1, "a"): (0, True), (1, "b"): (1, False), (1, "c"): (1, True), (2, "d"): (0, False)}


def test_small_columns(spark):
    checks = records.completeness({"path": F.col("p") != "", "language": F.col("l").isNotNull(), "scope": F.col("s")})
    got = values(spark, checks, [("a", "x", True), ("", None, None), (None, "x", False)], "p string, l string, s boolean")
    assert [tuple(g) for g in got] == [(1.0, []), (0.0, ["path", "language", "scope"]), (0.33, ["path", "scope"])]
    assert values(spark, records.mock_embedding(F.col("t"), 2), [("abc",), (None,)], "t string") == [[3.0, 0.0], [0.0, 0.0]]
    assert values(spark, records.mock_embedding(F.col("t"), 5), [("é",)], "t string") == [[1.0, 0.0, 1.0, 0.0, 0.0]]
    assert values(spark, records.reference_spans(F.col("s")), [([" a ", "", "b"],), ([],), (None,)], "s array<string>") == [["a", "b"], ["N/A"], ["N/A"]]
    asked = spark.createDataFrame([("q",), (" ",), (None,), ("x" * 9,)], "text string")
    assert [r.text for r in records.askable(asked, 8).collect()] == ["q"]


def test_payloads(spark):
    inputs = spark.createDataFrame([("a", "text", "p", "old"), ("b", None, "q", "old")], "id string, text string, path string, model_id string")
    got = {r.id: r for r in records.vector_records(inputs, "m", 3).collect()}
    assert got["a"].payload.path == "p" and got["a"].payload.model_id == "m" and got["a"].payload.dimension == 3 and len(got["b"].content_hash) == 64
    one = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n long, t string")
    two = spark.createDataFrame([("b", "z", True), ("c", None, None)], "id string, t string, flag boolean")
    rows = sorted(map(tuple, records.merged_payloads(one, two, ["id"]).collect()))
    assert rows == [("a", 1, "x", None), ("b", 2, "z", True), ("c", None, None, None)]


def test_contexts_are_cut_at_the_budget(spark):
    rows = [(1, 1, "a", 1, 2, "x" * 10), (1, 2, None, None, None, "y" * 50), (1, 3, "c", 1, 1, "never"), (2, 1, "d", 3, 3, None)]
    got = {r.item_id: (r.pieces, r.context) for r in records.retrieval_contexts(spark.createDataFrame(rows, "item_id long, number long, path string, start_line long, end_line long, text string"), 70).collect()}
    first, second = "// Path: a (lines 1-2)\n" + "x" * 10, "// Path: unknown (lines ?-?)\n" + "y" * 50
    assert got == {1: (2, first + "\n\n" + second[: 70 - len(first)]), 2: (1, "// Path: d (lines 3-3)\n")}


def test_needles(spark, tmp_path):
    repo = {"repo": "o/r", "commit_sha": "c", "content": {"f.py": "l0\nl1\r\nl2\nl3"}, "needles": [{"name": "n", "path": "f.py", "start_line": 1, "end_line": 3, "description": "d"}, {"name": "gone", "path": "no.py", "start_line": 0, "end_line": 1, "description": "d"}]}
    schema = "language string, repository struct<repo string, commit_sha string, content map<string,string>, needles array<struct<name string, path string, start_line long, end_line long, description string>>>"
    (tmp_path / "r.json").write_text(json.dumps({"language": "python", "repository": repo}))
    got = [(r.language, r.repo, r.name, r.function) for r in records.needles_of(spark.read.schema(schema).json(str(tmp_path))).collect()]
    assert got == [("python", "o/r", "n", "l1\nl2"), ("python", "o/r", "gone", None)]


def run_file(i, **more):
    base = {"id": f"r{i}", "created_at": f"2024-01-0{i}", "status": "failed", "error": "e", "request": {"seed": "7", "limit": 3}}
    examples = [{"index": 0, "candidate_answer": "a", "scores": {"s": 1.0}}, {"index": 1, "raw_response": "b"}, {"index": 2, "candidate_answer": "", "raw_response": ""}]
    return base | {"result": {"retrieval": {"k": "60"}, "dataset": {"sample_fingerprint": "f"}, "examples": examples}} | more


def test_runs(spark, tmp_path):
    full = [{"index": i, "scores": {"s": 0.0}} for i in range(3)]
    runs = [run_file(1), run_file(2, status="running"), run_file(3, result=None), run_file(4, result={"retrieval": {"k": "60"}, "examples": []}), run_file(5, result={"retrieval": {"k": "59"}, "dataset": {"sample_fingerprint": "f"}}),
            run_file(6, result={"retrieval": {"k": "60"}, "dataset": {"sample_fingerprint": "f"}, "examples": full}), run_file(7, result={"dataset": {"sample_fingerprint": "f"}, "retrieval": {}}), run_file(8, status=None)]
    for r in runs:
        (tmp_path / f"{r['id']}.json").write_text(json.dumps(r, indent=1))
    df = records.read_runs(spark, str(tmp_path))
    told = {r.id: r for r in df.withColumn("problem", records.retry_problem({"k": "60"})).orderBy(F.desc("created_at")).collect()}
    assert list(told) == [f"r{i}" for i in range(8, 0, -1)]
    assert [told[f"r{i}"].problem for i in range(1, 9)] == [None, "not finished with missing examples", "no saved sample", "no sample fingerprint", "retrieval settings changed", "no failed examples", "older than retrieval", "not finished with missing examples"]
    mended = [(e.candidate_answer, e.raw_response, e.response_status) for e in told["r1"].result.examples]
    assert mended == [("a", "a", None), ("b", "b", None), ("", "", "empty_legacy_response")]
    after = {r.id: (r.status, r.error) for r in records.cancelled(df).collect()}
    assert after["r2"] == ("cancelled", None) and after["r1"] == ("failed", "e")
    sample = spark.createDataFrame([("r1", i, "x") for i in range(3)] + [("r6", 0, "x"), ("r3", 0, "x")], "run_id string, index long, text string")
    assert sorted((r.run_id, r["index"]) for r in records.unanswered(sample, df).collect()) == [("r1", 1), ("r1", 2), ("r3", 0)]


@pytest.mark.parametrize("hits", [[], [(1, 5), (1, 5), (1, 6), (2, 1)]])
def test_relevance_of_examples(spark, hits):
    gold = spark.createDataFrame([(1, 5, 1), (1, 6, 0), (1, 7, 1), (2, 1, 0), (3, 1, 1)], "corpus long, doc_id long, gold int")
    got = {r.corpus: (r.tp, r.fp, r.fn, r.tn) for r in evaluation.example_relevance(gold, spark.createDataFrame(hits, "corpus long, doc_id long"), spark.createDataFrame([(1,), (2,), (2,)], "corpus long"), ["corpus"]).collect()}
    assert got == ({1: (1, 1, 1, 0), 2: (0, 1, 0, 0)} if hits else {1: (0, 0, 2, 1), 2: (0, 0, 0, 1)})
