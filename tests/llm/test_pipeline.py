import os
import random

import corpus_pipeline
from tests.llm.fixtures import empty, odd, odd_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_in_order_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "repeat_removal", "decontamination", "packing"]
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    kinds = dict(docs.dtypes)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        seen.append(docs.count())
        if name != "packing":
            assert dict(docs.dtypes) == kinds
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0 < seen[4]


def test_stages_stand_odd_rows(spark):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "odd")
    assert 0 < docs.count() <= 10 * len(odd_rows())


def test_stages_of_an_empty_table(spark):
    docs = empty(spark).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_what_stages_keep(spark):
    """The rows of three stages by plain Python: near copies, repeats and leaks planted in a small table."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    passage, base = " ".join(text(12)), text(60)
    near = [*base[:30], word(), *base[31:]]
    rows = [(i, " ".join(text(40))) for i in range(10)]
    rows += [(20, " ".join(base)), (21, " ".join(near)), (22, " ".join(base)), (22, " ".join(base)), (30, "a \ufffd " + passage), (31, passage + " b \ufffd c")]
    rows += [(40, " ".join(text(10)) + " " + items[0] + " " + " ".join(text(10))), (10, rows[0][1]), (3, rows[3][1]), (50, None), (51, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(10), 20, 30, 31, 40, 50, 51]
    left = {r.doc_id: r for r in corpus_pipeline.repeat_removal(spark, kept, SF).collect()}
    assert left[30].text == "a \ufffd " + passage and left[31].text == " b \ufffd c" and left[31].n_chars == 6
    assert left[50].text == left[51].text == "" and all(left[d].text == dict(rows)[d] for d in (*range(10), 20, 40))
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, kept, SF).collect()}
    assert clean == {*range(10), 20, 30, 31, 50, 51}
    pieces = corpus_pipeline.packed(spark, kept, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept.collect()}


def test_stages_stand_columns_of_their_own_names(spark):
    docs = odd(spark)
    for c in ("_kept", "_n", "_bad", "kept", "n_removed", "rejected", "perplexity"):
        docs = docs.withColumn(c, corpus_pipeline.F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        assert corpus_pipeline.materialize(stage(spark, docs, SF), name).count() > 0
    from corpusloom.llm import decontaminate

    assert decontaminate.clean(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).columns == docs.columns
