"""BM25 in blocks of documents: the ranks of the join of terms, without shuffling pairs of questions and documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import queries as base
from corpusloom import reports
from corpusloom.operators import retrieval as Q

WORDS = [f"w{i}" for i in range(40)]


def _tables(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(WORDS, range(40, 0, -1), k=rng.randrange(30))), rng.choice(WORDS), "ab"[i % 2]) for i in range(300)]
    docs += [(400 + i, "Same W3 text w5, w9", "w1", "a") for i in range(50)] + [(500, None, "w2", "a"), (501, "w1 é_w2", None, "b"), (None, "w1 w2", "w3", "a")]
    asked = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 9)))) for i in range(300)] + [(900, ""), (901, None), (902, "unknown")]
    quality = [(i, i % 3) for i in range(0, 450, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, meta string, lang string").repartition(5)
    return d, spark.createDataFrame(asked, "item_id long, text string"), spark.createDataFrame(quality, "doc_id long, quality long")


def _ranks(df):
    return sorted((r.item_id, r.rank, r.doc_id, round(r.score, 5), r.quality) for r in df.collect())


def test_blocks_rank_as_joined_terms(spark):
    docs, asked, quality = _tables(spark)
    docs = docs.where("doc_id is not null")
    want = _ranks(Q.rank_channel(Q.bm25(docs, asked), quality, 7))
    hits = Q.keyword_top(docs, asked, 7, quality)
    assert len(want) > 2000 and _ranks(Q.rank_channel(hits, None, 7)) == want
    assert hits.count() <= hits.rdd.getNumPartitions() * 7 * asked.count()  # a task gives out the best of a question only
    scope = F.col("lang") == "a"
    want = _ranks(Q.rank_channel(Q.two_field_bm25(docs, asked, 2.0, scope), quality.limit(0), 7))
    assert _ranks(Q.rank_channel(Q.two_field_top(docs, asked, 7, 2.0, docs.where(scope)), None, 7)) == want


def test_many_questions_are_joined(spark, monkeypatch):
    docs, asked, quality = _tables(spark)
    want = [_ranks(Q.rank_channel(x, None, 7)) for x in (Q.keyword_top(docs, asked, 7, quality), Q.two_field_top(docs, asked, 7, 2.0, docs.where("lang = 'b'")))]
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 100)
    docs = docs.where("doc_id is not null").unionByName(docs.where("doc_id is null").withColumn("doc_id", F.lit(777).cast("long")))
    got = [Q.keyword_top(docs, asked, 7, quality), Q.two_field_top(docs, asked, 7, 2.0, docs.where("lang = 'b'"))]
    assert [[x for x in _ranks(Q.rank_channel(g.where("doc_id <> 777"), None, 7))] for g in got] == want


def test_nothing_asked_or_known(spark):
    docs, asked, quality = _tables(spark)
    assert Q.keyword_top(docs, asked.limit(0), 5, quality).count() == 0 and Q.keyword_top(docs.limit(0), asked, 5, quality).count() == 0


@pytest.mark.parametrize("query", [base.r01_bm25_topk, reports.r02_two_field_bm25])
def test_no_pairs_are_shuffled(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(item_id#\d+L?, doc_id", plan)
