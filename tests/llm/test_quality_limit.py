"""The limit of a language is the quantile of its trusted documents that weren't trained on, no further out."""

import math
import random

from pyspark.sql import functions as F

from corpusloom.llm import kneserney
from tests.llm.fixtures import SCHEMA


def test_limit_is_the_held_out_quantile(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice(["ba", "ko", "ri", "tu", "ne"]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = []
    for i in range(600):  # trusted texts hold more or less of odd signs
        odd = rng.random() ** 6
        rows.append((i, " ".join("#%&!"[i % 4 :] if rng.random() < odd else rng.choice(words) for _ in range(60)), "xx", "s", 1, 1, "x"))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    for quantile in (0.5, 0.9, 0.99):
        got = kneserney.classify(docs, kneserney.fit(docs, labels, quantile)).where(held).orderBy("judged").collect()
        want = got[math.ceil(quantile * len(got)) - 1].judged
        assert len(got) > 50 and all(math.isclose(r.limit, want, rel_tol=1e-9) for r in got)
        assert sum(r.rejected for r in got) <= len(got) - math.ceil(quantile * len(got)) + 1
