"""What a worker process keeps for encoders goes when it turns to the language model."""

import os
import time

import pyarrow as pa

from corpusloom.llm import kneserney, queries


def test_language_model_frees_encoders_of_its_workers(spark):
    path = queries.tokenizer_file("byte_bpe_50k.json")

    def held(batches, load):
        from corpusloom.llm.tokens import encoder

        for _ in batches:
            if load:
                encoder(path, True).encode(["some words"])
            time.sleep(0.05)
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([encoder.cache_info().currsize])], ["pid", "n"])

    slots = spark.range(0, 24, 1, 24)
    before = {r.pid: r.n for r in slots.mapInArrow(lambda b: held(b, True), "pid long, n long").collect()}
    kneserney._counts(slots.selectExpr("repeat('text ', 100000) as text")).collect()
    after = {r.pid: r.n for r in slots.mapInArrow(lambda b: held(b, False), "pid long, n long").collect()}
    assert set(before.values()) == {1} and set(before) & set(after)
    assert all(n == 0 for pid, n in after.items())
