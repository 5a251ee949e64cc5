"""op3, op6 and the pipeline's packing give what an unmodified Tokenizer.from_file gives, also for added tokens in texts."""

import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

import corpus_pipeline
from corpusloom.llm import queries
from corpusloom.llm.tokens import Encoder
from tests.llm.fixtures import SCHEMA, odd_rows

PIECES = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "a", " b", "\n", "  ", "S", "é", "漢", "̸", "\xa0", "\x1c", "1's"]
TEXTS = ["a b<|endoftext|> c", "x <|startoftext|>\n\ny", "<|endoftext|>", "A <|ENDOFTEXT|>b", "été <|endoftext|≯ 漢", "no token"]


def ids_of(name, text, end):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_file(name))
    return np.array([*lib.encode(text, add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_unmodified_library(name):
    from tokenizers import Tokenizer

    own, lib = Encoder(queries.tokenizer_file(name), added=True), Tokenizer.from_file(queries.tokenizer_file(name))

    @given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), max_size=4))
    def same(texts):
        for got, want in zip(own.encode(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert got.tolist() == want.ids

    same()
    texts = TEXTS + [r[1] or "" for r in odd_rows()]
    for got, want in zip(own.encode(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


def test_queries_equal_unmodified_library(spark, tmp_path):
    rows = [(i, t, "en", "s", None, 7, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    start = 0
    want = []
    for i, t in enumerate(TEXTS):
        ids = ids_of("byte_bpe_50k.json", t, 0)
        want.append((i, start, ids.size, zlib.crc32(ids.tobytes())))
        start += ids.size
    got = queries.op6_token_codes(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    for out in (queries.op3_tier_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        for r in out.collect():
            ids = ids_of("word_bpe_49k.json", TEXTS[r.doc_id], 1)
            assert r.doc_tokens == ids.size
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
