"""Malformed media are told, not raised; images are summed in bands; a token is read from its own file alone."""

import os

import numpy as np
import pytest

from corpusloom.llm import dac, media
from corpusloom.llm.queries import tokenizer_file

BROKEN = [
    b"P2\n2 1\n255\n300 1", b"P2\n2 1\n255\n-3 1", b"P5\n99999999999 99999999999\n255\n", b"P4\n99999999999 99999999999\n", b"P6 3 3 255\nabc", b"P5 1 1 0\nx", b"P5 1 1 70000\nxx",
    b"P3 1 1 255\n1 2", b"P1 3 1\n01", b"P2 1 1 9\nx", b"BM", media.encode_bmp(np.zeros((4, 4), np.uint8))[:-3], media.encode_bmp(np.zeros((4, 4), np.uint8))[:18] + b"\xff\xff\xff\x7f" * 2 + b"\x01\0\x08\0" + b"\0" * 24,
]


@pytest.mark.parametrize("data", BROKEN)
def test_malformed_media_have_a_reason(data):
    a, error = media.decoded(data)
    assert a is None and error


def test_malformed_media_do_not_stop_the_others(spark):
    good = media.encode_netpbm(np.arange(64, dtype=np.uint8).reshape(8, 8))
    rows = [(i, d, "c") for i, d in enumerate([*BROKEN, good, None, b""])]
    got = {r.doc_id: r for r in media.media_features(spark.createDataFrame(rows, "doc_id long, media binary, error string")).collect()}
    assert all(got[i].error and got[i].feature is None and got[i].media_bytes == len(d) for i, d in enumerate(BROKEN))
    assert got[len(BROKEN)].error is None and got[len(BROKEN)].feature and got[len(BROKEN) + 1].media_bytes is None and got[len(BROKEN) + 2].error


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (100, 64), (33, 20, 3)])
def test_bands_do_not_change_sums(shape):
    a = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    wanted = np.unique(np.array([0, 1, shape[0] // 2, shape[0]]))
    grey = a.astype(np.float64).mean(axis=2) if a.ndim == 3 else a.astype(np.float64)
    whole = np.zeros((shape[0] + 1, shape[1] + 1))
    whole[1:, 1:] = grey.cumsum(axis=0).cumsum(axis=1)
    for band in (1, 64, 1 << 20):
        assert (media.integral_lines(a, wanted, band) == whole[wanted]).all()


def test_a_token_is_read_from_its_own_file_alone(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(dac, "SEGMENT_TOKENS", 50)
    docs = spark.createDataFrame([(i, f"document number {i} with some words of its own") for i in range(200)], "doc_id long, text string")
    path = dac.write_tokens(docs, tokenizer_file("byte_bpe_50k.json"), 0, path=f"file://{tmp_path}/t")
    index = dac.token_index(spark, path)
    total = index.agg({"n_tokens": "sum"}).first()[0]
    want = {k: dac.read_token(spark, index, k) for k in range(0, total, 97)}
    files = {r.file for r in index.collect()}
    assert len(files) > 1 and len(want) > 10
    for file in files:
        hits = [r for r in index.where(index.file == file).collect()]
        others = [f.removeprefix("file:") for f in files if f != file]
        for f in others:
            os.rename(f, f + ".away")
        for k in want:
            if any(r["first"] <= k < r["first"] + r["n_tokens"] for r in hits):
                assert dac.read_token(spark, index, k) == want[k]
        for f in others:
            os.rename(f + ".away", f)
