"""The encoder finds the parts of narrow texts as columns, with the ids of the unmodified library."""

import numpy as np
import pytest

from corpusloom.llm import queries, tokens

FILE = "byte_bpe_50k.json"


def test_narrow_texts_are_cut_as_columns(monkeypatch):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    letters = [c for c in map(chr, range(32, 256)) if c not in "\x7f\xa0" and not "\x80" <= c <= "\x9f"] + list(" \n\t\r \n'sab1") * 12
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(500)] + ["", " ", "\n", "a", "1", "a" * 60, "", "été  1a\tb's 12x ", ""]
    own, lib = tokens.Encoder(queries.tokenizer_file(FILE), added=True), Tokenizer.from_file(queries.tokenizer_file(FILE))
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    with monkeypatch.context() as m:
        m.setattr(tokens.Encoder, "_parts", lambda self, text: pytest.fail("a narrow text was cut into strings"))
        assert [x.tolist() for x in own.encode(texts)] == want
    mixed = [x for t in texts[:50] for x in (t, t + "漢", t + "\x0b", t + "<|endoftext|>")]
    assert [x.tolist() for x in own.encode(mixed)] == [e.ids for e in lib.encode_batch(mixed, add_special_tokens=False)]
    assert own.encode([]) == []


def test_kept_parts_may_change_generation(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 3)
    own, whole = tokens.Encoder(queries.tokenizer_file(FILE)), tokens.Encoder(queries.tokenizer_file(FILE))
    for texts in (["one two three four five"], ["one six", "six one 漢 two"], ["seven"], ["one two three four five six seven 漢"]):
        assert [x.tobytes() for x in own.encode(texts)] == whole._whole(texts)
