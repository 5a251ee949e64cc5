"""Token ids of texts by a public tokenizer file, with ids of recurring words kept per worker process.

Both kinds of vocabulary split a text before white space and never join across it, so a text's ids are the ids of its
parts in order. Texts with a separator on which Python and the tokenizer may disagree, or with an added token, go whole.
"""

from __future__ import annotations

import ctypes
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa

#: Parts kept per worker and generation, and the longest part that is kept. Only memory and speed depend on them.
KEPT, LONGEST = 400_000, 48
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"  # all letters up to U+00FF
_FINE_WORDS = re.compile(rf"[^{_LETTERS} \n\t\r\x0b\x0c\x85\xa0]*[{_LETTERS}]+|[^{_LETTERS} \n\t\r\x0b\x0c\x85\xa0]+")
_PARTS = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_ODD_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_CONTROL = re.compile(r"[\x1c-\x1f]")
_WIDE = re.compile(r"[^\x00-\xff]")
_LEAD = re.compile(r"[\x00-\x40\x5b-\x60\x7b-\x7f]*")  # ASCII without letters: characters with no other case
_ODD_BYTES = b"\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"  # _ODD_SPACE up to U+00FF
_IS_LETTER = np.array([bool(re.match(f"[{_LETTERS}]", chr(i))) for i in range(256)])
_IS_SPACE = np.array([chr(i) in " \n\t\r" for i in range(256)])


class Encoder:
    """encode(texts) gives one uint32 array of ids for each text, as tokenizers' encode_batch(add_special_tokens=False).

    With ``added`` the library is as its file leaves it: the file's added tokens (<|endoftext|>) standing in a text are
    one id each, and texts that hold one go whole. Without, encode_special_tokens is set: they are text like any other.

    Parts end before white space, and in texts up to U+00FF also behind a run of letters: neither vocabulary joins
    across such a place. Kept parts have two generations, so that recurring ones stay and rare ones go.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        # A file may look for a token in the normalized text, so case is left aside: a text too many going whole is right as well.
        self.added = re.compile("|".join(map(re.escape, names)), re.IGNORECASE) if names else None
        self.leads = {_LEAD.match(n)[0] for n in names}  # a text without any of these holds no added token
        self.drops_space = "</w>" in (self.tokenizer.model.end_of_word_suffix or "")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _holds_added(self, text: str) -> bool:
        return bool(self.added and any(x in text for x in self.leads) and self.added.search(text))

    def _parts(self, text: str) -> list[str]:
        if self._holds_added(text):
            return [text]
        if self.drops_space:
            if _ODD_CONTROL.search(text):
                return [text]
            return text.split() if _WIDE.search(text) else _FINE_WORDS.findall(text.lower())
        return [text] if _ODD_SPACE.search(text) else _PARTS.findall(text)

    def _narrow(self, text: str) -> bytes | None:
        """The text's characters as bytes, where all are up to U+00FF and parts can be found among those."""
        try:
            out = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        odd = self.drops_space or len(out.translate(None, _ODD_BYTES)) < len(out) or self._holds_added(text)
        return None if odd else out

    def _values(self, parts: list[str | bytes]) -> list[bytes]:
        """The ids of different parts, from those kept or from the library. Bytes are characters up to U+00FF."""
        out = list(map(self.young.get, parts))
        new, missing = {}, []
        for i in [i for i, v in enumerate(out) if v is None]:
            if (v := self.old.get(parts[i])) is None:
                missing.append(i)
            else:
                out[i] = new[parts[i]] = v
        order = [p if isinstance(p, str) else p.decode("latin-1") for p in map(parts.__getitem__, missing)]
        for i, v in zip(missing, self._whole(order), strict=True):
            out[i] = v
            if len(parts[i]) <= LONGEST:
                new[parts[i]] = v
        if len(self.young) + len(new) > KEPT:
            self.young, self.old = {}, self.young
        self.young.update(new)
        return out

    def _listed(self, texts: list[str]) -> list[np.ndarray]:
        split = [self._parts(t) for t in texts]
        parts = list(set().union(*split))
        get = dict(zip(parts, self._values(parts), strict=True)).__getitem__
        return [np.frombuffer(b"".join(map(get, x)), np.uint32) for x in split]

    def _ragged(self, texts: list[bytes]) -> list[np.ndarray]:
        """As _listed, for texts from _narrow: their parts are found and told apart as columns, without an object for each."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        letter, space = _IS_LETTER[data], _IS_SPACE[data]
        first = np.zeros(data.size, bool)
        first[1:] = (letter[:-1] & ~letter[1:]) | (space[1:] & ~space[:-1])
        first[(ends - size)[size > 0]] = True
        at = np.append(np.flatnonzero(first), data.size).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), at.size - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        values, code = self._values(parts.dictionary.to_pylist()), parts.indices.to_numpy()
        flat, n = np.frombuffer(b"".join(values), np.uint32), np.fromiter(map(len, values), np.int64, len(values)) // 4
        start, own = (np.cumsum(n) - n)[code], n[code]
        done = np.concatenate([[0], np.cumsum(own)])
        ids = flat[np.arange(done[-1]) + np.repeat(start - done[:-1], own)]
        edges = done[np.searchsorted(at[:-1], ends)]
        return np.split(ids, edges[:-1]) if texts else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        narrow = [self._narrow(t) for t in texts]
        ragged = iter(self._ragged([b for b in narrow if b is not None]))
        listed = iter(self._listed([t for t, b in zip(texts, narrow, strict=True) if b is None]))
        return [next(listed if b is None else ragged) for b in narrow]


@cache
def encoder(path: str, added: bool = False) -> Encoder:
    """One Encoder for each file, way and worker process; the library's own threads stay off, as Spark deals the work."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, added)


def forget() -> None:
    """Gives back what this worker process keeps for encoders; operators that need none begin their tasks with it.

    Spark hands workers on from one query to the next, and an encoder's words take some 250 MB of each.
    """
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # else glibc keeps about half of it
            trim(0)
