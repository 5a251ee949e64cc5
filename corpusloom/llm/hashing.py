"""Vectorized 64-bit hashes of bytes, words and word shingles over Arrow buffers."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEEDS = np.random.default_rng(20240607)
_BYTE = _SEEDS.integers(0, 1 << 64, 256, dtype=_U)
_LANES = _SEEDS.integers(0, 1 << 64, 64, dtype=_U) | _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each input bit changes each output bit about half the time."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & (2**64 - 1), _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def prefix(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes of any stretch: sums of byte values times powers, and the inverse powers."""
    sums = np.zeros(raw.size + 1, _U)
    np.cumsum(_BYTE[raw] * powers(raw.size, _BASE), out=sums[1:])
    return sums, powers(raw.size + 1, _INVERSE)


def stretches(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _LANES[0])


#: Longer words are hashed by a digest: sums modulo 2**64 can be made to agree for long regular strings.
LONG_WORD = 64


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of the stretches; another lane gives independent ones."""
    if lane:
        keyed = mix(_BYTE + _U(lane))
        sums = np.zeros(raw.size + 1, _U)
        np.cumsum(keyed[raw] * powers(raw.size, _BASE + 2 * lane), out=sums[1:])
        h = stretches(sums, powers(raw.size + 1, pow(_BASE + 2 * lane, -1, 1 << 64)), starts, ends)
    else:
        h = stretches(*prefix(raw), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        digest = hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest()
        h[i] = np.frombuffer(digest, _U)[0]
    return h


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of each text, and the place in them where each text's words begin."""
    inside = ~SPACE[raw]
    before = np.zeros(raw.size, bool)
    before[1:] = inside[:-1]
    first = offs[:-1][np.diff(offs) > 0]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(raw.size, bool)
    after[:-1] = inside[1:]
    last = offs[1:][np.diff(offs) > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def shingles(raw: np.ndarray, offs: np.ndarray, size: int, lanes: int = 1) -> tuple[np.ndarray, ...]:
    """Distinct hashes of each text's word shingles, sorted, and the offsets of each text's.

    A-Z count as a-z. A text with fewer words than size has its whole sequence as one; a text without words has none.
    With two lanes there are second hashes too, independent of the first and in their order: (first, second, offsets).
    """
    low = LOWER[raw]
    starts, ends, at = words(low, offs)
    if not starts.size:
        return (*[np.zeros(0, _U)] * lanes, np.zeros(offs.size, np.int64))
    n_words = np.diff(at)
    doc = np.repeat(np.arange(n_words.size), n_words)
    left = at[1:][doc] - np.arange(starts.size)  # words from this one to the text's end
    whole = np.minimum(n_words, size)[doc]
    begins = left >= whole
    values, owner = [], doc[begins]
    for lane in range(lanes):
        padded = np.concatenate([word_hashes(low, starts, ends, lane), np.zeros(size, _U)])
        total = np.zeros(starts.size, _U)
        for k in range(size):
            total += np.where(k < whole, padded[k : k + starts.size] * _LANES[k + 1], _U(0))
        values.append(mix(total[begins] + whole[begins].astype(_U)))
    order = np.lexsort((*values[::-1], owner))
    values, owner = [v[order] for v in values], owner[order]
    new = np.ones(owner.size, bool)
    new[1:] = owner[1:] != owner[:-1]
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    values, owner = [v[new] for v in values], owner[new]
    return (*values, np.searchsorted(owner, np.arange(n_words.size + 1)))
