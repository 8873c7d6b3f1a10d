"""Sets of word shingles as sorted arrays of 64-bit hashes, by whole batches of text."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20)
#: A random value for each byte; the letters A-Z share those of a-z.
BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
BYTES[65:91] = BYTES[97:123]
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
BLOCK = 1 << 17
#: Powers of a base that are kept: those for blocks of usual size.
KEPT = BLOCK + 4096


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the power of 0 to n - 1."""
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]))


@functools.cache
def kept_powers(base: np.uint64) -> np.ndarray:
    return powers(base, KEPT)


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    return kept_powers(base)[:n] if n <= KEPT else powers(base, n)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values, as of ``np.unique``, which hashes first and takes ten times as long."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each word of concatenated texts; ``starts``: where each text begins.

    Words are hashed in blocks that end at white space or a text's end, so memory is that of a block.
    """
    places, hashes = [], []
    at = 0
    begins = np.zeros(len(raw) + 1, bool)
    begins[starts[starts < len(raw)]] = True
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and not (SPACES[raw[end - 1]] or begins[end]):
            end = min(len(raw), end + 4096)
            if end < len(raw) and (near := np.flatnonzero(SPACES[raw[end - 4096 : end]] | begins[end - 4096 : end])).size:
                end = end - 4096 + max(1, int(near[0]))
                if begins[end] or SPACES[raw[end]]:
                    break
        some = raw[at:end]
        solid = ~SPACES.take(some)
        before = np.concatenate([[False], solid[:-1]])
        first = np.flatnonzero(solid & (~before | begins[at:end]))
        after = np.concatenate([solid[1:], [False]])
        cut = begins[at + 1 : end + 1].copy()
        last = np.flatnonzero(solid & (~after | cut))
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(BYTES.take(some) * powers_of(BASE, len(some)), out=sums[1:])
        back = powers_of(BASE_INVERSE, len(some))
        places.append(first + at)
        hashes.append(mix((sums[last + 1] - sums[first]) * back[first] + (last - first + 1).astype(np.uint64)))
        at = end
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (null: none).

    A shingle is ``k`` neighbouring words; a text of fewer words has them all as one, a text without words has none.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    places, words = words_of(raw, offsets[:-1] - offsets[0])
    bounds = np.searchsorted(places, offsets - offsets[0], "left")
    grams = np.zeros(len(words), np.uint64)
    multiplier = 1
    full = max(0, len(words) - k + 1)
    for j in range(k):
        multiplier = multiplier * 0xD6E8FEB86659FD93 % 2**64
        grams[:full] += words[j : j + full] * np.uint64(multiplier)
    grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(distinct(grams[a : b - k + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                short = np.uint64(b - a)
                for w in words[a:b]:
                    short = short * np.uint64(0xD6E8FEB86659FD93) + w
                out.append(mix(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
