"""Words of many texts at once: byte classes, word bounds and 64-bit word hashes, in numpy.

Texts are UTF-8 bytes.  Both word rules of the corpus operators cut at ASCII bytes only, so
bytes and code points give the same words.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(0x5EED)
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
_INVERSE = np.uint64(pow(int(_MIX), -1, 1 << 64))
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHARD_BYTES = 2 << 20

# Byte tables: 0 between words, else the byte with A-Z in lower case.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
ALNUM = _LOWER.copy()  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lowering
ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0
GRAPH = _LOWER.copy()  # words [^\x20\x09-\x0D]+ after lowering; the zero byte has a place of its own
GRAPH[[0x20, *range(0x09, 0x0E)]] = 0
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in ((0, _MIX), (1, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def scramble(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one to one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """S with ``(S[e] - S[s]) * inverse**s`` the hash of ``codes[s:e]``; codes are uint64."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(sums))[1]
    return scramble((sums[end] - sums[start]) * inverse[start])


def shards(texts: list[bytes], limit: int = SHARD_BYTES) -> list[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a shard of its own."""
    out, start, size = [], 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            out.append((start, k))
            start, size = k, 0
        size += len(t)
    if texts:
        out.append((start, len(texts)))
    return out


class Words:
    """The words of a list of texts: text number, byte bounds within the text, and hash."""

    def __init__(self, texts: list[bytes], rule: np.ndarray):
        gap = b" "  # no word goes on in the next text
        data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
        kept = rule[data]
        inside = kept != 0
        if rule is GRAPH:
            inside |= data == 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = span_hash(prefix_hash(_LETTER[kept]), self.start, self.end)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.base = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])  # where each text begins
        self.doc = np.searchsorted(self.base, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # first word of each text
        self.texts = len(texts)
