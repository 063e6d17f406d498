"""Portable md5-based draws.

``xxhash64`` and ``rand(seed)`` differ between engines; md5 of a ``|``-joined
key is identical in Spark and DuckDB, so every random choice in the library
is a function of ``md5(seed|key...)``.  Equivalent DuckDB expressions are
given in the docstrings and used by the oracle SQL.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def hash_key(seed, *cols) -> Column:
    """``concat_ws('|', seed, cols...)``."""
    return F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in cols])


def md5_key(seed, *cols) -> Column:
    """Hex md5 of the key; sorting by it is a seeded permutation."""
    return F.md5(hash_key(seed, *cols))


def hash32(seed, *cols) -> Column:
    """First 32 bits of md5 as a long.

    DuckDB: ``('0x' || substr(md5(concat_ws('|', seed, ...)), 1, 8))::BIGINT``.
    """
    return F.conv(F.substring(md5_key(seed, *cols), 1, 8), 16, 10).cast("long")


def hash60(seed, *cols) -> Column:
    """First 60 bits of md5 as a long; monotone with the md5 hex order."""
    return F.conv(F.substring(md5_key(seed, *cols), 1, 15), 16, 10).cast("long")


def uniform(seed, *cols) -> Column:
    """Draw in [0, 1): ``hash32 / 2**32``."""
    return hash32(seed, *cols) / F.lit(TWO32)


def order_cols(seed, key_cols, *extra) -> list[Column]:
    """Total order for a seeded permutation: (hash60, md5, key...)."""
    keys = [_c(k) for k in key_cols]
    return [hash60(seed, *extra, *keys), md5_key(seed, *extra, *keys), *keys]


_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
MD5_ROWS = 1 << 14  # hashed at once, so that the arrays stay in the cache
MAX_KEY = 55  # bytes; a longer key has more than one block


def _md5_first(words: list[np.ndarray | None]) -> np.ndarray:
    """First word of the md5 of one-block messages, given as 16 arrays of words (None: zeros)."""
    n = len(words[0])
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for k in range(64):
        if k < 16:
            f, g = d ^ (b & (c ^ d)), k
        elif k < 32:
            f, g = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif k < 48:
            f, g = b ^ c ^ d, (3 * k + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * k % 16
        f += a
        f += np.uint32(_SINES[k])
        if words[g] is not None:
            f += words[g]
        turn = _TURNS[k // 16][k % 4]
        high = f << np.uint32(turn)
        f >>= np.uint32(32 - turn)
        high |= f
        high += b
        a, b, c, d = d, high, b, c
    return a + np.uint32(0x67452301)


def uniform_places(seed, keys: list, counts: list[int]) -> np.ndarray:
    """``uniform(seed, key, place)`` for the places 0 .. count - 1 of each key, one after another.

    For draws per token: the columns of ``uniform`` make and parse several strings for each.
    """
    heads = [(f"{seed}|" if key is None else f"{seed}|{key}|").encode() for key in keys]
    head = np.array([len(h) for h in heads])
    if len(heads) and head.max() + 10 > MAX_KEY:
        raise ValueError(f"keys of more than {MAX_KEY} bytes with their place aren't supported")
    blocks = np.frombuffer(b"".join(h.ljust(64, b"\0") for h in heads), np.uint8).reshape(-1, 64)
    ends = np.cumsum(np.asarray(counts, np.int64))
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, np.float64)
    for lo in range(0, total, MD5_ROWS):
        at = np.arange(lo, min(lo + MD5_ROWS, total))
        row = np.searchsorted(ends, at, side="right")
        place = at - (ends[row] - np.asarray(counts, np.int64)[row])
        data, base = blocks[row], 64 * np.arange(len(at)) + head[row]
        flat = data.reshape(-1)
        digits = np.searchsorted(10 ** np.arange(1, 11), place, side="right") + 1
        rest = place.copy()
        for k in range(int(digits.max())):
            on = np.flatnonzero(digits > k)
            flat[base[on] + digits[on] - 1 - k] = 48 + rest[on] % 10
            rest //= 10
        flat[base + digits] = 0x80
        bits = 8 * (head[row] + digits)
        data[:, 56], data[:, 57] = bits & 255, bits >> 8
        words = np.ascontiguousarray(data.view("<u4").T)
        out[lo:lo + len(at)] = _md5_first([w if k == 0 or w.any() else None for k, w in enumerate(words)]).byteswap()
    return out / TWO32
