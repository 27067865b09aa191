"""Words of many texts at once, as 64-bit hashes.

A word's hash is a sum over its bytes of fixed random words times odd powers,
mixed with its length; two different words share one with a chance of about 2^-60.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kinfold.llm.common import packed, splitmix, stream

_BYTE = stream(256, 1)
_STEP = np.uint64(0xD1342543DE82EF95)

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
#: ASCII capitals as small letters, all else as it is.
LOWER = _fold
#: Bytes outside ``[\x20\x09-\x0D]``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters, digits and every byte of a character beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP)
    out[0] = 1
    return np.cumprod(out)


def hashed_words(texts: pa.Array, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words in order, and each text's first word (one more entry for the end)."""
    data, offsets = packed(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begin = np.flatnonzero(first[at])  # of each word among the word bytes
    length = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, length)
    values = _BYTE[LOWER[data[at]]] * _powers(int(length.max()))[place]
    hashes = splitmix(np.add.reduceat(values, begin) + length.astype(np.uint64))
    return hashes, np.searchsorted(at[begin], offsets)
