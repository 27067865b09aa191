"""Replayable draws: every shuffle and sample orders or indexes by an md5 of its keys.

A draw depends only on the seed and the row's own keys, so a lost executor
recomputes the same answer and a second engine can replay it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def draw_hex(seed: int | str, *parts: str | Column) -> Column:
    """32 hex digits of md5 over ``seed|part|part``; used as a sort key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_col(p).cast("string") for p in parts]))


def draw_int(seed: int | str, *parts: str | Column) -> Column:
    """The first 8 hex digits of :func:`draw_hex` as an unsigned 32-bit number."""
    return F.conv(F.substring(draw_hex(seed, *parts), 1, 8), 16, 10).cast("long")


def draw_unit(seed: int | str, *parts: str | Column) -> Column:
    """A draw in [0, 1)."""
    return draw_int(seed, *parts) / F.lit(4294967296.0)


_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 4294967296) for i in range(64)]
#: Messages hashed at once: the state of that many fits a core's cache.
LANES = 1 << 14


def md5_words(message: Sequence[int | np.ndarray], n: int | None = None) -> tuple[np.ndarray, ...]:
    """The four words of :func:`draw_hex`, as numbers that order like its digits, for messages of equal length.

    ``message`` has one entry per byte: a number where all messages agree, else an array with one byte for each of the ``n``.
    """
    n = next(len(c) for c in message if isinstance(c, np.ndarray)) if n is None else n
    size = len(message)
    tail = [0x80, *[0] * (-(size + 9) % 64), *(8 * size).to_bytes(8, "little")]
    columns = [*message, *tail]
    state = [np.full(n, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for start in range(0, len(columns), 64):
        fixed, varying = [], []
        for at in range(start, start + 64, 4):
            word, moving = 0, None
            for i, c in enumerate(columns[at : at + 4]):
                if isinstance(c, np.ndarray):
                    part = c.astype(np.uint32) << np.uint32(8 * i)
                    moving = part if moving is None else moving | part
                else:
                    word |= int(c) << (8 * i)
            fixed.append(word)
            varying.append(moving)
        a, b, c, d = (s.copy() for s in state)
        f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
        for step in range(64):
            turn = step // 16
            if turn == 0:
                np.bitwise_xor(c, d, out=f); f &= b; f ^= d; at = step  # noqa: E702
            elif turn == 1:
                np.bitwise_xor(b, c, out=f); f &= d; f ^= c; at = (5 * step + 1) % 16  # noqa: E702
            elif turn == 2:
                np.bitwise_xor(b, c, out=f); f ^= d; at = (3 * step + 5) % 16  # noqa: E702
            else:
                np.invert(d, out=f); f |= b; f ^= c; at = 7 * step % 16  # noqa: E702
            a += f
            a += np.uint32((_SINES[step] + fixed[at]) & 0xFFFFFFFF)
            if varying[at] is not None:
                a += varying[at]
            by = _SHIFTS[turn][step % 4]
            np.left_shift(a, np.uint32(by), out=t)
            a >>= np.uint32(32 - by)
            a |= t
            a += b
            a, b, c, d = d, a, b, c
        for s, v in zip(state, (a, b, c, d), strict=True):
            s += v
    return tuple(s.byteswap() for s in state)


def digits(numbers: np.ndarray) -> list[np.ndarray]:
    """The decimal digits of numbers that have equally many, one array for each place."""
    width = len(str(int(numbers[0])))
    return [(numbers // 10 ** (width - 1 - i) % 10 + 48).astype(np.uint8) for i in range(width)]


def equally_long(first: int, last: int) -> list[tuple[int, int]]:
    """``range(first, last)`` cut where the number of digits changes."""
    cuts = [first, *[10**i for i in range(1, 20) if first < 10**i < last], last]
    return list(zip(cuts, cuts[1:]))
