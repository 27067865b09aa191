"""Cutting texts at spaces where a byte-level vocabulary's own splitting pattern always cuts.

The pattern of the public byte-level vocabularies never joins a space to what
stands before it unless that is white space too. So a text may be cut before
every space that follows a character which is no white space, each unit encoded
by itself, and the ids joined: the result equals that of the whole text. Units
repeat, so each distinct one is encoded once and kept in a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_SPACE_BEFORE_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def units(text: str) -> tuple[str, list[str]]:
    """The first unit, and the later ones without the space each begins with."""
    if _SPACE_BEFORE_SPACE.search(text) is None:
        parts = text.split(" ")
        return parts[0], parts[1:]
    parts = _CUT.split(text)
    return parts[0], [p[1:] for p in parts[1:]]


class UnitCache:
    """ids of whole texts through ``encode(units) -> list of id bytes``; at most ``limit`` units are kept."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = 1_200_000) -> None:
        self.encode, self.limit, self.known = encode, limit, {}

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [units(t) for t in texts]
        firsts = self.encode([first for first, _ in cut])
        wanted = set()
        for _, rest in cut:
            wanted.update(rest)
        fresh = [u for u in wanted if u not in self.known]
        if len(self.known) + len(fresh) > self.limit:
            self.known = {u: self.known[u] for u in wanted if u in self.known}
        self.known.update(zip(fresh, self.encode([" " + u for u in fresh]), strict=True))
        get = self.known.__getitem__
        return [first + b"".join(map(get, rest)) for first, (_, rest) in zip(firsts, cut, strict=True)]
