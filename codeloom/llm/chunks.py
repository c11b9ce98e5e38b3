"""Cutting texts where no token of a byte-level vocabulary can cross, so that chunks are encoded once and remembered."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: A single space between two characters that are not white space: the space opens a new pre-token.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space beside a space: then splitting at every space would cut inside a run of white space.
RUN = re.compile(r"\s | \s|^ | $")


def split_chunks(text: str) -> list[str]:
    """The text cut before each single inner space, that space leading its chunk: joined, the chunks are the text.

    >>> split_chunks("a bc  d")
    ['a', ' bc  d']
    """
    if not text:
        return []
    parts = CUT.split(text) if RUN.search(text) else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


class ChunkCache:
    """What encode() makes of a chunk, for at most `most` chunks; then it starts anew."""

    def __init__(self, encode: Callable[[list[str]], Iterable], most: int = 400_000, longest: int = 64):
        self.encode, self.most, self.longest, self.known = encode, most, longest, {}

    def of(self, texts: list[list[str]]) -> list[list]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        missing = list({c for chunks in texts for c in chunks if c not in known})
        long = []
        for chunk, made in zip(missing, self.encode(missing), strict=True):
            known[chunk] = made
            if len(chunk) > self.longest:
                long.append(chunk)
        out = [[known[c] for c in chunks] for chunks in texts]
        for c in long:  # seldom seen again, and large
            del known[c]
        return out
