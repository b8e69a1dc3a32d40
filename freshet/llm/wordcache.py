"""Exact tokenisation of whole texts by way of a cache of space-delimited chunks.

Byte-level vocabularies pre-split a text so that a split always lies before a single
space between two characters that are not white space.  A text is therefore the
concatenation of chunks that can be encoded one by one, and most chunks repeat.  Chunks are kept as packed unsigned 32-bit ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import compress, count
from operator import not_

#: White space that touches other white space, or is neither space nor newline.
_GLUED = re.compile(r"\s\s|[^\S \n]")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=[^\s.,])")
#: A stop or comma that touches another sign, or follows white space or nothing.
_SIGNS = re.compile(r"[^\w\s][.,]|[.,][^\w\s]|_[.,]|[.,]_|(?:\A|\s)[.,]")


def split_bytelevel(text: str) -> list[str]:
    """Chunks of a text for byte-level vocabularies.

    The first stands as it is.  Of the others, one that begins with a newline, a
    stop or a comma stands as it is, and any other is preceded by a space.  A
    stop or comma next to letters or digits is always a piece of its own.
    """
    if _GLUED.search(text) or _SIGNS.search(text):
        return _SINGLE_SPACE.split(text)
    return text.replace("\n", " \n").replace(",", " ,").replace(".", " .").split(" ")


def bytelevel_surface(chunk: str) -> str:
    return chunk if chunk[:1] in ("\n", ".", ",") else " " + chunk


class ChunkEncoder:
    """Encodes batches of texts; ``encode_many`` encodes a list of strings.

    ``limit`` bounds each of the cache's two generations.  Chunks of over
    ``longest`` characters are not kept.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], split=split_bytelevel, surface=bytelevel_surface, limit: int = 500_000, longest: int = 48):
        self.encode_many, self.split, self.surface = encode_many, split, surface
        self.limit, self.longest = limit, longest
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def encode_heads(self, heads: list[str]) -> list[bytes]:
        fresh = [h for h in set(heads) if h not in self.heads]
        if len(self.heads) + len(fresh) > self.limit // 8:
            self.heads.clear()
            fresh = list(set(heads))
        self.heads.update(zip(fresh, self.encode_many(fresh), strict=True))
        out = [self.heads[h] for h in heads]
        for h in fresh:
            if len(h) > self.longest:
                del self.heads[h]
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        if len(self.kept) > self.limit:  # what is used again moves on, the rest goes
            self.older, self.kept = self.kept, {}
        kept, older = self.kept, self.older
        chunks = [self.split(t) for t in texts]
        heads = [c[0] for c in chunks]  # encoded as they stand
        found, gaps, missing = [], [], set()
        for c in chunks:
            del c[0]
            ids = list(map(kept.get, c))
            gap = list(compress(count(), map(not_, ids)))  # unknown, or known to have no ids
            missing.update([c[i] for i in gap])
            found.append(ids)
            gaps.append(gap)
        new = []
        for w in missing:
            if w not in kept:
                known = older.get(w)
                if known is None:
                    new.append(w)
                else:
                    kept[w] = known
        if new:
            kept.update(zip(new, self.encode_many([self.surface(w) for w in new]), strict=True))
        for c, ids, gap in zip(chunks, found, gaps):
            for i in gap:
                ids[i] = kept[c[i]]
        out = [h + b"".join(ids) for h, ids in zip(self.encode_heads(heads), found, strict=True)]
        for w in new:
            if len(w) > self.longest:
                del kept[w]
        return out
