"""Vectorised tokenising of whole Arrow batches.

Texts are laid end to end as code points, so that one numpy pass per step serves a whole batch; no
Python loop touches a character or a token.
"""

from __future__ import annotations

import itertools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPACE, WORD, PUNCT = 0, 1, 2
#: Odd, so it has an inverse modulo 2**64.
BASE = 1000003
_TABLES: dict[str, np.ndarray] = {}


def tables() -> dict[str, np.ndarray]:
    """Class, lower-case and shape of each code point; built once per worker."""
    if not _TABLES:
        n = sys.maxunicode + 1
        cls, low, case = np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32), np.zeros(n, np.uint8)
        # Planes 4 to 13 have no characters, 15 and 16 private ones: none is a letter or a sign.
        for i in itertools.chain(range(0x40000), range(0xE0000, 0xE1000)):
            c = chr(i)
            k = unicodedata.category(c)
            cls[i] = WORD if k[0] in "LNM" else PUNCT if k[0] in "PS" else SPACE
            case[i] = {"Lu": 1, "Lt": 1, "Ll": 2, "Nd": 4}.get(k, 8 if k[0] in "LNM" else 0)
            if k in ("Lu", "Lt") and len(lo := c.lower()) == 1:
                low[i] = ord(lo)
        _TABLES.update(cls=cls, low=low, case=case)
    return _TABLES


_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if not _POW or len(_POW["p"]) < n:
        m = max(n, 1 << 18)
        p = np.full(m, BASE, np.uint64)
        q = np.full(m, pow(BASE, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _POW.update(p=np.multiply.accumulate(p), q=np.multiply.accumulate(q))
    return _POW["p"][:n], _POW["q"][:n]


@dataclass
class Tokens:
    cp: np.ndarray  # lower-cased code points
    case: np.ndarray
    cls: np.ndarray  # of each token
    start: np.ndarray  # of each token, into cp
    end: np.ndarray
    doc: np.ndarray  # index of each token's text
    n_docs: int

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each token's lower-case form: sum of code point * BASE**position."""
        p, q = powers(len(self.cp) + 1)
        h = np.zeros(len(self.cp) + 1, np.uint64)
        np.cumsum(self.cp.astype(np.uint64) * p[:-1], out=h[1:])
        return (h[self.end] - h[self.start]) * q[self.start]


def tokenise(texts: list[str | None]) -> Tokens:
    """Word runs (letters, marks, numbers) and punctuation runs (punctuation, symbols). A null is an empty text."""
    t = tables()
    texts = [x or "" for x in texts]
    raw = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = t["cls"][raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:-1])
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    real = cls[start] != SPACE if len(raw) else np.zeros(0, bool)
    start, end = start[real[: len(start)]], end[real[: len(end)]]
    bounds = np.cumsum([len(x) + 1 for x in texts]) if texts else np.zeros(0, int)
    doc = np.searchsorted(bounds, start, side="right")
    return Tokens(t["low"][raw], t["case"][raw], cls[start], start, end, doc, len(texts))


def chunks(texts: list[str | None], chars: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Slices of at most about so many characters, whole texts only, so that memory doesn't follow the batch size."""
    at = size = 0
    for i, x in enumerate(texts):
        n = len(x) + 1 if x else 1
        if i > at and size + n > chars:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
