"""Words as 64-bit ids, for n-grams over whole texts without string work per word."""

from __future__ import annotations

import re
import sys

import numpy as np

#: Characters that are looked at together; longer texts are cut between words.
_CUT = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
_SPACE, _WORD, _OTHER = 0, 1, 2

_kinds: np.ndarray | None = None
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _kind_of() -> np.ndarray:
    """Code point -> white space, part of a word (letters and digits), or neither."""
    global _kinds
    if _kinds is None:
        every, kinds = "".join(map(chr, range(sys.maxunicode + 1))), np.full(sys.maxunicode + 1, _OTHER, np.uint8)
        for kind, of in ((_SPACE, r"\s+"), (_WORD, r"[^\W_]+")):  # as str.isspace and str.isalnum
            for m in re.finditer(of, every):
                kinds[m.start() : m.end()] = kind
        _kinds = kinds
    return _kinds


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


class WordIds:
    """Texts -> ids of their words: the lower-cased letters and digits of each token between white space."""

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids of the words of a text, and the token number of each (None: word k is token k).

        A word's id is a polynomial hash of its characters, taken for all words at once; tokens without a letter or digit
        are no words but count as tokens.
        """
        low = (text or "").lower()
        if len(low) <= _CUT:
            ids, at, n = _ids(low)
        else:
            parts, n = [], 0
            for part in _pieces(low):
                ids, at, m = _ids(part)
                parts.append((ids, at + n))
                n += m
            ids, at = (np.concatenate(x) for x in zip(*parts))
        return ids, None if len(ids) == n else at


def _pieces(text: str):
    """A text in pieces of about ``_CUT`` characters that begin at white space."""
    start, space = 0, re.compile(r"\s")
    while start < len(text):
        m = space.search(text, min(start + _CUT, len(text)))
        stop = m.start() if m else len(text)
        yield text[start:stop]
        start = stop


def _ids(low: str) -> tuple[np.ndarray, np.ndarray, int]:
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kind_of()[codes]
    solid = kinds != _SPACE
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    token = np.cumsum(starts, dtype=np.int32)  # from 1, at solid characters
    kept = np.flatnonzero(kinds == _WORD)
    n = int(token[-1]) if len(token) else 0
    if not len(kept):
        return np.empty(0, np.uint64), np.empty(0, np.int64), n
    of = token[kept]
    first = np.flatnonzero(of[1:] != of[:-1]) + 1
    first = np.concatenate([np.zeros(1, np.int64), first])
    up, down = _power(len(kept))
    sums = np.add.reduceat((codes[kept].astype(np.uint64) + np.uint64(1)) * up[: len(kept)], first)
    ids = sums * down[first]
    ids = (ids ^ (ids >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ids ^ (ids >> np.uint64(29)), of[first].astype(np.int64) - 1, n


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; empty for fewer words."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = ids[:m].copy()
    for k in range(1, n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def gram_runs(shingles: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` shingles, in order, in a time that does not grow with ``n``."""
    m = len(shingles) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    up, down = _power(len(shingles))
    shingles = shingles.astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles * up[: len(shingles)], dtype=np.uint64)])
    h = (sums[n:] - sums[:-n]) * down[:m]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_TOKEN = re.compile(r"\S+")


def token_spans(text: str) -> list[tuple[int, int]]:
    """Character intervals of the tokens between white space, as :meth:`WordIds.of` numbers them."""
    return [m.span() for m in _TOKEN.finditer(text)]
