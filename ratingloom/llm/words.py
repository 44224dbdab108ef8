"""Words of a text inside Python tasks, and their 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
_CACHED = 300_000
_HASHES: dict[str, int] = {}


def lower_words(text: str | None) -> list[str]:
    """Runs without white space, A-Z lower-cased; none for null."""
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def word_hashes(words: list[str]) -> np.ndarray:
    """One hash per word; a bounded cache per worker spares frequent words the work."""
    known = _HASHES
    try:
        return np.array([known[w] for w in words], np.uint64)
    except KeyError:
        if len(known) > _CACHED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
