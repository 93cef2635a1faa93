"""Helpers for text from scans: folding of letters that are misread for one another."""

from __future__ import annotations

import unicodedata

# Letters and pairs that printed-text recognition takes for one another.
_PAIRS = (("ſ", "s"), ("vv", "w"), ("rn", "m"), ("rl", "d"), ("cl", "d"), ("li", "h"))
_CLASSES = ("oce0(q", "iljt1|!fr", "nausvyp5", "hb6k", "g9")

_TABLE = {}
for _c in range(0x20, 0x250):
    _base = unicodedata.normalize("NFKD", chr(_c)).lower()[:1]
    _TABLE[_c] = next((k[0] for k in _CLASSES if _base and _base in k), _base if _base.isalnum() else None)


def fold(word: str) -> str:
    """Coarse form of a lower-case word; equal for most misreadings of it. Signs fall away."""
    for a, b in _PAIRS:
        if a in word:
            word = word.replace(a, b)
    return word.translate(_TABLE)
