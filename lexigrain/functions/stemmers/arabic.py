"""Rough Arabic stems: letters that prefixes and suffixes may have go from both ends."""

from __future__ import annotations

_KINDS = (("ابفكلوأ", "اتةكمنهوي"), ("وأسفلي", "ومكانيه"))
_PREFIX, _SUFFIX, _STEM = 4, 6, 2


def _rough(word: str, prefix: str, suffix: str) -> str | None:
    kept = [i for i, c in enumerate(word) if c not in prefix + suffix]
    if not kept:
        return None
    first, last = min(kept[0], _PREFIX), max(kept[-1], len(word) - _SUFFIX - 1)
    first = next((i for i in range(first) if word[i] not in prefix), first)
    last = next((i for i in range(len(word) - 1, last, -1) if word[i] not in suffix), last)
    return word[first : last + 1] if last - first >= _STEM else None


def stem(word: str) -> str:
    """The shorter of the word's stems as a noun and as a verb; the word, if neither is long enough."""
    noun, verb = (_rough(word, *kind) for kind in _KINDS)
    found = [s for s in (verb, noun) if s]
    return min(found, key=len) if found else word
