"""Regions of a word in which suffixes are looked for."""

from __future__ import annotations


def after_vowel_consonant(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first non-vowel that follows a vowel begins; the word's end if there is none."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def r1_r2(word: str, vowels: str) -> tuple[int, int]:
    r1 = after_vowel_consonant(word, vowels)
    return r1, after_vowel_consonant(word, vowels, r1)


def romance_rv(word: str, vowels: str) -> int:
    """RV of Spanish, Italian and Portuguese."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] in vowels), len(word))
    if word[0] in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in vowels), len(word))
    return 3


def longest(word: str, suffixes: list[str], start: int = 0) -> str | None:
    """The longest of ``suffixes``, given longest first, with which ``word`` ends at or after ``start``."""
    return next((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= start), None)


def by_length(text: str) -> list[str]:
    return sorted(text.split(), key=len, reverse=True)
