"""German: suffixes go one group after another; umlauts lose their dots at the end."""

from __future__ import annotations

import re

from lexigrain.functions.stemmers.regions import after_vowel_consonant

_VOWELS = "aeiouyäöü"
_PLAIN = str.maketrans("äöüUY", "aouuy")


def _regions(word: str) -> tuple[str, str]:
    at = after_vowel_consonant(word, _VOWELS)
    r1 = word[max(at, 3) :] if at <= len(word) else ""
    return r1, r1[after_vowel_consonant(r1, _VOWELS) :]


def stem(word: str) -> str:
    word = word.lower()
    for low, high in (("u", "U"), ("y", "Y")):
        word = re.sub(f"([{_VOWELS}]){low}([{_VOWELS}])", rf"\1{high}\2", word)
    word = word.replace("ß", "ss")
    r1, _ = _regions(word)
    for group, sibilant in ((("em", "ern", "er"), False), (("en", "es", "e"), True)):
        for end in group:
            if r1.endswith(end):
                r1, word = r1[: -len(end)], word[: -len(end)]
                if sibilant and word.endswith("niss"):
                    word = word[:-1]
    word = re.sub("(?<=[bdfghklmnrt])s$", "", word)
    r1, _ = _regions(word)
    for end in ("est", "er", "en"):
        if r1.endswith(end):
            r1, word = r1[: -len(end)], word[: -len(end)]
    if "st" in r1:
        word = re.sub("(...[bdfghklmnt])st$", r"\1", word)
    r1, r2 = _regions(word)
    for end in ("end", "ung", "isch", "ik", "ig"):
        if r2.endswith(end) and len(word) > len(end) and word[-len(end) - 1] != "e":
            word, r2 = word[: -len(end)], r2[: -len(end)]
    for end in ("lich", "heit"):
        if r2.endswith(end):
            word, r2 = word[: -len(end)], r2[: -len(end)]
        elif r1.endswith(end) and word[: -len(end)].endswith(("er", "en")):
            word, r1 = word[: -len(end)], r1[: -len(end)]
    if r2.endswith("keit"):
        word = word[:-4]
    return word.translate(_PLAIN)
