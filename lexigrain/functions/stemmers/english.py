"""Porter's algorithm, with its author's later rules for ``bli`` and ``logi``."""

from __future__ import annotations

import re

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"ness": "", "ful": "", "ical": "ic", "iciti": "ic", "alize": "al", "ative": "", "icate": "ic"}
_STEP4 = sorted("ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou".split(), key=len, reverse=True)


def _shape(stem: str) -> str:
    out = []
    for i, c in enumerate(stem):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _mapped(word: str, table: dict[str, str]) -> str:
    for size in range(7, 2, -1):
        if (end := word[-size:]) in table and len(word) > size:
            return word[:-size] + table[end] if _measure(word[:-size]) > 0 else word
    return word


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed"):
        cut = word[:-2]
    elif word.endswith("ing"):
        cut = word[:-3]
    if cut is not None and "v" in _shape(cut):
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _mapped(_mapped(word, _STEP2), _STEP3)
    end = next((s for s in [*_STEP4[:1], *_STEP4[1:], "ion"] if word.endswith(s)), None)
    if end is not None:
        base = word[: -len(end)]
        if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
