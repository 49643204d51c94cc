"""French, after the published Snowball description."""

from __future__ import annotations

import re

from lexigrain.functions.stemmers.regions import by_length, longest, r1_r2

_VOWELS = "aeiouyâàëéêèïîôûù"
_I_VERBS = by_length("it ît ie ir is iez iras irai irait irais iront irez irons issons iraient issait issais issant issants issante issantes isses isse issez issent issaient ira iriez irions issions issiez ît îmes îtes irent ies i ir")
_KEEP_E = by_length("é ée és ées er ez iez era erai erait erais eras erez eriez erions erons eront eraient èrent")
_A_VERBS = by_length("a ai as ais ait ant ants ante antes âmes ât âtes asse asses assent assiez assions aient")
_STEP1 = by_length(
    "ances ance eux euse euses iste istes able ables isme ismes ique iques iqUe iqUes "
    "atrices atrice ateurs ateur ations ation logies logie usions usion utions ution ences ence "
    "issements issement ements ement ités ité ives ive ifs if eaux aux emment amment ments ment"
)


def _marked(word: str) -> str:
    word = re.sub(f"(?<=[{_VOWELS}])([ui])(?=[{_VOWELS}])", lambda m: m[1].upper(), word)
    word = re.sub(f"(?<=[{_VOWELS}])y|y(?=[{_VOWELS}])", "Y", word)
    return re.sub("(?<=q)u", "U", word)


def _rv(word: str) -> int:
    if word[:3] in ("par", "col", "tap") or (len(word) > 1 and word[0] in _VOWELS and word[1] in _VOWELS):
        return 3
    return next((i + 1 for i in range(1, len(word)) if word[i] in _VOWELS), len(word))


def _standard(word: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """The word after the step for standard suffixes, and whether the verb steps are still due."""
    end = longest(word, _STEP1)
    if end is None:
        return word, True
    at = len(word) - len(end)
    base, in2 = word[:at], at >= r2
    if end in ("ation", "ations", "ateur", "ateurs", "atrice", "atrices"):
        if not in2:
            return word, True
        if base.endswith("ic"):
            return (base[:-2] if at - 2 >= r2 else base[:-2] + "iqU"), False
        return base, False
    if end in ("logie", "logies", "usion", "usions", "ution", "utions", "ence", "ences"):
        return (base + {"l": "log", "u": "u", "e": "ent"}[end[0]], False) if in2 else (word, True)
    if end in ("issement", "issements"):
        return (base, False) if at >= r1 and base and base[-1] not in _VOWELS else (word, True)
    if end in ("ement", "ements"):
        if at < rv:
            return word, True
        if base.endswith("iv") and at - 2 >= r2:
            base = base[:-2]
            return (base[:-2] if base.endswith("at") and len(base) - 2 >= r2 else base), False
        if base.endswith("eus"):
            return (base[:-3] if at - 3 >= r2 else base[:-1] + "x" if at - 3 >= r1 else base), False
        if base.endswith(("abl", "iqU")):
            return (base[:-3] if at - 3 >= r2 else base), False
        if base.endswith(("ièr", "Ièr")):
            return (base[:-3] + "i" if at - 3 >= rv else base), False
        return base, False
    if end in ("ité", "ités"):
        if not in2:
            return word, True
        if base.endswith("abil"):
            return (base[:-4] if at - 4 >= r2 else base[:-2] + "l"), False
        if base.endswith("ic"):
            return (base[:-2] if at - 2 >= r2 else base[:-2] + "iqU"), False
        return (base[:-2] if base.endswith("iv") and at - 2 >= r2 else base), False
    if end in ("if", "ifs", "ive", "ives"):
        if not in2:
            return word, True
        if base.endswith("at") and at - 2 >= r2:
            base = base[:-2]
            if base.endswith("ic"):
                base = base[:-2] if len(base) - 2 >= r2 else base[:-2] + "iqU"
        return base, False
    if end == "eaux":
        return base + "eau", False
    if end == "aux":
        return (base + "al", False) if at >= r1 else (word, True)
    if end in ("euse", "euses"):
        return (base, False) if in2 else (base + "eux", False) if at >= r1 else (word, True)
    if end in ("amment", "emment"):
        return (base + end[0] + "nt", True) if at >= rv else (word, True)
    if end in ("ment", "ments"):
        return (base, True) if at - 1 >= rv and base[-1] in _VOWELS else (word, True)
    return (base, False) if in2 else (word, True)


def _verbs(word: str, rv: int, r2: int) -> str:
    end = longest(word, _I_VERBS, rv)
    if end is not None:
        at = len(word) - len(end)
        if at - 1 >= rv and word[at - 1] not in _VOWELS:
            return word[:at]
    end = longest(word, [*by_length("ions"), *_KEEP_E, *_A_VERBS], rv)
    ends = [e for e in (longest(word, _KEEP_E, rv), longest(word, _A_VERBS, rv), longest(word, ["ions"], rv)) if e]
    if not ends:
        return word
    end = max(ends, key=len)
    at = len(word) - len(end)
    if end == "ions":
        return word[:at] if at >= r2 else word
    if end in _A_VERBS and word[:at].endswith("e") and at - 1 >= rv:
        return word[: at - 1]
    return word[:at]


def _residual(word: str, rv: int, r2: int) -> str:
    if word.endswith("s") and len(word) > 1 and word[-2] not in "aiouès":
        word = word[:-1]
    end = longest(word, by_length("ion ier ière Ier Ière e ë"), rv)
    if end is None:
        return word
    at = len(word) - len(end)
    if end == "ion":
        return word[:at] if at >= r2 and at - 1 >= rv and word[at - 1] in "st" else word
    if end == "e":
        return word[:at]
    if end == "ë":
        return word[:at] if word[:at].endswith("gu") and at - 2 >= rv else word
    return word[:at] + "i"


def stem(word: str) -> str:
    word = _marked(word.lower())
    rv = _rv(word)
    r1, r2 = r1_r2(word, _VOWELS)
    before = word
    word, verbs = _standard(word, rv, r1, r2)
    if verbs:
        after = _verbs(word, rv, r2)
        verbs, word = after == word, after
    if word == before:
        word = _residual(word, rv, r2)
    elif word.endswith("Y"):
        word = word[:-1] + "i"
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    if word.endswith(("enn", "onn", "ett", "ell", "eill")):
        word = word[:-1]
    word = re.sub(f"[éè]([^{_VOWELS}IUY]+)$", r"e\1", word)
    return word.lower()
