"""Italian, after the published Snowball description."""

from __future__ import annotations

import re

from lexigrain.functions.stemmers.regions import by_length, longest, r1_r2, romance_rv

_VOWELS = "aeiouàèìòù"
_PRONOUNS = by_length("ci vi si ti mi la le lo li ne gli sene gliene glieli glielo gliela gliele mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene")
_PLAIN = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti"
_STEP1 = by_length(_PLAIN + " azione azioni atore atori logia logie uzione uzioni usione usioni enza enze amento amenti imento imenti amente ità ivo ivi iva ive")
_VERBS = by_length(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo "
    "emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo "
    "iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo "
    "ono uta ute uti uto ar ir"
)


def stem(word: str) -> str:
    word = word.lower().translate(str.maketrans("áéíóú", "àèìòù"))
    word = re.sub("(?<=q)u", "U", word)
    word = re.sub(f"(?<=[{_VOWELS}])([iu])(?=[{_VOWELS}])", lambda m: m[1].upper(), word)
    rv = romance_rv(word, _VOWELS)
    r1, r2 = r1_r2(word, _VOWELS)
    end = longest(word, _PRONOUNS)
    if end is not None:
        base = word[: -len(end)]
        if base.endswith(("ando", "endo")) and len(base) - 4 >= rv:
            word = base
        elif base.endswith(("ar", "er", "ir")) and len(base) - 2 >= rv:
            word = base + "e"
    before = word
    word = _standard(word, rv, r1, r2)
    if word == before and (end := longest(word, _VERBS, rv)) is not None:
        word = word[: -len(end)]
    if word[-1:] in tuple("aeioàèìò") and len(word) - 1 >= rv:
        word = word[:-1]
        if word.endswith("i") and len(word) - 1 >= rv:
            word = word[:-1]
    if word.endswith(("ch", "gh")) and len(word) - 2 >= rv:
        word = word[:-1]
    return word.lower()


def _standard(word: str, rv: int, r1: int, r2: int) -> str:
    end = longest(word, _STEP1)
    if end is None:
        return word
    base = word[: -len(end)]
    at = len(base)

    def less(text: str, *ends: str) -> str:
        hit = next((e for e in ends if text.endswith(e) and len(text) - len(e) >= r2), "")
        return text[: len(text) - len(hit)]

    if end == "amente":
        if at < r1:
            return word
        cut = less(base, "iv", "os", "ic", "abil")
        return less(cut, "at") if base.endswith("iv") and cut != base else cut
    if end in ("amento", "amenti", "imento", "imenti"):
        return base if at >= rv else word
    if at < r2:
        return word
    if end in ("azione", "azioni", "atore", "atori"):
        return less(base, "ic")
    if end in ("logia", "logie"):
        return base + "log"
    if end in ("uzione", "uzioni", "usione", "usioni"):
        return base + "u"
    if end in ("enza", "enze"):
        return base + "ente"
    if end == "ità":
        return less(base, "abil", "ic", "iv")
    if end in ("ivo", "ivi", "iva", "ive"):
        cut = less(base, "at")
        return less(cut, "ic") if cut != base else cut
    return base
