"""Portuguese, after the published Snowball description."""

from __future__ import annotations

from lexigrain.functions.stemmers.regions import by_length, longest, r1_r2, romance_rv

_VOWELS = "aeiouáéíóúâêô"
_PLAIN = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"
_STEP1 = by_length(_PLAIN + " logia logias ução uções uça~o uço~es ência ências amente mente idade idades iva ivo ivas ivos ira iras")
_VERBS = by_length(
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem "
    "ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is "
    "ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos "
    "ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
)


def stem(word: str) -> str:
    word = word.lower().replace("ã", "a~").replace("õ", "o~")
    rv = romance_rv(word, _VOWELS)
    r1, r2 = r1_r2(word, _VOWELS)
    before = word
    word = _standard(word, rv, r1, r2)
    if word == before and (end := longest(word, _VERBS, rv)) is not None:
        word = word[: -len(end)]
    if word != before:
        if word.endswith("i") and word[:-1].endswith("c") and len(word) - 1 >= rv:
            word = word[:-1]
    elif (end := longest(word, by_length("os a i o á í ó"), rv)) is not None:
        word = word[: -len(end)]
    if word[-1:] in tuple("eéê") and len(word) - 1 >= rv:
        word = word[:-1]
        if word.endswith(("gu", "ci")) and len(word) - 1 >= rv:
            word = word[:-1]
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    return word.replace("a~", "ã").replace("o~", "õ")


def _standard(word: str, rv: int, r1: int, r2: int) -> str:
    end = longest(word, _STEP1)
    if end is None:
        return word
    base = word[: -len(end)]
    at = len(base)

    def less(text: str, *ends: str) -> str:
        hit = next((e for e in ends if text.endswith(e) and len(text) - len(e) >= r2), "")
        return text[: len(text) - len(hit)]

    if end in ("ira", "iras"):
        return base + "ir" if at >= rv and base.endswith("e") else word
    if end == "amente":
        if at < r1:
            return word
        cut = less(base, "iv", "os", "ic", "ad")
        return less(cut, "at") if base.endswith("iv") and cut != base else cut
    if at < r2:
        return word
    if end in ("logia", "logias"):
        return base + "log"
    if end in ("ução", "uções", "uça~o", "uço~es"):
        return base + "u"
    if end in ("ência", "ências"):
        return base + "ente"
    if end == "mente":
        return less(base, "ante", "avel", "ível")
    if end in ("idade", "idades"):
        return less(base, "abil", "ic", "iv")
    if end in ("iva", "ivo", "ivas", "ivos"):
        return less(base, "at")
    return base
