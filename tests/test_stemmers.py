import pytest

from lexigrain.functions.stemmers import croatian, stemmer, register_stemmer


@pytest.mark.parametrize(
    "name, word, stem",
    [
        ("porter", "testing", "test"), ("porter", "source", "sourc"), ("porter", "code", "code"), ("porter", "is", "is"), ("porter", "funny", "funni"),
        ("porter", "caresses", "caress"), ("porter", "ponies", "poni"), ("porter", "hopping", "hop"), ("porter", "filing", "file"), ("porter", "relational", "relat"),
        ("porter", "generalizations", "gener"), ("porter", "electrical", "electr"), ("porter", "adoption", "adopt"), ("porter", "controll", "control"), ("porter", "apologize", "apolog"),
        ("german", "vergnüglich", "vergnug"), ("german", "Unfallversicherungsträger", "unfallversicherungstrag"),
        ("french", "abaissant", "abaiss"), ("french", "abandonnés", "abandon"), ("french", "continuellement", "continuel"), ("french", "majestueusement", "majestu"),
        ("portuguese", "gostou", "gost"), ("portuguese", "gosto", "gost"), ("portuguese", "gostaram", "gost"), ("portuguese", "quilométricas", "quilométr"),
        ("italian", "abbandonata", "abbandon"), ("italian", "pronunciamento", "pronunc"), ("italian", "crocchi", "crocc"), ("italian", "velocemente", "veloc"),
        ("russian", "вагоне", "вагон"), ("russian", "важности", "важност"), ("russian", "красивая", "красив"), ("russian", "ёлка", "елк"),
        ("ukrainian", "книгами", "книг"),
        ("polish", "czujnikami", "czujnik"), ("polish", "kabelek", "kabel"), ("polish", "najmocniejszy", "mocniej"), ("polish", "przekaźnikowy", "przekaźnik"),
        ("polish", "instalujesz", "instaluj"), ("polish", "ciekawie", "ciekaw"), ("polish", "przekaźników", "przekaźnik"), ("polish", "modułu", "moduł"),
        ("latvian", "piens", "pien"), ("latvian", "piena", "pien"), ("latvian", "pienu", "pien"), ("latvian", "pienam", "pien"), ("latvian", "izgatavotajam", "izgatavot"), ("latvian", "gudrajiem", "gudr"),
        ("croatian", "biti", "biti"), ("croatian", "njemu", "njem"), ("croatian", "stiska", "stisk"), ("croatian", "jasno", "jasn"), ("croatian", "kalibra", "kalibr"),
        ("croatian", "zagrijavanje", "zagrijavanj"), ("croatian", "biznisom", "biznis"), ("croatian", "razgovarati", "razgovara"), ("croatian", "najbogatijih", "najbogat"), ("croatian", "čćžšđ", "čćžšđ"),
        ("arabic", "والكتاب", "الكتاب"), ("arabic", "من", "من"),
        ("no", "Words", "Words"),
    ],
)
def test_golden(name, word, stem):
    assert stemmer(name)(word) == stem


def test_same_stems():
    assert stemmer("french")("frontières") == stemmer("french")("frontière")
    assert stemmer("polish")("modułów") == stemmer("polish")("moduły")


def test_croatian_parts():
    assert [croatian.syllabic(w) for w in ("crveno", "tvrdo", "vrt")] == ["cRveno", "tvRdo", "vRt"]
    assert [croatian.has_vowel(w) for w in ("test", "vrt", "dgk")] == [True, True, False]
    assert [croatian.unchanged(w) for w in ("ginekolozi", "ujaci", "policajaca")] == ["ginekologa", "ujak", "policajca"]


@pytest.mark.parametrize("name", ["porter", "german", "french", "italian", "portuguese", "russian", "ukrainian", "polish", "croatian", "latvian", "arabic"])
def test_odd_words(name):
    for word in ("", "a", "ß", "123", "aa", "yy", "éé", "🙂", "ь", "x" * 5000):
        assert isinstance(stemmer(name)(word), str)


def test_own_stemmer():
    register_stemmer("first", lambda w: w[:1])
    assert stemmer("first")("word") == "w"
    with pytest.raises(ValueError):
        stemmer("klingon")
