"""Stemmers by name. A stemmer is a function from a word to its stem; columns are stemmed by way of their distinct words."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.functions.stemmers import arabic, croatian, english, french, german, italian, latvian, portuguese, slavic

Stemmer = Callable[[str], str]


def identity(word: str) -> str:
    return word


STEMMERS: dict[str, Stemmer] = {
    "no": identity,
    "porter": english.stem,
    "german": german.stem,
    "french": french.stem,
    "italian": italian.stem,
    "portuguese": portuguese.stem,
    "russian": slavic.russian,
    "ukrainian": slavic.ukrainian,
    "polish": slavic.polish,
    "croatian": croatian.stem,
    "latvian": latvian.stem,
    "arabic": arabic.stem,
}
#: Languages that have a stemmer of another name.
_LANGUAGES = {"english": "porter"}


def register_stemmer(name: str, function: Stemmer) -> None:
    """Make a stemmer of one's own known by name, so that an index can name it."""
    STEMMERS[name] = function


def stemmer(name: str) -> Stemmer:
    """The stemmer of a name or a language."""
    name = _LANGUAGES.get(name, name)
    if name not in STEMMERS:
        raise ValueError(f"unknown stemmer: {name}")
    return STEMMERS[name]


def stemmed(word: Column, name: str) -> Column:
    """A column of words as a column of stems, in Arrow batches; meant for a vocabulary.

    It passes for nondeterministic, so that a filter on stems isn't pushed down
    to where a word comes many times.
    """
    function = stemmer(name)
    if function is identity:
        return word

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else function(w))

    return stems.asNondeterministic()(word)
