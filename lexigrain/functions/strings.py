"""String similarity: Jaro, Jaro-Winkler, subsequences and subsequence matching."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes are numbered by their place in this text; two places may hold parts of one accented letter.
ALPHABET = "".join(c + c.upper() for c in "abcčćdđefghijklmnopqrsštvuwxyzž") + "1234567890'+ /"
_PLACE: dict[int, int] = {}
for _i, _byte in enumerate(ALPHABET.encode()):
    _PLACE.setdefault(_byte, _i)
_BASE = 1_000_000


def jaro(a: str, b: str) -> float:
    """Jaro similarity over bytes; the matching window is half the longer length less one, a fraction rounded at its ends."""
    x, y = a.encode(), b.encode()
    if not x:
        return 1.0 if not y else 0.0
    reach = max(len(x), len(y)) / 2 - 1
    free = [True] * len(y)
    mine: list[int] = []
    for i, byte in enumerate(x):
        for k in range(int(max(0, i - reach)), int(min(i + reach + 1, len(y)))):
            if free[k] and y[k] == byte:
                free[k] = False
                mine.append(byte)
                break
    if not mine:
        return 0.0
    theirs = [byte for byte, unused in zip(y, free) if not unused]
    moved = sum(p != q for p, q in zip(mine, theirs)) / 2
    n = len(mine)
    return (n / len(x) + n / len(y) + (n - moved) / n) / 3


def jaro_winkler(a: str, b: str, threshold: float = 0.7) -> float:
    """Jaro similarity, raised for a common beginning of any length where it reaches ``threshold``."""
    j = jaro(a, b)
    if j < threshold:
        return j
    x, y = a.encode(), b.encode()
    same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return j + min(0.1, 1 / max(len(x), len(y), 1)) * same * (1 - j)


@F.pandas_udf(T.DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else float(jaro(x, y)) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else float(jaro_winkler(x, y)) for x, y in zip(a, b)], dtype="float64")


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in characters; Spark's ``levenshtein`` gives the same for columns."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _literally(character: str) -> str:
    return character if character.isalnum() or character == "_" else f"\\x{{{ord(character):x}}}"


def has_subsequence(pattern: str, text: Column) -> Column:
    """Whether the characters of ``pattern`` come in ``text`` in that order, without regard to case."""
    return F.lower(text).rlike("(?s)" + ".*".join(map(_literally, pattern.lower())))


def vector(word: str) -> list[int]:
    return [_PLACE.get(byte, 0) + _BASE for byte in word.encode()]


def norm(a: list[float]) -> float:
    return math.sqrt(sum(x * x for x in a))


def dot(a: list[float], b: list[float]) -> float:
    return sum(x * y for x, y in zip(a, b))


def cosine(a: list[float], b: list[float]) -> float:
    size = norm(a) * norm(b)
    return dot(a, b) / size if size else 0.0


def aligned(word: list[int], pattern: list[int]) -> list[int]:
    """The pattern laid along the word: each next pattern number where the word has it, zero elsewhere."""
    out, j = [], 0
    for i in range(max(len(word), len(pattern))):
        if j >= max(len(word), len(pattern)):
            break
        hit = j < len(pattern) and i < len(word) and pattern[j] == word[i]
        out.append(word[i] if hit else 0)
        j += hit
    return out


def match_score(word: str, pattern: str) -> float:
    """Cosine of a word with the pattern laid along it, 0.2 more where the word holds the pattern whole."""
    own = vector(word)
    laid = aligned(own, vector(pattern))
    return cosine(own + [0] * (len(laid) - len(own)), laid + [0] * (len(own) - len(laid))) + (0.2 if pattern in word else 0.0)


def fuzzy_match(items: DataFrame, pattern: str, column: str = "item", lowered: bool = False) -> DataFrame:
    """``item, score`` of the items that hold ``pattern`` as a subsequence, best first, ties in order of the item.

    Items are trimmed, and with ``lowered`` put in lower case for the score.
    Equal items give one row; null items none.
    """

    @F.pandas_udf("double")
    def score(words: pd.Series) -> pd.Series:
        return words.map(lambda w: match_score(w.lower() if lowered else w, pattern)).astype("float64")

    found = items.filter(has_subsequence(pattern, F.col(column))).select(F.trim(F.col(column)).alias("item")).distinct()
    return found.withColumn("score", score("item")).orderBy(F.desc("score"), "item")


def fuzzy_match_file(spark, path: str, pattern: str) -> DataFrame:
    """``fuzzy_match`` over the lines of a text file, in lower case for the score."""
    lines = spark.read.text(path).select(F.rtrim(F.col("value")).alias("item"))
    return fuzzy_match(lines, pattern, lowered=True)

