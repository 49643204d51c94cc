"""Marking the words of a query in texts, and cutting out the part of a text that tells most of them."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.functions.tokenizers import Tokenizer


@dataclass(frozen=True)
class HighlightOptions:
    """``simple`` also marks within tags; ``strip_links`` takes links off words before they are marked."""

    simple: bool = False
    whole_word: bool = True
    case_sensitive: bool = False
    strip_links: bool = False
    attributes: Mapping[str, str] = field(default_factory=dict)


def words_of(needle: str, by: Tokenizer | None = None) -> list[str]:
    return [w for w in regex.split((by or Tokenizer()).pattern, needle) if w]


def highlight(text: Column, needle: str, tag: str = "em", options: HighlightOptions = HighlightOptions(), by: Tokenizer | None = None) -> Column:
    """``text`` with each word of ``needle`` in a tag; all words in one pass, so the marks themselves are never marked."""
    words = [re.escape(w) for w in words_of(needle, by)]
    if not words:
        return text
    if options.whole_word:
        words = [rf"\b{w}\b" for w in words]
    any_word = "|".join(words)
    flags = "(?U)" if options.case_sensitive else "(?iU)"
    if options.strip_links:
        text = F.regexp_replace(text, rf"{flags}<a\s[^>]*>({any_word})</a>", "$1")
    pattern = f"({any_word})" if options.simple else f"(?!<.*?)({any_word})(?![^<>]*?>)"
    attributes = "".join(f' {k}="{v}"' for k, v in options.attributes.items()).replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, flags + pattern, f"<{tag}{attributes}>$1</{tag}>")


def locations(words: list[str], text: str) -> list[int]:
    """Where any of the words begins, without regard to case."""
    low, found = text.lower(), set()
    if len(low) != len(text):  # some letters have a longer small form
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for word in words:
        at = low.find(word.lower())
        while at >= 0:
            found.add(at)
            at = low.find(word.lower(), at + max(1, len(word)))
    return sorted(found)


def snippet_start(found: list[int], before: int) -> int:
    """Some characters before the place where two hits lie closest; -1 without a hit."""
    if not found:
        return -1
    start = found[0]
    if len(found) > 2:
        gaps = [found[i + 1] - found[i] for i in range(1, len(found) - 1)] + [found[-1] - found[-2]]
        start = found[1 + gaps.index(min(gaps))]
    return max(0, start - before)


def snippet_of(text: str, needle: str, length: int = 300, before: int = 50, indicator: str = "...", by: Tokenizer | None = None) -> str:
    """About ``length`` characters of a text around the words of ``needle``, cut at words."""
    if len(text) <= length:
        return text
    found = locations(words_of(needle, by), text)
    start = snippet_start(found, before)
    if len(text) - start < length:
        start = int(max(0, start - (len(text) - start) / 2))
    start = max(0, start)
    part = text[start : start + length]
    breaks = [m.start() for m in regex.finditer((by or Tokenizer()).pattern, part)]
    first, last = (breaks[0], breaks[-1]) if breaks else (-1, len(part))
    if not found:
        return part[:last] + indicator
    out = part
    if start + length < len(text):
        out = part[:last] + indicator
    return indicator + out[first + 1 :] if start else out


def snippet(text: Column, needle: str, length: int = 300, before: int = 50, indicator: str = "...", by: Tokenizer | None = None) -> Column:
    """``snippet_of`` for a column; null stays null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else snippet_of(t, needle, length, before, indicator, by))

    return cut(text)
