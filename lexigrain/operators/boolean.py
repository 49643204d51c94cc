"""Boolean search: an expression becomes one condition over the terms that each document holds."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.stemmers import stemmer
from lexigrain.operators.index import Index
from lexigrain.operators.search import SearchOptions, expansions

_BINDS = {"|": 1, "&": 2, "~": 3, "(": 4, ")": 4}


def lex(text: str) -> list[str]:
    """Operators and words. A space means and, `` or `` means or, `` -`` means and not; all else is in lower case."""
    for words, mark in ((" or ", "|"), (" -", "&~"), (" ", "&")):
        text = text.replace(words, mark)
    out, word = [], ""
    for c in text.lower():
        if c in _BINDS:
            out += [word, c] if word else [c]
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def to_postfix(text: str) -> list[str]:
    """The expression with operators after their operands. A bracket that nothing opened is passed over."""
    out: list[str] = []
    held: list[str] = []
    for token in lex(text):
        if token not in _BINDS:
            out.append(token)
        elif token == ")":
            while held and (last := held.pop()) != "(":
                out.append(last)
        else:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
    return out + held[::-1]


def boolean_documents(index: Index, expression: str, options: SearchOptions = SearchOptions(), strict_not: bool = False, words: DataFrame | None = None) -> DataFrame:
    """``doc_id`` of the documents that an expression holds for, in one pass over the postings of its terms.

    Words are stemmed, not tokenized. A word stands for its dictionary entry and,
    with fuzziness, for all entries near it. Not a word that is in no document is
    nothing, or everything with ``strict_not``. A missing operand is nothing.
    """
    words = index.wordlist if words is None else words
    fuzzy = replace(options, no_limit=True, as_you_type=False)
    stem = stemmer(index.analysis.stemmer)
    postfix = to_postfix(expression)
    names = sorted({t for t in postfix if t not in _BINDS})
    entries = {t: [e.term for e in found] for t, found in zip(names, expansions(words, [stem(t).lower() for t in names], fuzzy))}
    flags = {t: f"has_{i}" for i, t in enumerate(names)}

    def fold(leaf, yes, no, both, either, negate):
        stack: list = []
        take = lambda: stack.pop() if stack else (no, None)
        for token in postfix:
            if token == "&":
                b, a = take(), take()
                stack.append((both(a[0], b[0]), None))
            elif token == "|":
                b, a = take(), take()
                stack.append((either(a[0], b[0]), None))
            elif token == "~":
                value, word = take()
                unknown = word is not None and not entries[word] and not strict_not
                stack.append((no if unknown else negate(value), None))
            elif token not in _BINDS:
                stack.append((leaf(token), token))
        return stack[0][0] if stack else no

    condition: Column = fold(lambda t: F.col(flags[t]) if entries[t] else F.lit(False), F.lit(True), F.lit(False), lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)
    without_any = fold(lambda t: False, True, False, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)
    known = sorted({e for found in entries.values() for e in found})
    rows = index.postings if without_any else index.postings.filter(F.col("term").isin(known))
    held = [F.max(F.col("term").isin(entries[t])).alias(flags[t]) for t in names if entries[t]]
    per_doc = rows.groupBy("doc_id").agg(*held) if held else rows.select("doc_id").distinct()
    return per_doc.filter(condition).select("doc_id")


def boolean_search(index: Index, expression: str, limit: int = 100, options: SearchOptions = SearchOptions(), strict_not: bool = False, words: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` documents by id that an expression holds for."""
    return boolean_documents(index, expression, options, strict_not, words).orderBy("doc_id").limit(abs(limit))
