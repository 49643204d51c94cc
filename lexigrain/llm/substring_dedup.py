"""Substring dedup by super-k-mer partitioning, and the cutting of found spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import fresh, rows_of, window_hashes
from lexigrain.llm.superkmers import repeated_spans

WINDOW, GRAM = 50, 6
_WORD = re.compile(r"\S+")
_SEED = np.uint64(0xD6E8FEB86659FD93)


def by_sorting(tokens: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Group numbers of windows: windows are sorted by a hash, and equal hashes are settled by content."""
    keys = window_hashes((tokens.astype(np.uint64) + np.uint64(1)) * _SEED, k)[starts]
    order = np.argsort(keys, kind="stable")
    sorted_keys, at = keys[order], starts[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    same = np.flatnonzero(~new)
    wrong = np.zeros(len(same), bool)
    a, b = at[same], at[same - 1]
    for j in range(k):
        wrong |= tokens[a + j] != tokens[b + j]
    for g in np.unique(np.cumsum(new)[same[wrong]]):  # unequal windows of one hash
        lo = int(np.searchsorted(np.cumsum(new), g))
        hi = int(np.searchsorted(np.cumsum(new), g, side="right"))
        rows = tokens[at[lo:hi, None] + np.arange(k)]
        kind = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        inner = np.argsort(kind, kind="stable")
        order[lo:hi], at[lo:hi] = order[lo:hi][inner], at[lo:hi][inner]
        new[lo + 1 : hi] = kind[inner][1:] != kind[inner][:-1]
    gid = np.empty(len(order), np.int64)
    gid[order] = np.cumsum(new) - 1
    return gid


def repeated_passages(docs: DataFrame, k: int = WINDOW, m: int = GRAM) -> DataFrame:
    """Every passage of ``k`` words or more that occurs more than once in ``docs(doc_id, text)``.

    Words are maximal runs of other characters than white space, compared
    exactly. Of equal windows of ``k`` words the one with the smallest
    ``(doc_id, position)`` is the first. Result: ``doc_id, start_word,
    end_word`` (exclusive) and ``removed``: true for joined or touching later
    copies, false for joined or touching first ones.

    Rows with a null doc_id or text, empty texts and texts under ``k`` words
    give no row; a row repeated with its doc_id counts once; other columns are
    not read; an empty table gives an empty result. A text may have any length.
    """
    return repeated_spans(docs, by_sorting, k, m)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` less the given word ranges, each with the white space after it."""
    at = [w.start() for w in _WORD.finditer(text)]
    at.append(len(text))
    out, last = [], 0
    for a, b in sorted(spans):
        a, b = min(a, len(at) - 1), min(b, len(at) - 1)
        out.append(text[last : max(last, at[a])])
        last = max(last, at[b])
    out.append(text[last:])
    return "".join(out)


def remove_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the ``removed`` spans cut out of ``text``; ``n_chars``, where there is one, counts anew.

    All rows and columns stay. Rows without a span, null doc_ids and null texts
    are left as they are; a text that is all copies becomes empty.
    """
    mark = fresh([*docs.columns, "doc_id"], "cuts")
    key = fresh([*docs.columns, mark], "cut_doc")
    cuts = spans.filter("removed").groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(mark))
    joined = docs.join(cuts, docs["doc_id"] == cuts[key], "left").drop(key)
    names = docs.columns
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    i, c = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in rows_of(batch):
                columns = list(piece.columns)
                lists = columns.pop(names_mark)
                if lists.null_count < len(lists):
                    texts = columns[i].to_pylist()
                    sizes = columns[c].to_pylist() if c is not None else None
                    for r, spans_r in enumerate(lists.to_pylist()):
                        if spans_r and texts[r] is not None:
                            texts[r] = without(texts[r], [(s["start_word"], s["end_word"]) for s in spans_r])
                            if sizes is not None:
                                sizes[r] = len(texts[r])
                    columns[i] = pa.array(texts, columns[i].type)
                    if sizes is not None:
                        columns[c] = pa.array(sizes, columns[c].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    names_mark = len(names)
    return joined.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{mark}`")).mapInArrow(cut, ", ".join(f"`{n}` {kinds[n]}" for n in names))
