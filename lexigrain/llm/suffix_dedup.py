"""Suffix-array dedup: suffixes sorted by bucket-pointer refinement.

Suffixes reach a bucket packed as super-k-mers (``superkmers``), each with the
``k`` words that decide it, so a bucket's suffix array, ordered to ``k`` words,
is built from what lies in the bucket alone.

Initial buckets hold equal q-grams, and every suffix points to the end of its
bucket. Buckets are refined batch by batch: suffixes of a bucket are sorted by
the pointers of the suffixes that begin where their common beginning ends, the
parts get pointers of their own at once, and are refined in turn until they are
single or ``k`` words deep. A batch finds the pointers of all earlier ones
refined, so a part's depth grows by the whole depth of the bucket that it was
sorted by. Buckets with the rightmost suffixes come first, since the others look
to the right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from lexigrain.llm.substring_dedup import GRAM, WINDOW
from lexigrain.llm.superkmers import repeated_spans

#: Words of the initial buckets, and suffixes that are refined together.
Q, BATCH = 4, 1 << 16


def _initial(tokens: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in order of their first words, where in that order a bucket begins, and how many words: ``q``, or what fits one number. A missing word comes first."""
    n, bits = len(tokens), int(tokens.max() + 1).bit_length()
    q = max(1, min(q, 63 // bits))
    padded, key = np.concatenate((tokens + 1, np.zeros(q, np.int64))), np.zeros(n, np.int64)
    for j in range(q):
        key = key << bits | padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.append(True, key[1:] != key[:-1])), q


def _batches(order: np.ndarray, at: np.ndarray, sizes: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    """Suffixes of the buckets of several suffixes, whole buckets together, those with the rightmost suffixes first."""
    rightmost = np.maximum.reduceat(order, at)
    buckets = np.flatnonzero(sizes > 1)
    buckets = buckets[np.argsort(-rightmost[buckets])]
    n = sizes[buckets]
    held = np.cumsum(n)
    cuts = np.searchsorted(held, np.arange(batch, held[-1] + batch, batch)) + 1 if len(n) else []
    for a, b in zip([0, *cuts], cuts):
        if a < b:
            some = n[a:b]
            yield order[np.repeat(at[buckets[a:b]], some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)]


def bucket_pointers(tokens: np.ndarray, k: int, q: int = Q, batch: int = BATCH) -> np.ndarray:
    """The pointer of each suffix: the place of its bucket's end in the suffix array.

    Suffixes of one bucket have ``k`` words in common; buckets are in order of
    their words, and two of them may differ only beyond the first ``k``.
    """
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64)
    order, at, q = _initial(tokens, min(q, k))
    sizes = np.diff(np.append(at, n))
    pointer = np.full(n + k, -1, np.int64)
    pointer[order] = np.repeat(at + sizes - 1, sizes)
    depth = np.full(n + 1, k, np.int64)  # of the bucket that ends there; the last is for what lies behind the text
    depth[(at + sizes - 1)[sizes > 1]] = q
    for suffixes in _batches(order, at, sizes, batch):
        while len(suffixes := suffixes[depth[pointer[suffixes]] < k]):
            own = pointer[suffixes]
            later = pointer[suffixes + depth[own]]
            inner = np.argsort(own * (n + 1) + later)  # a pointer behind the text is -1
            suffixes, own, later = suffixes[inner], own[inner], later[inner]
            head = np.append(True, own[1:] != own[:-1])
            new = np.flatnonzero(head | np.append(True, later[1:] != later[:-1]))
            parts = np.diff(np.append(new, len(suffixes)))
            bucket = np.cumsum(head)[new] - 1
            last = np.append(np.flatnonzero(head)[1:], len(suffixes)) - 1
            ends = own[new] - (last[bucket] - (new + parts - 1))  # the last part keeps the bucket's end
            deeper = np.where(parts > 1, np.minimum(k, depth[own[new]] + depth[later[new]]), k)
            pointer[suffixes] = np.repeat(ends, parts)
            depth[ends] = deeper
    return pointer[:n]


def by_suffix_array(tokens: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Group numbers of windows: equal ones lie together in the suffix array, and neighbours are compared word by word."""
    order = np.argsort(bucket_pointers(tokens, k)[starts])
    at = starts[order]
    same = np.arange(1, len(at))
    for j in range(k):
        same = same[tokens[at[same] + j] == tokens[at[same - 1] + j]]
    new = np.ones(len(at), np.int64)
    new[same] = 0
    gid = np.empty(len(at), np.int64)
    gid[order] = np.cumsum(new) - 1
    return gid


def suffix_repeats(docs: DataFrame, k: int = WINDOW, m: int = GRAM) -> DataFrame:
    """Repeated passages as ``substring_dedup.repeated_passages`` defines them, with the same result and the same cases."""
    return repeated_spans(docs, by_suffix_array, k, m)
