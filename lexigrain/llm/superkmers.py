"""Repeated word windows, found by super-k-mer partitioning.

Each window of ``k`` words goes to the bucket of its minimiser, the smallest
hash among its ``m``-word grams. Neighbouring windows mostly share one, so a
run of them travels as one packed string: about three bytes of text per byte of
input, where sending windows one by one would cost ``k``. Strings bound for one
bucket are packed into one compressed blob, and equal strings are kept once
with a list of their places. Of a string that comes more than once among those
that a task sends together, only the first place goes to the string's bucket: the
others are later copies whatever lies there, and are spread over all buckets. So
a passage in a third of all documents costs its bucket one place for each time a
task sends. Equal windows always meet in one bucket, which makes the counts there
exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import WordHash, buckets_for, delivered, first_width, mixed, packed_sections, rows_of, sections_of, sliding_min, window_hashes, word_hashes

#: Bytes of input a bucket should hold, and bytes of packed text a task gathers before it sends them.
BUCKET_BYTES, FLUSH_BYTES = 1 << 20, 40 << 20

Grouper = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def runs_of_windows(words: list[str], memo: WordHash, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer."""
    low = sliding_min(mixed(window_hashes(word_hashes(words, memo), m)), k - m + 1)
    cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
    starts = np.concatenate(([0], cuts))
    return starts, np.diff(np.append(starts, len(low))), low[starts]


def _packer(k: int, m: int, buckets: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, press, held = WordHash(), zstandard.ZstdCompressor(level=3), 0
        # by bucket and string: windows, and places as document and position
        parts: dict[int, dict[bytes, tuple[int, list[tuple[int, int]]]]] = defaultdict(dict)

        def flush() -> pa.RecordBatch:
            later: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            firsts: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
            for b, strings in parts.items():
                for n, places in strings.values():
                    first, *rest = sorted(set(places)) if len(places) > 1 else places
                    firsts[b].append((*first, n, 1 + bool(rest)))
                    for doc, s in rest:
                        later[doc * 2654435761 % buckets].append((doc, s, n))
            payloads = []
            for b in sorted({*firsts, *later}):
                texts, own, more = list(parts.get(b, ())), firsts.get(b, ()), later.get(b, ())
                arrays = [np.array([len(own), len(more)], np.int64)]
                for rows, kinds in ((own, (np.int64, np.int32, np.int32, np.int8)), (more, (np.int64, np.int32, np.int32))):
                    arrays += [np.fromiter((r[i] for r in rows), kind, len(rows)) for i, kind in enumerate(kinds)]
                arrays.append(np.fromiter(map(len, texts), np.int32, len(texts)))
                payloads.append((b, b"".join([*[x.tobytes() for x in arrays], *texts])))
            parts.clear()
            return packed_sections(payloads, width, press)

        for batch in batches:
            for piece in rows_of(batch):
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    words = text.split()
                    if len(words) < k:
                        continue
                    starts, wins, low = runs_of_windows(words, memo, k, m)
                    joined = " ".join(words)
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                    a = np.where(starts > 0, ends[starts - 1], 0).tolist()
                    z = (ends[starts + wins + k - 2] - 1).tolist()
                    for b, s, n, i, j in zip((low % np.uint64(buckets)).tolist(), starts.tolist(), wins.tolist(), a, z):
                        string = joined[i:j].encode()
                        if (known := parts[b].get(string)) is None:
                            parts[b][string] = (n, [(doc, s)])
                            held += j - i
                        else:
                            known[1].append((doc, s))
                            held += 16
                    if held > FLUSH_BYTES:
                        yield flush()
                        held = 0
        if parts:
            yield flush()

    return pack


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


def _unpack(blobs: list[bytes]) -> tuple[list[bytes], np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Distinct strings and their window counts; place by place the string's number, document, position and weight (2, where the string came again); document, position and windows of later copies."""
    press, seen, wins_of = zstandard.ZstdDecompressor(), {}, []
    places, copies = [], []
    for _, raw in (section for blob in blobs for section in sections_of(blob, press)):
        at = 16
        n, more = np.frombuffer(raw, np.int64, 2).tolist()
        arrays = []
        for kind, size in ((np.int64, n), (np.int32, n), (np.int32, n), (np.int8, n), (np.int64, more), (np.int32, more), (np.int32, more), (np.int32, n)):
            arrays.append(np.frombuffer(raw, kind, size, at))
            at += arrays[-1].nbytes
        doc, pos, wins, weight, *copy, sizes = arrays
        uid = []
        for w, size in zip(wins.tolist(), sizes.tolist()):
            u = seen.setdefault(raw[at : at + size], len(seen))
            if u == len(wins_of):
                wins_of.append(w)
            uid.append(u)
            at += size
        places.append((np.array(uid, np.int64), doc, pos, weight))
        copies.append(copy)
    join = lambda rows: tuple(np.concatenate(x).astype(np.int64) for x in zip(*rows))
    return list(seen), np.array(wins_of, np.int64), join(places), join(copies)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def repeated_in_bucket(blobs: list[bytes], k: int, group: Grouper) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows: document, first window, number of windows, whether they are later copies."""
    strings, wins, (uid, doc, pos, weight), copies = _unpack(blobs)
    passed = (*copies, np.ones(len(copies[0]), bool))
    if not strings:
        return passed
    order = np.lexsort((-weight, pos, doc, uid))
    uid, doc, pos, weight = (x[order] for x in (uid, doc, pos, weight))
    new = np.append(True, (uid[1:] != uid[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]))  # a repeated row counts once
    uid, doc, pos, weight = (x[new] for x in (uid, doc, pos, weight))
    held = np.bincount(uid, minlength=len(strings))
    begin = np.cumsum(held) - held
    times = np.add.reduceat(weight, begin)
    low_doc, low_pos = doc[begin], pos[begin]

    ids = _Ids()
    words = b" ".join(strings).split(b" ")
    tokens = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    del words, strings, ids
    u = np.repeat(np.arange(len(wins)), wins)
    off = _ramp(wins)
    sizes = wins + k - 1
    gid = group(tokens, (np.cumsum(sizes) - sizes)[u] + off, k)

    hit = np.flatnonzero(np.bincount(gid, weights=times[u])[gid] >= 2)
    u, off, gid = u[hit], off[hit], gid[hit]
    order = np.lexsort((low_pos[u] + off, low_doc[u], gid))
    first = np.zeros(len(hit), bool)
    lead = np.append(True, gid[order][1:] != gid[order][:-1])[: len(order)]
    first[order[lead]] = True

    def runs(*also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (off[1:] != off[:-1] + 1)
        for x in also:
            new[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(new)
        return at, np.diff(np.append(at, len(u)))

    at, n = runs(first)
    out = [(low_doc[u[at]], low_pos[u[at]] + off[at], n, ~first[at])]
    at, n = runs()
    more = held[u[at]] - 1
    r, place = np.repeat(np.arange(len(at)), more), np.repeat(begin[u[at]] + 1, more) + _ramp(more)
    out.append((doc[place], pos[place] + off[at][r], n[r], np.ones(len(r), bool)))
    out.append(passed)
    return tuple(np.concatenate(x) for x in zip(*out))


def _counter(k: int, group: Grouper) -> Callable[[pa.Table], pa.Table]:
    def count(table: pa.Table) -> pa.Table:
        doc, start, n, later = repeated_in_bucket(table.column("data").to_pylist(), k, group)
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "s": pa.array(start, pa.int64()), "n": pa.array(n, pa.int64()), "later": pa.array(later, pa.bool_())})

    return count


def repeated_spans(docs: DataFrame, group: Grouper, k: int, m: int) -> DataFrame:
    """``doc_id, start_word, end_word, removed``: see ``substring_dedup.repeated_passages``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    buckets = buckets_for(docs, BUCKET_BYTES)
    width = first_width(buckets)
    blobs = slim.mapInArrow(_packer(k, m, buckets, width), "bucket int, data binary")
    runs = delivered(blobs, width).groupBy("bucket").applyInArrow(_counter(k, group), "doc_id long, s long, n long, later boolean")
    w = Window.partitionBy("doc_id", "later").orderBy("s", "e")
    runs = runs.withColumn("e", F.col("s") + F.col("n") + (k - 1))
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("fresh", F.when(F.col("s") <= before, 0).otherwise(1))
    runs = runs.withColumn("span", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "later", "span").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).select("doc_id", "start_word", "end_word", F.col("later").alias("removed"))
