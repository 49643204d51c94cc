"""Best-fit packing by the sum-of-squares rule."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import rows_of

#: Words a bin holds, and documents that are packed together.
CAPACITY, SHARD_DOCS = 2048, 16_384


def pack_sizes(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item (1 to ``capacity``), in order of arrival.

    ``n[g]`` counts open bins with a gap of ``g``; an item goes where the sum of
    ``n[g] ** 2`` grows least. Equal growth: the smaller gap, then the older
    bin; a new bin comes last.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[deque[int]] = [deque() for _ in range(capacity + 1)]
    out, bins = [], 0
    for s in sizes:
        growth_new = 2 * int(n[capacity - s]) + 1 if s < capacity else 0
        here = n[s:]  # gaps s, s + 1, ...
        growth = 2 * (n[: len(here)] - here) + 2
        growth[0] = 1 - 2 * here[0]  # the bin is full then and no longer counts
        growth[here == 0] = np.iinfo(np.int64).max
        g = int(growth.argmin())
        if growth[g] <= growth_new:
            gap = g + s
            b = open_bins[gap].popleft()
            n[gap] -= 1
            left = g
        else:
            b, bins, left = bins, bins + 1, capacity - s
        if left:
            open_bins[left].append(b)
            n[left] += 1
        out.append(b)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in rows_of(batch):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(t.split()) for t in piece.column(1).to_pylist()], pa.int64())], ["doc_id", "n_words"])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``shard, bin, doc_id, piece, start_word, n_words``: which words of ``docs(doc_id, text)`` fill which bin.

    Documents are spread over shards of about ``shard_docs`` by a hash of
    doc_id, and each shard is packed by itself in doc_id order; (shard, bin)
    names a bin. A document of more than ``capacity`` words is cut into pieces
    of that many and a rest, so no word is lost or cut.

    Null texts, texts without a word and null doc_ids give no row; repeated
    rows are packed once each; other columns aren't read; an empty table gives
    an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    shards = max(1, math.ceil(docs.count() / shard_docs))
    sized = slim.mapInArrow(_counted, "doc_id long, n_words long").filter("n_words > 0")
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    def pack(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        doc, size = table.column("doc_id").to_numpy(), table.column("n_words").to_numpy()
        order = np.lexsort((size, doc))
        doc, size = doc[order], size[order]
        pieces = -(-size // capacity)
        row = np.repeat(np.arange(len(doc)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        words = np.minimum(capacity, size[row] - piece * capacity)
        bins = pack_sizes(words.tolist(), capacity)
        return pa.table({"shard": pa.array(np.full(len(row), shard), pa.int64()), "bin": pa.array(bins, pa.int64()), "doc_id": pa.array(doc[row]), "piece": pa.array(piece, pa.int64()), "start_word": pa.array(piece * capacity, pa.int64()), "n_words": pa.array(words, pa.int64())})

    return sized.groupBy("shard").applyInArrow(pack, "shard long, bin long, doc_id long, piece long, start_word long, n_words long")
