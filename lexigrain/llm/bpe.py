"""Byte-pair encoding and decoding with a given vocabulary."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import rows_of

#: The installed rank file of a public byte-level vocabulary; any file of that form will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into the pieces inside which symbols are merged; public, of the same vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries a worker's memo of pieces holds before it starts anew.
MEMO = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of ``piece``: the adjacent pair of the lowest rank is merged, leftmost first, until none is left.

    Symbols are a doubly linked list over start offsets. The queue holds
    ``(rank, start, end)`` of possible merges; an entry whose start is no symbol
    any more, or whose pair no longer ends there, is stale and skipped.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    following, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    queue = []
    for i in range(n - 1):
        if (rank := ranks.get(piece[i : i + 2])) is not None:
            queue.append((rank, i, i + 2))
    heapq.heapify(queue)
    following.append(n + 1)
    while queue:
        _, i, end = heapq.heappop(queue)
        if not alive[i]:
            continue
        right = following[i]
        if right >= n or following[right] != end:
            continue
        alive[right] = False
        following[i] = end
        if end < n:
            before[end] = i
            if (rank := ranks.get(piece[i : following[end]])) is not None:
                heapq.heappush(queue, (rank, i, following[end]))
        left = before[i]
        if left >= 0 and (rank := ranks.get(piece[left:end])) is not None:
            heapq.heappush(queue, (rank, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : following[i]]])
        i = following[i]
    return out


class _Irregular(Exception):
    """A part with white space at an end: pieces may then reach over the part."""


class _Memo(dict):
    def __init__(self, encode: Callable[[str], bytes], prefix: str) -> None:
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Irregular
        if len(self) >= MEMO:
            self.clear()
        out = self[part] = self.encode(self.prefix + part)
        return out


class Codec:
    """Encodes and decodes with a rank file; ids come as little-endian 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.vocabulary = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(PATTERN).findall
        self.pieces: dict[str, bytes] = {}
        self.first, self.later = _Memo(self._encode_pieces, ""), _Memo(self._encode_pieces, " ")

    def _piece(self, piece: str) -> bytes:
        if (known := self.pieces.get(piece)) is None:
            if len(self.pieces) >= MEMO:
                self.pieces.clear()
            known = np.array(merge(piece.encode(), self.ranks), "<i4").tobytes()
            if len(piece) < 100:
                self.pieces[piece] = known
        return known

    def _encode_pieces(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.find(text)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text. A space before another character starts a piece, so parts between single spaces are encoded by themselves."""
        if not text:
            return np.empty(0, np.int32)
        start, *rest = text.split(" ")
        try:
            raw = self.first[start] + b"".join(map(self.later.__getitem__, rest))
        except _Irregular:
            raw = self._encode_pieces(text)
        return np.frombuffer(raw, "<i4")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a rank file, read once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, token_ids, n_tokens, round_trip`` for each row of ``docs(doc_id, text)``.

    ``round_trip`` tells whether the ids decode to the text again. ``path``
    names a rank file that every executor can read. Null texts have null ids
    and counts; an empty text has none, 0 and true; a null doc_id stays null;
    rows repeat as they come; other columns aren't read; an empty table gives
    an empty result.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for piece in rows_of(batch):
                ids, same = [], []
                for text in piece.column(1).to_pylist():
                    ids.append(None if text is None else coder.encode(text))
                    same.append(None if text is None else coder.decode(ids[-1].tolist()) == text)
                sizes = [None if x is None else len(x) for x in ids]
                offsets = np.cumsum([0, *(s or 0 for s in sizes)]).astype(np.int32)
                values = pa.array(np.concatenate([np.empty(0, np.int32), *(x for x in ids if x is not None)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([s is None for s in sizes]))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "token_ids", "n_tokens", "round_trip"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(encode, "doc_id long, token_ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` from ``encoded(doc_id, token_ids)``; null ids give a null text, an unknown id is an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for piece in rows_of(batch):
                texts = [None if ids is None else coder.decode(ids) for ids in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(decode, "doc_id long, text string")
