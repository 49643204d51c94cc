"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the ordinary and one on the toxic
documents. Toxic documents are ordinary but for a few words, so of them the
dictionary learns from the windows that the ordinary one compresses badly. A
window of text that both dictionaries together compress better than the ordinary
one alone by some bytes, to hardly more than a frame without text takes, is
evidence, and a document with a certain share of such windows is toxic. The size
of the toxic dictionary and the three cut-offs are calibrated on labelled
documents that training didn't see. No words are picked by their counts.

A window is one word with its bounds: in a longer window the ordinary words
beside a toxic one outweigh it. Frames of one word differ by a byte or two at
most, so each character is first written as four bytes, which makes a shared
stem worth many bytes and leaves chance pairs of letters worth none. README has
the recall for windows of several words and for other ways of training.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lexigrain.llm.common import rows_of

#: At most so many labelled documents of each class train the model, those with the smallest hash of doc_id; every third calibrates it.
MAX_TOXIC, MAX_ORDINARY = 4_000, 8_000
#: Bytes of the toxic dictionary, between which calibration decides, of the ordinary one, and of the segments that training chooses.
TOXIC_BYTES, ORDINARY_BYTES, SEGMENT = (4_096, 8_192), 131_072, 16
#: The toxic dictionary learns from windows of which the ordinary one leaves more bytes than this, beyond an empty frame.
RESIDUE = 6
#: How many toxic documents missed weigh as much as one ordinary document blamed, by share of their class.
CLEAN_WEIGHT = 10.0
#: Windows a worker remembers before it starts anew.
MEMO = 700_000

_MARK = b"\x01\x02window\x03"
_APART = str.maketrans(dict.fromkeys(".,;:!?\"()[]{}*$%&#|=+/\\<>", " "))
_SETTINGS = zstandard.ZstdCompressionParameters(window_log=20, chain_log=17, hash_log=17, search_log=5, min_match=4, strategy=zstandard.STRATEGY_BTULTRA, target_length=64, write_content_size=0, write_checksum=0, write_dict_id=0)


class _Wide(dict):
    def __missing__(self, code: int) -> str:
        out = self[code] = xxh3_64_intdigest(chr(code)).to_bytes(8, "little")[:4].decode("latin-1")
        return out


_WIDE = _Wide()


def widened(text: str) -> bytes:
    """Four fixed bytes for each character."""
    return text.translate(_WIDE).encode("latin-1")


def windows(text: str) -> list[str]:
    return text.lower().translate(_APART).split()


@dataclass(frozen=True)
class Model:
    """Contents of the dictionaries; the bytes saved and the most bytes left that make a window evidence, the share of such windows that makes a document toxic."""

    ordinary: bytes
    toxic: bytes
    gain: int = 0
    left: int = 1 << 20
    share: float = 0.0


class Gains(dict):
    """Window -> bytes that the toxic dictionary saves against the ordinary one; ``NONE`` where too many bytes are left."""

    NONE = -99

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.plain, self.toxic = (self._compressor(d) for d in (model.ordinary, model.ordinary + model.toxic))
        self.most, self.empty = model.left, len(self.toxic(_MARK + widened("\n")))

    @staticmethod
    def _compressor(content: bytes) -> Callable[[bytes], bytes]:
        trained = zstandard.ZstdCompressionDict(content + _MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        trained.precompute_compress(compression_params=_SETTINGS)
        return zstandard.ZstdCompressor(dict_data=trained, compression_params=_SETTINGS).compress

    def measured(self, window: str) -> tuple[int, int]:
        """Bytes saved, and bytes left beyond those of a frame without text."""
        raw = _MARK + widened(f"\n{window}\n")
        toxic = len(self.toxic(raw))
        return len(self.plain(raw)) - toxic, toxic - self.empty

    def __missing__(self, window: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        gain, left = self.measured(window)
        gain = self[window] = gain if left <= self.most else self.NONE
        return gain


def _content(samples: list[str], size: int, segment: int) -> bytes:
    """Widened content of a dictionary trained on the samples; of too few samples for that, themselves."""
    try:
        raw = zstandard.train_dictionary(size, [s.encode() for s in samples], k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return widened("".join(samples))
    return widened(raw[raw.rindex(b"\0\0\0") + 3 :].decode("utf-8", "ignore"))  # the content follows the tables, which end in zeros


def fit(texts: list[str], toxic: list[bool]) -> Model | None:
    """The model; none where a class is missing."""
    split: dict[bool, dict[bool, list[list[str]]]] = {part: {kind: [] for kind in (False, True)} for part in (False, True)}
    seen = {}
    for text, kind in zip(texts, toxic):
        seen.setdefault(text, kind)
    number = {False: 0, True: 0}
    for text, kind in seen.items():
        if words := windows(text):
            split[number[kind] % 3 == 2][kind].append(words)
            number[kind] += 1
    learn, judge = split[False], split[True]
    if not learn[True] or not learn[False]:
        return None
    if not judge[True] or not judge[False]:
        judge = learn
    lines = lambda words: f"\n{'\n'.join(dict.fromkeys(words))}\n"
    ordinary = _content([lines(d) for d in learn[False]], ORDINARY_BYTES, SEGMENT)
    plain = Gains(Model(ordinary, b""))
    residue = {w: plain.measured(w)[1] for w in {w for d in learn[True] for w in d}}
    kinds = list({w for docs in judge.values() for d in docs for w in d})
    number_of = {w: i for i, w in enumerate(kinds)}
    places = {kind: [np.fromiter(map(number_of.__getitem__, d), np.int64, len(d)) for d in judge[kind]] for kind in judge}
    flat = {kind: np.concatenate(places[kind]) for kind in judge}
    sizes = {kind: np.array([len(d) for d in places[kind]]) for kind in judge}
    starts = {kind: np.cumsum(sizes[kind]) - sizes[kind] for kind in judge}
    best, model = np.inf, None
    odd = [kept for d in learn[True] if (kept := [w for w in d if residue[w] > RESIDUE])]
    for size in TOXIC_BYTES if odd else ():
        tried = Model(ordinary, _content([lines(d) for d in odd], size, SEGMENT))
        gains = Gains(tried)
        measured = np.array([gains.measured(w) for w in kinds])
        for left in (0, 1, 2, 3, 5, 8, 1 << 20):
            for gain in range(2, 15):
                hit = (measured[:, 0] >= gain) & (measured[:, 1] <= left)
                shares = {kind: np.add.reduceat(hit[flat[kind]].astype(np.int64), starts[kind]) / sizes[kind] for kind in judge}
                for share in (0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02):
                    cost = (shares[True] < share).mean() + CLEAN_WEIGHT * (shares[False] >= share).mean()
                    if cost < best - 1e-12:
                        best, model = cost, Model(tried.ordinary, tried.toxic, gain, left, share)
    return model


def _fit_group(table: pa.Table) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    model = fit(table.column("text").to_pylist(), [x == 1 for x in table.column("toxic").to_pylist()])
    rows = [model] if model else []
    return pa.table({"ordinary": pa.array([m.ordinary for m in rows], pa.binary()), "dirty": pa.array([m.toxic for m in rows], pa.binary()), "gain": pa.array([m.gain for m in rows], pa.int32()), "most": pa.array([m.left for m in rows], pa.int32()), "share": pa.array([m.share for m in rows], pa.float64())})


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> Model | None:
    """A model from at most so many labelled documents of each class.

    Labels other than 0 and 1, of unknown documents, null ids and null texts
    are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null")
    pick = lambda kind, n: known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick(1, max_toxic).union(pick(0, max_ordinary))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = slim.join(F.broadcast(sample), "doc_id").groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: _fit_group(t.select(["doc_id", "text", "toxic"])), "ordinary binary, dirty binary, gain int, most int, share double").collect()
    return Model(bytes(rows[0].ordinary), bytes(rows[0].dirty), rows[0].gain, rows[0].most, rows[0].share) if rows else None


_gains: dict[int, Gains] = {}


def gains_of(model: Model) -> Gains:
    """The worker's gains for a model; those of an earlier model go."""
    key = xxh3_64_intdigest(model.ordinary + b"|" + model.toxic + b"|%d" % model.left)
    if key not in _gains:
        _gains.clear()
        _gains[key] = Gains(model)
    return _gains[key]


def toxic_documents(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> DataFrame:
    """``doc_id, n_windows, n_toxic, toxic`` for each toxic row of ``docs(doc_id, text)``; ``toxic`` is true in all.

    Every window of every text, of any length, is judged. Null texts and texts without a word
    aren't toxic; a null doc_id stays null; rows repeat as they come; other
    columns aren't read; with no labelled document of one class, or an empty
    table, the result is empty.
    """
    model = train(docs, labels, max_toxic, max_ordinary)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = gains_of(model) if model else None
        for batch in batches:
            for piece in rows_of(batch):
                ids, total, bad = [], [], []
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    if gains is None or not (words := windows(text)):
                        continue
                    n = int((np.fromiter(map(gains.__getitem__, words), np.int64, len(words)) >= model.gain).sum())
                    if n >= model.share * len(words) and n:
                        ids.append(doc)
                        total.append(len(words))
                        bad.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(bad, pa.int64()), pa.array([True] * len(ids), pa.bool_())], ["doc_id", "n_windows", "n_toxic", "toxic"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return slim.mapInArrow(judge, "doc_id long, n_windows long, n_toxic long, toxic boolean")
