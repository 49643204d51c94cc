"""Quality classifier: regularised quadratic discriminant analysis."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import rows_of

#: At most so many labelled documents train the model, those with the smallest hash of doc_id.
MAX_TRAIN = 20_000
#: Shrinkage of a class covariance towards the pooled one, and then towards a multiple of the identity.
POOL, RIDGE = 0.5, 0.1
#: Share of accepted training documents that the cut-off may lose.
LOSS = 0.0005

_ALPHA = np.zeros(256, bool)
_UPPER = np.zeros(256, bool)
_DIGIT = np.zeros(256, bool)
_PUNCT = np.zeros(256, bool)
_SPACE = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
for _c in ".,;:'\"?()-":
    _PUNCT[ord(_c)] = True
for _c in " \t\r\n\v\f":
    _SPACE[ord(_c)] = True
_ALPHA[ord("a") : ord("z") + 1] = True
_ALPHA[128:] = True
_SYMBOL = ~(_ALPHA | _UPPER | _DIGIT | _PUNCT | _SPACE)
_CLASSES = np.stack([_UPPER, _DIGIT, _PUNCT, _SPACE, _SYMBOL]).astype(np.float64)
#: What the shares are drawn towards, by the weight of so many bytes or words: short texts say little.
_USUAL, _BYTES, _WORDS = np.array([0.02, 0.002, 0.02, 0.18, 0.002]), 150, 30
FEATURES = ("upper", "digit", "punctuation", "space", "symbol", "word_length", "repeats", "richness", "lines")


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, over its whole length."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = _CLASSES @ np.bincount(raw, minlength=256)
    shares = np.sqrt((counts + _USUAL * _BYTES) / (len(raw) + _BYTES))
    words = text.split()
    n = len(words)
    same = sum(map(operator.eq, words, words[1:]))
    kinds = len(set(words))
    lines = text.split("\n")
    again = len(lines) - len(set(lines))
    return [
        *shares.tolist(),
        float(np.log((len(raw) - counts[3] + 5.0 * _WORDS) / (n + _WORDS))),
        ((same + 0.01 * _WORDS) / (n + _WORDS)) ** 0.5,
        float(np.log((n + _WORDS) / (kinds + _WORDS)) / np.log(n + _WORDS)),
        (again / (len(lines) + 5)) ** 0.5,
    ]


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussian classes; ``roots`` are the inverses of the covariances' Cholesky factors."""

    means: np.ndarray
    roots: np.ndarray
    offset: float
    threshold: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with the priors."""
        d = [(((x - m) @ r.T) ** 2).sum(axis=1) for m, r in zip(self.means, self.roots)]
        return 0.5 * (d[0] - d[1]) + self.offset


def fit(x: np.ndarray, y: np.ndarray, pool: float = POOL, ridge: float = RIDGE, loss: float = LOSS) -> Discriminant | None:
    """The model; none where a class has no document. Statistics are scaled by their pooled spread first."""
    parts = [x[y == c] for c in (0, 1)]
    if not all(len(p) for p in parts):
        return None
    means = np.stack([p.mean(axis=0) for p in parts])
    scatter = [(p - m).T @ (p - m) for p, m in zip(parts, means)]
    pooled = sum(scatter) / len(x)
    scale = np.sqrt(np.diag(pooled)) + 1e-6
    roots, logdet = [], []
    for p, s in zip(parts, scatter):
        cov = ((1 - pool) * s + pool * pooled * len(p)) / len(p) / np.outer(scale, scale)
        cov = (1 - ridge) * cov + ridge * (np.trace(cov) / len(cov) + 1e-3) * np.eye(len(cov))
        low = np.linalg.cholesky(cov)
        roots.append(np.linalg.solve(low, np.eye(len(low))) / scale)
        logdet.append(np.log(np.diag(low)).sum())
    model = Discriminant(means, np.stack(roots), logdet[0] - logdet[1] + float(np.log(len(parts[1]) / len(parts[0]))))
    return Discriminant(model.means, model.roots, model.offset, min(0.0, float(np.quantile(model.score(parts[1]), loss))))


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in rows_of(batch):
            x = [statistics(t) for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(x, pa.list_(pa.float64()))], ["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Discriminant | None:
    """A model from at most ``max_train`` labelled documents.

    Labels other than 0 and 1 are left out, as are labels of unknown
    documents, null ids and null texts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = slim.join(F.broadcast(sample), "doc_id").select("quality", "text").mapInArrow(_stats_rows, "quality int, x array<double>").toArrow()
    if not rows.num_rows:
        return None
    return fit(np.array(rows.column("x").to_pylist()), rows.column("quality").to_numpy())


def _scores(model: Discriminant | None, texts: list[str | None]) -> np.ndarray:
    """Null texts score minus infinity; without a model all other texts score 0."""
    out = np.full(len(texts), -np.inf)
    at = [i for i, t in enumerate(texts) if t is not None]
    if at:
        out[at] = model.score(np.array([statistics(texts[i]) for i in at])) if model else 0.0
    return out


def score_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, score, keep`` for each row of ``docs(doc_id, text)``.

    ``score`` is the log density of good documents less that of bad ones;
    ``keep`` tells whether it reaches the threshold, which is 0 or, if lower,
    the score that all but ``LOSS`` of the good training documents reach. A
    null text scores minus infinity and isn't kept; an empty text is scored
    like another; with no labelled document of one class every text scores 0
    and is kept; rows repeat as they come; a null doc_id stays null.
    """
    model = train(docs, labels, max_train)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in rows_of(batch):
                s = _scores(model, piece.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(s), pa.array(s >= (model.threshold if model else 0.0))], ["doc_id", "score", "keep"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rows, "doc_id long, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` keeps, with all their columns.

    Rows with a null text go; repeated rows and rows with a null doc_id are
    judged as others are; a text may have any length.
    """
    model = train(docs, labels, max_train)
    names = docs.columns
    text = names.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in rows_of(batch):
                s = _scores(model, piece.column(text).to_pylist())
                yield piece.filter(pa.array(s >= (model.threshold if model else 0.0)))

    return docs.mapInArrow(kept, kinds)
