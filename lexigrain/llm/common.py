"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name that isn't in ``taken`` (names clash without regard to case)."""
    lower = {c.lower() for c in taken}
    name, k = base, 0
    while name.lower() in lower:
        k += 1
        name = f"{base}_{k}"
    return name


#: Spark removes an execution's shuffle files as it ends, instead of whenever the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``. Only a session that runs on one machine may be without one and gets a temporary folder."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexigrain-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder. The shuffle files that led to it go at once."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting counts for plans made from now on
    finally:
        spark.conf.set(_CLEAN, before)


def released(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing will read again."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, by Catalyst's estimate (file bytes for a scan); counted, where a source has none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if known < 1 << 60:
        return known
    long = [F.coalesce(F.sum(F.octet_length(F.col(f"`{f.name}`"))), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    return sum(df.agg(F.count("*") * 8 * len(df.columns), *long).first())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(df: DataFrame, bytes_each: int) -> int:
    """A bucket count that grows with the input, never under the shuffle partitions."""
    return max(shuffle_partitions(df.sparkSession), math.ceil(input_bytes(df) / bytes_each))


#: Buckets that one pass sends to, so that what a task sends to each stays large; more are reached in several passes. Bytes that a task of a further pass gathers.
FAN, SPLIT_BYTES = 2048, 64 << 20

_SENT = "bucket int, data binary"


def first_width(buckets: int) -> int:
    """How many buckets, next to each other, the first pass sends to as one: a power of ``FAN``."""
    width = 1
    while math.ceil(buckets / width) > FAN:
        width *= FAN
    return width


def packed_sections(parts: Iterable[tuple[int, bytes]], width: int, press: zstandard.ZstdCompressor) -> pa.RecordBatch:
    """``bucket, data``: payloads by bucket, those of ``width`` buckets in one blob."""
    groups: dict[int, list[bytes]] = defaultdict(list)
    for number, payload in parts:
        groups[number // width] += [np.array([number, len(payload)], np.int64).tobytes(), payload]
    return pa.RecordBatch.from_arrays([pa.array(list(groups), pa.int32()), pa.array([press.compress(b"".join(x)) for x in groups.values()], pa.binary())], ["bucket", "data"])


def sections_of(blob: bytes, press: zstandard.ZstdDecompressor) -> Iterator[tuple[int, bytes]]:
    """Bucket and payload of each section."""
    raw, at = press.decompress(blob), 0
    while at < len(raw):
        number, size = np.frombuffer(raw, np.int64, 2, at).tolist()
        yield number, raw[at + 16 : at + 16 + size]
        at += 16 + size


def delivered(sent: DataFrame, width: int) -> DataFrame:
    """``bucket, data`` with single buckets, of blobs for ``width`` buckets each: a pass for each power of ``FAN``."""
    while width > 1:
        width //= FAN
        sent = sent.repartition("bucket").mapInArrow(_splitter(width), _SENT)
    return sent


def _splitter(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, squeeze, parts, held = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1), [], 0
        for batch in batches:
            for blob in batch.column("data"):
                parts += sections_of(blob.as_py(), press)
                held += len(blob.as_py())
                if held > SPLIT_BYTES // 4:  # it counts compressed bytes
                    yield packed_sections(parts, width, squeeze)
                    parts, held = [], 0
        if parts:
            yield packed_sections(parts, width, squeeze)

    return split


def rows_of(batch: pa.RecordBatch, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``max_bytes`` each, so Python objects stay few."""
    if batch.num_rows:
        step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


class WordHash(dict):
    """Memo of 64-bit word hashes; emptied when full, which costs time and changes nothing."""

    limit = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[str], memo: WordHash) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def window_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every ``k`` consecutive values, built by doubling."""
    n = len(a) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    cur, size, power, res, done = a.astype(np.uint64), 1, int(_BASE), None, 0
    while True:
        if k & size:
            part = cur[done : done + n]
            res = part.copy() if res is None else res * _U(power) + part
            done += size
        if size * 2 > k:
            return res
        cur = cur[:-size] * _U(power) + cur[size:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        size *= 2


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    size, cur = 1, a
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    rest = w - size
    return np.minimum(cur[: len(cur) - rest], cur[rest:]) if rest else cur
