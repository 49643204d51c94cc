"""Indexes kept in a storage folder: loads of postings, deletions, and what there is to know of the index."""

from __future__ import annotations

import json
import logging
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.operators.index import Analysis, Index, Load, load_of, sized

_log = logging.getLogger(__name__)
_VERSION = re.compile(r"info-(\d+)\.json")
#: What ranges of terms are chosen by: about so many rows, terms for each range, characters of a term.
_ROWS_FOR_RANGES, _TERMS_A_RANGE, _PREFIX = 2_000, 100, 32
#: Tokens that are counted at once, of a row at least.
_TOKENS = 1 << 22


def _counted(load: Load, analysis: Analysis, ends: np.ndarray) -> DataFrame:
    """Postings of rows whose ids come once, with their ``range``, the number of ends that aren't beyond a term's first characters. Words are counted row by row, without a table."""

    def counted(ids: pa.Array, lists: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        coded = pc.list_flatten(lists).dictionary_encode()
        key = np.repeat(np.arange(len(sizes)), sizes) * (v := max(1, len(coded.dictionary)))
        known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        key = key[known] + coded.indices.drop_null().to_numpy()
        key.sort()
        at = np.flatnonzero(np.diff(key, prepend=-1))
        row, term = (pa.array(x) for x in np.divmod(key[at], v))
        starts = pc.utf8_slice_codeunits(coded.dictionary, 0, _PREFIX).to_numpy(zero_copy_only=False).astype(ends.dtype)
        return pa.RecordBatch.from_arrays([coded.dictionary.take(term), ids.take(row), pa.array(np.diff(np.append(at, len(key)))), pa.array(np.searchsorted(ends, starts, "right").astype(np.int32)).take(term)], ["term", "doc_id", "hit_count", "range"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lists in (batch.columns for batch in batches):
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            paid, done = np.append(0, np.cumsum(sizes)), 0
            while done < len(sizes):
                to = max(done + 1, int(np.searchsorted(paid, paid[done] + _TOKENS, "right")) - 1)
                yield counted(ids[done:to], lists[done:to], sizes[done:to])
                done = to

    fields = [T.StructField("term", T.StringType()), load.texts.schema["doc_id"], T.StructField("hit_count", T.LongType()), T.StructField("range", T.IntegerType())]
    return load.texts.select("doc_id", load.tokens(analysis).alias("tokens")).mapInArrow(count, T.StructType(fields))


class IndexNotFoundError(Exception):
    """No index of that name; ``code`` is 1."""

    code = 1


def shared_storage(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares, ``spark.checkpoint.dir``; only a session on one machine may be without that."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/indexes-{uuid.uuid4().hex}"


class IndexStore:
    """Indexes by name below one folder, which may be on any file system that Spark knows.

    Postings lie in one folder for each load, ranged and sorted by term, so that
    a search reads few row groups. A deletion is a list of ids that concerns the
    loads before it; ``compact`` writes what is left as one load.

    Every change writes its folders first and then one new version of the
    index's file, ``info-<n>.json``, which lists the folders that count. A reader
    takes the newest version, so it sees all of a change or nothing, and what a
    broken-off change left behind is never read. Of two changes at once one fails.
    """

    def __init__(self, spark: SparkSession, storage: str) -> None:
        self.spark, self.storage, self.quiet = spark, storage.rstrip("/"), False

    def _told(self, name: str, step: str, meta: dict) -> None:
        """A line of progress after each step, unless ``quiet``. Rows are counted step by step, since tasks handle them and not the driver."""
        if not self.quiet:
            _log.info("index %s: %s, %d documents in %d loads", name, step, meta["total_documents"], len(meta["loads"]))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.storage}/{name}")

    def _files(self, name: str = ""):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        if not self._files().exists(self._path(name)):
            return []
        found = [_VERSION.fullmatch(f.getPath().getName()) for f in self._files().listStatus(self._path(name))]
        return sorted(int(m[1]) for m in found if m)

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def flush(self, name: str) -> None:
        """Delete an index; one that isn't there is as good as deleted."""
        self._files().delete(self._path(name), True)

    def create(self, name: str, source: DataFrame | None = None, primary_key: str = "id", include_primary_key: bool = False, analysis: Analysis = Analysis(), filemap: DataFrame | None = None, info: dict[str, str] | None = None) -> Index:
        """Make an index anew, in place of one of that name, and load ``source``."""
        before = self.meta(name) if self.exists(name) else {"next": 1}
        meta = {"primary_key": primary_key, "include_primary_key": include_primary_key, "analysis": asdict(analysis), "total_documents": 0, "next": before["next"], "loads": [], "deleted": [], "id_type": None, "info": info or {}, "filemap": None}
        if filemap is not None:
            meta["filemap"] = f"filemap-{meta['next']}"
            filemap.write.mode("overwrite").parquet(f"{self.storage}/{name}/{meta['filemap']}")
        if source is not None:
            meta = self._loaded(name, meta, source)
        self._write_meta(name, meta | {"next": meta["next"] + 1})
        self._sweep(name, meta)
        self._told(name, "created", meta)
        return self.open(name)

    def insert(self, name: str, rows: DataFrame, info: dict[str, str] | None = None) -> None:
        """Add rows as one load; ids that are there already aren't replaced. ``info`` becomes known with the load."""
        meta = self._loaded(name, self.meta(name), rows)
        self._write_meta(name, meta | {"info": meta["info"] | (info or {})})
        self._told(name, "rows inserted", meta)

    def delete(self, name: str, ids: DataFrame | Sequence) -> None:
        meta = self._freed(name, self.meta(name), ids)
        self._write_meta(name, meta)
        self._told(name, "ids deleted", meta)

    def update(self, name: str, rows: DataFrame, info: dict[str, str] | None = None) -> None:
        """Rows replace those of the same id, or are added, in one change."""
        meta = self.meta(name)
        meta = self._loaded(name, self._freed(name, meta, rows.select(meta["primary_key"])), rows)
        self._write_meta(name, meta | {"info": meta["info"] | (info or {})})
        self._told(name, "rows updated", meta)

    def compact(self, name: str) -> None:
        """Write what is left of all loads as one; the old ones go after."""
        meta = self.meta(name)
        load = meta["next"]
        self._write_postings(name, load, self.open(name).postings.repartitionByRange("term"))
        meta |= {"next": load + 1, "loads": [load], "deleted": []}
        self._write_meta(name, meta)
        self._sweep(name, meta)
        self._told(name, "compacted", meta)

    def _ranged(self, load: Load, analysis: Analysis, some: DataFrame) -> DataFrame:
        """Postings ranged by term. Spark's own ranging makes them twice, once to choose ranges; these are chosen by the words of ``some`` rows, and concern but the sizes of files."""
        if not load.once or analysis.stemmer != "no":
            return load.postings(analysis).repartitionByRange("term")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        terms = sorted(r["term"][:_PREFIX] for r in replace(load, texts=some).postings(analysis).select("term").orderBy(F.rand(0)).limit(_TERMS_A_RANGE * parts).collect())
        ends = np.array(sorted({terms[len(terms) * i // parts] for i in range(1, parts)}) if terms else [], dtype=f"U{_PREFIX}")
        return _counted(load, analysis, ends).repartitionById(len(ends) + 1, "range").select("term", "doc_id", "hit_count")

    def _write_postings(self, name: str, load: int, ranged: DataFrame) -> None:
        ranged.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{self.storage}/{name}/postings/load_id={load}")

    def _loaded(self, name: str, meta: dict, rows: DataFrame) -> dict:
        load, key, more = meta["next"], meta["primary_key"], meta["include_primary_key"]
        n, once = sized(rows, key)
        made, some = load_of(rows, key, more, once), load_of(rows.sample(min(1.0, _ROWS_FOR_RANGES / max(1, n)), 0), key, more)
        self._write_postings(name, load, self._ranged(made, self._analysis(meta), some.texts))
        return meta | {"next": load + 1, "loads": [*meta["loads"], load], "total_documents": meta["total_documents"] + n, "id_type": made.texts.schema["doc_id"].dataType.simpleString()}

    def _freed(self, name: str, meta: dict, ids: DataFrame | Sequence) -> dict:
        index, load = self.open(name), meta["next"]
        removed = index.postings.select("doc_id").join(index._ids(ids), "doc_id", "left_semi").distinct()
        path = f"{self.storage}/{name}/deleted/load_id={load}"
        removed.write.mode("overwrite").parquet(path)
        return meta | {"next": load + 1, "deleted": [*meta["deleted"], load], "total_documents": meta["total_documents"] - self.spark.read.parquet(path).count()}

    def _sweep(self, name: str, meta: dict) -> None:
        """Delete folders and versions that the newest version doesn't need."""
        newest = self._versions(name)[-1]
        for number in self._versions(name)[:-1]:
            self._files().delete(self._path(f"{name}/info-{number}.json"), False)
        keep = {f"postings/load_id={i}" for i in meta["loads"]} | {f"deleted/load_id={i}" for i in meta["deleted"]}
        for part in ("postings", "deleted"):
            if self._files().exists(self._path(f"{name}/{part}")):
                for f in self._files().listStatus(self._path(f"{name}/{part}")):
                    if f"{part}/{f.getPath().getName()}" not in keep:
                        self._files().delete(f.getPath(), True)
        for f in self._files().listStatus(self._path(name)):
            if (own := f.getPath().getName()).startswith("filemap-") and own != meta["filemap"] or own.endswith(".new") and own != f"info-{newest + 1}.json.new":
                self._files().delete(f.getPath(), True)

    def open(self, name: str) -> Index:
        """The index as it is now."""
        meta = self.meta(name)
        kind = meta["id_type"] or "bigint"

        def loads(part: str, numbers: list[int], schema: str) -> DataFrame:
            base = f"{self.storage}/{name}/{part}"
            if not numbers:
                return self.spark.createDataFrame([], schema)
            return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/load_id={i}" for i in numbers])

        rows = loads("postings", meta["loads"], f"term string, doc_id {kind}, hit_count bigint, load_id int")
        if meta["deleted"]:
            gone = loads("deleted", meta["deleted"], f"doc_id {kind}, load_id int").groupBy("doc_id").agg(F.max("load_id").alias("until"))
            rows = rows.join(gone, (rows["doc_id"] == gone["doc_id"]) & (rows["load_id"] < gone["until"]), "left_anti")
        filemap = self.spark.read.parquet(f"{self.storage}/{name}/{meta['filemap']}") if meta["filemap"] else None
        return Index(rows.select("term", "doc_id", "hit_count"), meta["total_documents"], meta["primary_key"], self._analysis(meta), meta["include_primary_key"], filemap, self.info(name))

    def info(self, name: str) -> dict[str, str]:
        """What is known of the index, by key."""
        meta = self.meta(name)
        return {"total_documents": str(meta["total_documents"]), "stemmer": meta["analysis"]["stemmer"], "tokenizer": meta["analysis"]["tokenizer"]} | meta["info"]

    def set_info(self, name: str, key: str, value: str) -> None:
        meta = self.meta(name)
        if key == "total_documents":
            meta[key] = int(value)
        elif key in ("stemmer", "tokenizer"):
            meta["analysis"][key] = value
        else:
            meta["info"][key] = value
        self._write_meta(name, meta)

    @staticmethod
    def _analysis(meta: dict) -> Analysis:
        return Analysis(**(meta["analysis"] | {"stopwords": tuple(meta["analysis"]["stopwords"])}))

    def meta(self, name: str) -> dict:
        if not (versions := self._versions(name)):
            raise IndexNotFoundError(f"no index {name} in {self.storage}")
        stream = self._files().open(self._path(f"{name}/info-{versions[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"version": versions[-1]}
        finally:
            stream.close()

    def _write_meta(self, name: str, meta: dict) -> None:
        """The next version, complete when it gets its name."""
        known = self._versions(name)
        number = meta.get("version", known[-1] if known else 0) + 1
        stream = self._files().create(self._path(f"{name}/info-{number}.json.new"), True)
        stream.write(bytearray(json.dumps({k: v for k, v in meta.items() if k != "version"}).encode()))
        stream.close()
        if number in known or not self._files().rename(self._path(f"{name}/info-{number}.json.new"), self._path(f"{name}/info-{number}.json")):
            raise RuntimeError(f"index {name} was changed by another writer at the same time")
