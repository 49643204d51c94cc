"""Exact dedup by Grace hash partitioning.

Records are spread over buckets by a hash of their text; Spark's shuffle files
are the spill files, so a lost executor costs a rerun and nothing else. A bucket
whose distinct contents would overflow the table is split again by further hash
digits, level by level, until each bucket fits. Each bucket then streams through
an open-addressing table that compares complete contents.

A content whose copies alone overflow a table is spread over salted buckets by
the hash of doc_id. Each of these keeps one record of it, and the records meet in
the content's own bucket, so no task gets all rows of a text that a third of
them hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lexigrain.llm.common import buckets_for, fresh

#: Bytes of distinct content that one table may hold, and what a bucket of the first level should hold.
TABLE_BYTES, BUCKET_BYTES = 64 << 20, 4 << 20
#: Bits of the hash that split an overfull bucket, at each level.
DIGIT = 4


class ContentTable:
    """Open addressing with linear probing; entries are found by comparing whole contents."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.contents: list[str] = []
        self.hashes: list[int] = []

    def find_or_add(self, content: str) -> tuple[int, bool]:
        """The entry's number, and whether it is new."""
        h = xxh3_64_intdigest(content)
        mask, slots = len(self.slots) - 1, self.slots
        at = h & mask
        while (e := slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            at = (at + 1) & mask
        slots[at] = len(self.contents)
        self.contents.append(content)
        self.hashes.append(h)
        if len(self.contents) * 2 > len(slots):
            self._grow()
        return len(self.contents) - 1, True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def _digit(deeper: Column, level: int) -> Column:
    return F.pmod(F.shiftright(deeper, DIGIT * (level - 1)), F.lit(1 << DIGIT)).cast("string")


def bucketed(df: DataFrame, text: str, table_bytes: int, bucket_bytes: int) -> tuple[DataFrame, str, str | None]:
    """``df`` with its leaf bucket in a new column, and that column's name.

    If there are contents whose rows alone overflow a table, also the name of a
    column with the salt of such rows, from 1; 0 in all others.
    """
    path, salt = fresh(df.columns, "bucket"), fresh(df.columns, "salt")
    t = F.col(f"`{text}`")
    h, deep = F.xxhash64(t), F.xxhash64(t, F.lit("deeper"))
    df = df.withColumn(path, F.pmod(h, F.lit(buckets_for(df, bucket_bytes))).cast("string"))
    contents = df.select(F.col(path).alias("p"), h.alias("h"), deep.alias("h2"), F.octet_length(t).alias("n")).groupBy("p", "h", "h2").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    held = F.col("rows") * (F.col("n") + 16)
    whole = contents.groupBy("p").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.max(F.when(F.col("rows") > 1, held)).alias("most"))
    found = whole.agg(F.max((F.col("n") > table_bytes) & (F.col("kinds") > 1)).alias("over"), F.max(F.col("most") > table_bytes).alias("hot")).first()
    stats = contents
    for level in range(1, 64 // DIGIT) if found["over"] else ():
        over = stats.groupBy("p").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).filter((F.col("n") > table_bytes) & (F.col("kinds") > 1)).select("p")
        if over.isEmpty():
            break
        mark = fresh([*df.columns, "p"], "over")
        over = over.withColumn(mark, F.lit(True))
        stats = stats.join(over, "p", "left").withColumn("p", F.when(F.col(mark), F.concat_ws(".", "p", _digit(F.col("h2"), level))).otherwise(F.col("p"))).drop(mark)
        key = fresh([*df.columns, mark], "over_bucket")
        over = over.withColumnRenamed("p", key)
        df = df.join(over, df[path] == over[key], "left").withColumn(path, F.when(F.col(mark), F.concat_ws(".", F.col(path), _digit(deep, level))).otherwise(F.col(path))).drop(mark, key)
    if not found["hot"]:
        return df, path, None
    hot = contents.filter((held > table_bytes) & (F.col("rows") > 1)).select("h", "h2", F.least(F.col("rows"), F.ceil(held / table_bytes)).alias("salts"))
    names = [fresh(df.columns, c) for c in ("content", "deeper", "salts")]
    hot = hot.toDF(*names)
    df = df.join(hot, (h == hot[names[0]]) & (deep == hot[names[1]]), "left")
    return df.withColumn(salt, F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col(names[2])) + 1, F.lit(0)).cast("int")).drop(*names), path, salt


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, members = ContentTable(), []
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            e, new = table.find_or_add(text)
            if new:
                members.append([doc])
            else:
                members[e].append(doc)
    docs, keeps, copies = [], [], []
    for group in members:
        if len(group) > 1:
            keep = min(group)
            rest = [d for d in group if d != keep]
            docs += rest
            keeps += [keep] * len(rest)
            copies += [len(group)] * len(rest)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, keeps, copies)], ["doc_id", "keep_doc_id", "copies"])


def _records(path: str, salt: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a bucket: each content once, with its smallest doc_id and its number of rows."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keep, copies, place = ContentTable(), [], [], ("", 0)
        for batch in batches:
            if batch.num_rows:
                place = (batch.column(path)[0].as_py(), batch.column(salt)[0].as_py())
            for doc, text, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copies"))):
                e, new = table.find_or_add(text)
                if new:
                    keep.append(doc)
                    copies.append(n)
                else:
                    keep[e], copies[e] = min(keep[e], doc), copies[e] + n
        n = len(keep)
        yield pa.RecordBatch.from_arrays([pa.array([place[0]] * n, pa.string()), pa.array([place[1]] * n, pa.int32()), pa.array(table.contents, pa.string()), pa.array(keep, pa.int64()), pa.array(copies, pa.int64())], [path, salt, "text", "doc_id", "copies"])

    return records


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, keep_doc_id, copies`` for each row of ``docs(doc_id, text)`` whose text another document has too.

    ``keep_doc_id`` is the group's smallest doc_id, whose own rows aren't
    listed; ``copies`` counts the group's rows. Contents are compared whole.
    Rows with a null doc_id or text give no row; empty texts equal each other;
    a row repeated with its doc_id counts in ``copies`` and is listed as often
    as it comes; other columns aren't read; an empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    leaves, path, salt = bucketed(slim, "text", table_bytes, bucket_bytes)
    pairs = lambda rows: rows.groupBy(path).applyInArrow(_typed(_pairs), "doc_id long, keep_doc_id long, copies long")
    if salt is None:
        return pairs(leaves)
    hot = leaves.filter(F.col(salt) > 0)
    kinds = f"{path} string, {salt} int, text string, doc_id long, copies long"
    records = hot.withColumn("copies", F.lit(1).cast("long")).groupBy(path, salt).applyInArrow(_typed(_records(path, salt)), kinds)
    whole = records.groupBy(path).applyInArrow(_typed(_records(path, salt)), kinds).select(path, "text", F.col("doc_id").alias("keep_doc_id"), "copies")
    named = records.select(path, salt, "text").join(whole, [path, "text"])
    listed = hot.join(named, [path, salt, "text"]).filter("doc_id <> keep_doc_id").select("doc_id", "keep_doc_id", "copies")
    return pairs(leaves.filter(F.col(salt) == 0)).union(listed)


def _survivors(names: list[str], doc: int, text: int) -> Callable:
    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, best, held = ContentTable(), [], []
        for batch in batches:
            rows, entries = [], []
            ids = batch.column(doc).to_pylist()
            for r, content in enumerate(batch.column(text).to_pylist()):
                e, new = table.find_or_add(content)
                rank = (ids[r] is None, ids[r] or 0)
                if new:
                    best.append((rank, None, None))
                elif best[e][0] <= rank:
                    continue
                best[e] = (rank, len(held), len(rows))
                rows.append(r)
                entries.append(e)
            held.append((batch.take(pa.array(rows, pa.int64())), entries))
        for b, (batch, entries) in enumerate(held):
            live = [r for r, e in enumerate(entries) if best[e][1:] == (b, r)]
            yield pa.RecordBatch.from_arrays(batch.take(pa.array(live, pa.int64())).columns[: len(names)], names)

    return survivors


def drop_exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with one row of each content: the one with the smallest doc_id, nulls last.

    All columns stay. Rows with a null text all stay; empty texts equal each
    other; of rows alike in doc_id and text one stays.
    """
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    leaves, path, salt = bucketed(docs.filter(F.col("text").isNotNull()), "text", table_bytes, bucket_bytes)
    survivors = _survivors(names, names.index("doc_id"), names.index("text"))
    if salt is not None:
        first = leaves.filter(F.col(salt) > 0).groupBy(path, salt).applyInArrow(_typed(_survivors([*names, path], names.index("doc_id"), names.index("text"))), f"{kinds}, `{path}` string")
        leaves = leaves.filter(F.col(salt) == 0).drop(salt).unionByName(first)
    kept = leaves.groupBy(path).applyInArrow(_typed(survivors), kinds)
    return kept.unionByName(docs.filter(F.col("text").isNull()))


def _typed(f: Callable) -> Callable:
    """``f`` with the annotations by which Spark knows that a group comes as an iterator."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(batches)

    streamed.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return streamed
