"""A folder of files as a table ``id, name, content``."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Gets a file's path and bytes, gives its text.
Reader = Callable[[str, bytes], str]


def read_text(path: str, content: bytes) -> str:
    return content.decode("utf-8", "replace")


def read_files(spark: SparkSession, location: str, extension: str | Iterable[str] | Callable[[str], bool] | None = None, exclude: Iterable[str] = (), reader: Reader = read_text, keep: Callable[[DataFrame], DataFrame] | None = None, change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``id, name, content, path`` of the files below ``location``.

    ``extension`` is an ending of names, several, or a function of the path;
    ``exclude`` holds file names. ids count from 1 in order of path. ``keep`` and
    ``change`` are applied to the table, in that order. Names are decided before
    contents are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("name"), "content")
    if callable(extension):

        @F.pandas_udf("boolean")
        def wanted(paths: pd.Series) -> pd.Series:
            return paths.map(lambda p: bool(extension(p)))

        rows = rows.filter(wanted("path"))
    elif extension is not None:
        ends = [extension] if isinstance(extension, str) else list(extension)
        rows = rows.filter(F.expr("false") if not ends else _any([F.col("name").endswith(e) for e in ends]))
    if exclude := list(exclude):
        rows = rows.filter(~F.col("name").isin(exclude))
    ids = _numbered(rows.select("path"))

    @F.pandas_udf("string")
    def text(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([reader(p, bytes(c)) for p, c in zip(paths, contents)], dtype="object")

    table = rows.withColumn("content", text("path", "content")).join(ids, "path").select("id", "name", "content", "path")
    for step in (keep, change):
        table = step(table) if step else table
    return table


def _numbered(paths: DataFrame) -> DataFrame:
    """``path, id`` with ids from 1 in order of path: paths are sorted in ranges, and each range counts on from those before it."""
    part = F.spark_partition_id()
    ranged = paths.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", part).persist()
    before, sizes = 0, {}
    for r in ranged.groupBy("part").count().orderBy("part").collect():
        sizes[r["part"]], before = before, before + r["count"]
    begin = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]) if sizes else F.create_map(F.lit(0), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    return ranged.select("path", (F.element_at(begin, F.col("part")) + nth).cast("long").alias("id"))


def filemap(files: DataFrame) -> DataFrame:
    """``doc_id, path``."""
    return files.select(F.col("id").alias("doc_id"), "path")


def _any(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
