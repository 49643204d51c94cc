"""A training corpus from raw documents: judged, freed of copies and shared passages, packed.

Odd rows: a null text goes in the first stage, and where it comes to later ones
they leave its row as it is. Empty texts are judged as others are; of several one
stays. Rows with a null doc_id are judged and freed of copies, then left as they
are, and can't be packed. Of rows alike in doc_id and text one stays, and of
copies and near copies the one with the smallest doc_id. Texts of any length are
taken whole. Other columns, whatever their names, go along up to packing; empty
tables give empty results.
"""

from __future__ import annotations

import os
import shutil
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from lexigrain.llm.common import shared_folder
from lexigrain.llm.exact_dedup import drop_exact_duplicates
from lexigrain.llm.ngram_join import keep_one_of_each_group
from lexigrain.llm.packing import pack_documents
from lexigrain.llm.quality import keep_good
from lexigrain.llm.substring_dedup import remove_passages, repeated_passages


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels beside the documents."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents that share most of their word grams."""
    return keep_one_of_each_group(docs)


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the later copies of long passages."""
    return remove_passages(docs, repeated_passages(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins that the remaining words fill."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", judge_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_shared_passages),
    ("best-fit packing", pack),
]

#: The classifier and the order of packing aren't SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written to the shared folder and read again as the next one's documents.

    Results of earlier stages go as soon as the next stage is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            _delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    local = urlsplit(path)
    if local.scheme in ("", "file") and os.path.isdir(local.path):
        shutil.rmtree(local.path)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
