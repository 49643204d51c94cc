"""Keyphrases of documents by rapid automatic keyword extraction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.functions.stopwords import stopwords as stopwords_of
from lexigrain.operators.index import spread

#: Runs of other characters than punctuation, separators and controls, or one punctuation mark.
TOKEN = r"[^\p{P}\p{Z}\p{C}]+|\p{P}"
_PUNCTUATION = r"^[!-/:-@\[-`{-~]+$"


def rake_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def candidate_phrases(text: Column, stop: Iterable[str]) -> Column:
    """Longest runs of tokens that are neither stop words nor ASCII punctuation, each as its words joined by spaces; no shuffle."""
    stop = sorted(stop)
    marked = F.transform(rake_tokens(text), lambda t: F.when(t.isin(stop) | t.rlike(_PUNCTUATION), F.lit("\n")).otherwise(t))
    return F.filter(F.transform(F.split(F.array_join(marked, " "), "\n"), lambda p: F.trim(p)), lambda p: p != "")


def rake(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "english", stop: Iterable[str] | None = None) -> DataFrame:
    """``key, phrase, score, place``: each document's best third of phrases and one more, best first, ties by phrase.

    A word scores its degree, the lengths of its phrases summed, by its
    frequency; a phrase the sum of its words. A phrase that comes twice counts
    twice for its words and is listed once.
    """
    # the phrases, their words and both windows are all of one document: one shuffle, of the texts by it
    texts = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    found = texts.select("key", F.explode(candidate_phrases(F.col("text"), stopwords_of(language) if stop is None else stop)).alias("phrase"))
    phrases = found.groupBy("key", "phrase").agg(F.count("*").alias("times"))
    words = phrases.select("key", "phrase", "times", F.explode(F.split("phrase", " ")).alias("word"), F.size(F.split("phrase", " ")).alias("size"))
    by_word = Window.partitionBy("key", "word")
    score = F.sum(F.col("size") * F.col("times")).over(by_word) / F.sum("times").over(by_word)
    scored = words.withColumn("score", score).groupBy("key", "phrase").agg(F.round(F.sum("score"), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "phrase"))
    number = F.count("*").over(Window.partitionBy("key"))
    kept = scored.withColumn("place", place).withColumn("n", number).filter(F.col("place") <= F.ceil(F.col("n") / 3) + 1)
    return kept.select(F.col("key").alias(key), "phrase", "score", "place")
