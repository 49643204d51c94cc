"""Naive Bayes text classification with add-one smoothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.functions.stemmers import stemmed
from lexigrain.functions.tokenizers import tokenizer
from lexigrain.operators.index import spread


@dataclass(frozen=True)
class BayesModel:
    """``class_docs``: label, n, first (place of the label among equals); ``class_words``: label, term, n."""

    class_docs: DataFrame
    class_words: DataFrame
    tokenizer: str = "default"
    stemmer: str = "no"

    def save(self, path: str) -> None:
        self.class_docs.write.mode("overwrite").parquet(f"{path}/class_docs")
        self.class_words.write.mode("overwrite").parquet(f"{path}/class_words")
        rows = [(self.tokenizer, self.stemmer)]
        self.class_docs.sparkSession.createDataFrame(rows, "tokenizer string, stemmer string").coalesce(1).write.mode("overwrite").parquet(f"{path}/analysis")


def load_model(spark: SparkSession, path: str) -> BayesModel:
    by = spark.read.parquet(f"{path}/analysis").first()
    return BayesModel(spark.read.parquet(f"{path}/class_docs"), spark.read.parquet(f"{path}/class_words"), by["tokenizer"], by["stemmer"])


def _terms(rows: DataFrame, key: str, text: str, by: str, stem: str) -> DataFrame:
    """``key, term, n``: how often each term comes in the rows of a key. Stems are taken of the distinct words and joined back."""
    words = rows.select(F.col(key), F.explode(tokenizer(by).tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    if stem == "no":
        return words
    stems = words.select("term").distinct().withColumn("stem", stemmed(F.col("term"), stem))
    return words.join(stems, "term").groupBy(key, F.col("stem").alias("term")).agg(F.sum("n").alias("n"))


def train(examples: DataFrame, text: str = "text", label: str = "label", order: str | None = None, tokenizer_name: str = "default", stemmer_name: str = "no") -> BayesModel:
    """Count documents and words by label. ``order`` names a column that tells which label was learned first; else labels go by themselves."""
    known = examples.filter(F.col(label).isNotNull())
    rank = F.min(F.col(order)) if order else F.min(F.col(label))
    docs = known.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), rank.alias("first"))
    words = _terms(known, label, text, tokenizer_name, stemmer_name).select(F.col(label).alias("label"), "term", "n")
    return BayesModel(docs, words, tokenizer_name, stemmer_name)


def learn_more(model: BayesModel, examples: DataFrame, text: str = "text", label: str = "label") -> BayesModel:
    """The model after further examples; labels keep their places."""
    more = train(examples, text, label, None, model.tokenizer, model.stemmer)
    seen = model.class_docs.select("label")
    late = more.class_docs.join(seen, "label", "left_anti").select("label", "n", F.lit(None).cast(model.class_docs.schema["first"].dataType).alias("first"))
    old = more.class_docs.join(seen, "label", "left_semi").select("label", "n", F.lit(None).cast(model.class_docs.schema["first"].dataType).alias("first"))
    docs = model.class_docs.unionByName(old).unionByName(late).groupBy("label").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    words = model.class_words.unionByName(more.class_words).groupBy("label", "term").agg(F.sum("n").alias("n"))
    return BayesModel(docs, words, model.tokenizer, model.stemmer)


def log_likelihoods(model: BayesModel, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, label, likelihood``: log of prior times the words' smoothed shares, for every row and label.

    A word that a label lacks adds the logarithm of one over the label's words
    and the vocabulary, so only words that a label has need a join; the rest is
    a product of counts. Texts are spread by key and their words counted there,
    so that counts move once, to the model's words.
    """
    vocabulary = model.class_words.select("term").distinct().agg(F.count("*").alias("v"))
    totals = model.class_words.groupBy("label").agg(F.sum("n").alias("words"))
    all_docs = model.class_docs.agg(F.sum("n").alias("docs"))
    labels = model.class_docs.join(totals, "label", "left").crossJoin(F.broadcast(vocabulary)).crossJoin(F.broadcast(all_docs))
    labels = labels.select("label", "first", F.log(F.col("n") / F.col("docs")).alias("prior"), F.log((F.coalesce("words", F.lit(0)) + F.col("v")).cast("double")).alias("base"))
    texts = spread(rows.select(key, text), key)
    sized = texts.select(key, F.size(tokenizer(model.tokenizer).tokens(F.col(text))).alias("size"))
    terms = _terms(texts, key, text, model.tokenizer, model.stemmer).withColumnRenamed("n", "times")
    shared = terms.join(model.class_words, "term").groupBy(key, "label").agg(F.sum(F.col("times") * F.log((F.col("n") + 1).cast("double"))).alias("gain"))
    every = sized.crossJoin(F.broadcast(labels))
    return every.join(shared, [key, "label"], "left").select(key, "label", "first", (F.col("prior") - F.when(F.col("size") > 0, F.col("size") * F.col("base")).otherwise(F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("likelihood"))


def predict(model: BayesModel, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, label, likelihood`` of the likeliest label of each row; of equals the one learned first."""
    best = Window.partitionBy(key).orderBy(F.desc(F.round("likelihood", 9)), F.asc_nulls_last("first"), "label")
    return log_likelihoods(model, rows, key, text).withColumn("nth", F.row_number().over(best)).filter("nth = 1").select(key, "label", "likelihood")
