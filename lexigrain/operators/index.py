"""The inverted index: postings of a table, and the dictionary that follows from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.stemmers import stemmed
from lexigrain.functions.tokenizers import decode_entities, tokenizer


@dataclass(frozen=True)
class Analysis:
    """How texts become terms. Stop words and entities concern documents, not queries."""

    tokenizer: str = "default"
    stemmer: str = "no"
    stopwords: tuple[str, ...] = ()
    decode_entities: bool = False

    def tokens(self, text: Column) -> Column:
        text = F.coalesce(text.cast("string"), F.lit(""))
        return tokenizer(self.tokenizer).tokens(decode_entities(text) if self.decode_entities else text, self.stopwords)


def query_terms(spark, phrase: str, analysis: Analysis) -> list[str]:
    """The terms of a phrase, by the same columns that index documents, without stop words."""
    words = spark.range(1).select(tokenizer(analysis.tokenizer).tokens(F.lit(phrase)).alias("t")).first()["t"]
    if analysis.stemmer == "no":
        return list(words)
    from lexigrain.functions.stemmers import stemmer

    return [stemmer(analysis.stemmer)(w) for w in words]


def stem_text(spark, phrase: str, analysis: Analysis) -> list[str]:
    """Tokens of a text, each as its stem."""
    return query_terms(spark, phrase, analysis)


def text_columns(source: DataFrame, primary_key: str, include_primary_key: bool = False) -> list[str]:
    if primary_key not in source.columns:
        raise ValueError(f"no column {primary_key} in {source.columns}")
    return [c for c in source.columns if include_primary_key or c != primary_key]


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows in the session's number of partitions by columns; what is grouped by these and others needs no further shuffle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def exploded(rows: DataFrame, tokens: Column, *columns: Column) -> DataFrame:
    """``columns`` and ``term``, a row for each token."""
    return rows.select(*columns, F.explode_outer(tokens).alias("term")).filter(F.col("term").isNotNull())  # of the inner form Spark makes the tokens twice


@dataclass(frozen=True)
class Load:
    """Rows that came into an index at once. ``texts``: ``doc_id`` and a column for each text, spread by ``doc_id``; ``once``: each id comes once."""

    texts: DataFrame
    once: bool

    def tokens(self, analysis: Analysis) -> Column:
        each = [analysis.tokens(F.col(c)) for c in self.texts.columns[1:]]
        return F.concat(*each) if len(each) > 1 else each[0]

    def words(self, analysis: Analysis) -> DataFrame:
        """``doc_id, term``, a row for each token, spread by ``doc_id``."""
        return exploded(self.texts, self.tokens(analysis), F.col("doc_id"))

    def postings(self, analysis: Analysis) -> DataFrame:
        words = self.words(analysis)
        counts = words.groupBy("term", "doc_id").agg(F.count("*").alias("hit_count"))
        if analysis.stemmer == "no":
            return counts
        return counts.join(stems_of(words, analysis.stemmer), "term").groupBy(F.col("stem").alias("term"), "doc_id").agg(F.sum("hit_count").alias("hit_count"))

    def counts(self, analysis: Analysis) -> DataFrame:
        """``term, hits, docs``: of each row its tokens as hits, and its distinct tokens as documents; to be summed. No table of postings is made, only one of terms."""
        tokens = self.texts.select(self.tokens(analysis).alias("tokens"))
        both = F.array(*[F.struct(F.lit(hits).alias("hits"), F.lit(1 - hits).alias("docs"), of.alias("terms")) for hits, of in ((1, F.col("tokens")), (0, F.array_distinct("tokens")))])
        return exploded(tokens.select(F.explode_outer(both).alias("of")), F.col("of.terms"), F.col("of.hits"), F.col("of.docs"))


def load_of(source: DataFrame, primary_key: str, include_primary_key: bool = False, once: bool = False) -> Load:
    columns = text_columns(source, primary_key, include_primary_key)
    return Load(spread(source.select(F.col(f"`{primary_key}`").alias("doc_id"), *[F.col(f"`{c}`").alias(f"text_{i}") for i, c in enumerate(columns)]), "doc_id"), once)


def sized(source: DataFrame, primary_key: str) -> tuple[int, bool]:
    """Number of rows, and whether each id comes once."""
    text_columns(source, primary_key)
    key = F.col(f"`{primary_key}`")
    of = source.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids")).first()
    return of["n"], of["n"] == of["ids"]


def stems_of(words: DataFrame, stemmer: str) -> DataFrame:
    """``term, stem`` of the distinct terms."""
    return spread(words.select("term").distinct(), "term").withColumn("stem", stemmed(F.col("term"), stemmer))


def postings(source: DataFrame, primary_key: str = "id", include_primary_key: bool = False, analysis: Analysis = Analysis()) -> DataFrame:
    """``term, doc_id, hit_count``: how often each term comes in each row of ``source``, over all its columns but the key.

    The texts are shuffled by key, so a task counts the words of few rows and
    postings don't move. Stems are taken of the distinct words and joined back.
    """
    return load_of(source, primary_key, include_primary_key).postings(analysis)


def _stem_postings(load: Load, analysis: Analysis, terms: list[str]) -> DataFrame:
    """The postings of some stems: of their words alone, so that no others are counted."""
    words = load.words(analysis)
    asked = stems_of(words, analysis.stemmer).filter(F.col("stem").isin(terms))
    return words.join(F.broadcast(asked), "term").groupBy(F.col("stem").alias("term"), "doc_id").agg(F.count("*").alias("hit_count"))


def wordlist(of: DataFrame) -> DataFrame:
    """``term, num_hits, num_docs`` of postings."""
    return of.groupBy("term").agg(F.sum("hit_count").alias("num_hits"), F.count("*").alias("num_docs"))


@dataclass(frozen=True)
class Index:
    """Postings with the number of documents. Every change gives another index.

    ``loads`` are the rows it is made of, where they are at hand: changes concern
    these, and the dictionary is counted from them without postings.
    """

    postings: DataFrame
    total_documents: int
    primary_key: str = "id"
    analysis: Analysis = Analysis()
    include_primary_key: bool = False
    filemap: DataFrame | None = None
    info: dict[str, str] = field(default_factory=dict)
    some: Callable[[list[str]], DataFrame] | None = None
    loads: tuple[Load, ...] = ()

    def postings_of(self, terms: list[str]) -> DataFrame:
        """The postings of some terms; ``some`` is a shorter way to them than by all postings."""
        return self.some(terms) if self.some else self.postings.filter(F.col("term").isin(terms))

    def hits(self, codes: DataFrame) -> DataFrame:
        """``doc_id, code, hit_count``: the postings of ``codes(term, code)``, which is small; other words aren't counted."""
        if self.loads and self.analysis.stemmer == "no":
            return reduce(DataFrame.unionByName, [load.words(self.analysis).join(F.broadcast(codes), "term").groupBy("doc_id", "code").agg(F.count("*").alias("hit_count")) for load in self.loads])
        return self.postings.join(F.broadcast(codes), "term").select("doc_id", "code", "hit_count")

    @property
    def wordlist(self) -> DataFrame:
        if self.loads and self.analysis.stemmer == "no" and all(load.once for load in self.loads):
            counts = reduce(DataFrame.unionByName, [load.counts(self.analysis) for load in self.loads])
            return counts.groupBy("term").agg(F.sum("hits").alias("num_hits"), F.sum("docs").alias("num_docs"))
        return wordlist(self.postings)

    def insert(self, rows: DataFrame) -> Index:
        """Rows are added. An id that is there already isn't replaced: its postings count again."""
        n, once = sized(rows, self.primary_key)
        load = load_of(rows, self.primary_key, self.include_primary_key, once)
        return replace(self, some=None, postings=self.postings.unionByName(load.postings(self.analysis)), total_documents=self.total_documents + n, loads=self.loads and (*self.loads, load))

    def delete(self, ids: DataFrame | Sequence) -> Index:
        """Postings of the ids go; documents without postings don't lower the number of documents."""
        gone = self._ids(ids)
        if not self.loads:
            removed = self.postings.select("doc_id").join(gone, "doc_id", "left_semi").distinct().count()
            return replace(self, some=None, postings=self.postings.join(gone, "doc_id", "left_anti"), total_documents=self.total_documents - removed)
        # an aggregate, since a filter would go below the join, to the texts that stay
        found = [load.texts.join(gone, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.size(load.tokens(self.analysis))).alias("size")) for load in self.loads]
        removed = reduce(DataFrame.unionByName, found).filter("size > 0").select("doc_id").distinct().count()
        loads = tuple(replace(load, texts=load.texts.join(gone, "doc_id", "left_anti")) for load in self.loads)
        return replace(self, some=None, postings=reduce(DataFrame.unionByName, [load.postings(self.analysis) for load in loads]), total_documents=self.total_documents - removed, loads=loads)

    def update(self, rows: DataFrame) -> Index:
        """Rows replace those of the same id, or are added."""
        return self.delete(rows.select(F.col(f"`{self.primary_key}`").alias("doc_id"))).insert(rows)

    def _ids(self, ids: DataFrame | Sequence) -> DataFrame:
        kind = self.postings.schema["doc_id"].dataType
        if isinstance(ids, DataFrame):
            return ids.select(F.col(ids.columns[0]).cast(kind).alias("doc_id")).distinct()
        return self.postings.sparkSession.createDataFrame([(i,) for i in ids], "doc_id " + kind.simpleString()).distinct()

    def hits_of(self, word: str) -> int:
        """Occurrences of a term, 0 if it isn't there."""
        return term_stats(self.wordlist, word).first()["num_hits"]

    def documents_with(self, word: str) -> int:
        """Documents with a term, 0 if it isn't there."""
        return term_stats(self.wordlist, word).first()["num_docs"]


def build_index(source: DataFrame, primary_key: str = "id", include_primary_key: bool = False, analysis: Analysis = Analysis()) -> Index:
    n, once = sized(source, primary_key)
    load = load_of(source, primary_key, include_primary_key, once)
    some = None if analysis.stemmer == "no" else lambda terms: _stem_postings(load, analysis, terms)
    return Index(load.postings(analysis), n, primary_key, analysis, include_primary_key, some=some, loads=(load,))


def term_stats(words: DataFrame, word: str) -> DataFrame:
    """One row, ``num_hits, num_docs``: those of a term, or zeros."""
    return words.filter(F.col("term") == word.lower()).agg(F.coalesce(F.max("num_hits"), F.lit(0)).cast("long").alias("num_hits"), F.coalesce(F.max("num_docs"), F.lit(0)).cast("long").alias("num_docs"))


def dictionary(words: DataFrame, count: int = -1, hits: bool = True, docs: bool = False) -> DataFrame:
    """``line``: tab-separated terms with the counts asked for, most frequent first, ties by term; all of them, or ``count``."""
    line = F.concat_ws("\t", "term", *[F.col(c).cast("string") for c, wanted in (("num_hits", hits), ("num_docs", docs)) if wanted])
    ordered = words.orderBy(F.desc("num_hits"), "term")
    return (ordered.limit(count) if count > 0 else ordered).select(line.alias("line"))


def write_dictionary(words: DataFrame, path: str, count: int = -1, hits: bool = True, docs: bool = False) -> None:
    dictionary(words, count, hits, docs).write.mode("overwrite").text(path)
