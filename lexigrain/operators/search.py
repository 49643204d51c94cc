"""Ranked search: terms are looked up exactly, as a beginning or fuzzily, and documents scored by their postings."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.operators.index import Index, query_terms, spread

#: Decimals of a score: the sum of many terms may differ in the last bits with their order.
DECIMALS = 9
#: Words of all queries together up to which a batch of them goes to every task; more are joined.
QUERY_WORDS = 500_000
#: Products of words and queries that are summed at once.
PRODUCTS = 1 << 22


@dataclass(frozen=True)
class SearchOptions:
    fuzziness: bool = False
    prefix_length: int = 2
    max_expansions: int = 50
    distance: int = 2
    no_limit: bool = False
    as_you_type: bool = False
    max_docs: int = 500


@dataclass(frozen=True)
class Expansion:
    """A dictionary entry for a query term, by nearness: 0 is the best."""

    term: str
    num_hits: int
    num_docs: int
    place: int


@dataclass(frozen=True)
class SearchResult:
    """``ranked``: ``doc_id, score, rank`` of the best; ``doc_scores``: ``doc_id, score`` of all."""

    ranked: DataFrame
    doc_scores: DataFrame
    began: float = field(default_factory=time.perf_counter)

    @property
    def hits(self) -> int:
        return self.doc_scores.count()

    @property
    def ids(self) -> list:
        return [r["doc_id"] for r in self.ranked.orderBy("rank").collect()]

    @property
    def execution_time(self) -> str:
        return f"{(time.perf_counter() - self.began) * 1000:.3f} ms"


def lookup_exact(words: DataFrame, keyword: str) -> DataFrame:
    """The dictionary entry of a keyword, in lower case. Wildcards in it have no meaning."""
    return words.filter(F.col("term") == keyword.lower())


def lookup_prefix(words: DataFrame, keyword: str) -> DataFrame:
    """The shortest term that begins with a keyword; of equally long ones the most frequent."""
    return words.filter(F.col("term").startswith(keyword.lower())).orderBy(F.length("term"), F.desc("num_hits"), "term").limit(1)


def fuzzy_terms(words: DataFrame, keyword: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """``term, num_hits, num_docs, distance`` of terms near a keyword, the nearest first.

    Compared are the ``max_expansions`` most frequent terms with the same first
    characters.
    """
    key = keyword.lower()
    alike = words.filter(F.col("term").startswith(key[: options.prefix_length])).orderBy(F.desc("num_hits"), "term").limit(options.max_expansions)
    return alike.withColumn("distance", F.levenshtein("term", F.lit(key))).filter(F.col("distance") <= options.distance).orderBy("distance", F.desc("num_hits"), "term")


def expansions(words: DataFrame, keywords: list[str], options: SearchOptions = SearchOptions()) -> list[list[Expansion]]:
    """The entries that each query term stands for, found in one pass over the dictionary.

    With ``as_you_type`` the last keyword is a beginning. At most
    ``max_expansions`` and one rows for each keyword come to the driver.
    """
    asked: list[tuple[str, str]] = []  # what is looked up how
    wanted = []
    for at, keyword in enumerate(keywords):
        own = [("prefix" if options.as_you_type and at == len(keywords) - 1 else "exact", keyword.lower())]
        if options.fuzziness:
            own.append(("fuzzy", keyword.lower()))
        wanted.append(own)
        asked += [x for x in own if x not in asked]
    if not asked:
        return []
    term = F.col("term")
    fits = [term == key if kind == "exact" else term.startswith(key if kind == "prefix" else key[: options.prefix_length]) for kind, key in asked]
    looked = F.filter(F.array(*[F.when(fit, F.lit(i)) for i, fit in enumerate(fits)]), lambda x: x.isNotNull())
    rows = words.filter(reduce(or_, fits)).select("term", "num_hits", "num_docs", F.explode(looked).alias("asked"))
    short = F.when(F.col("asked").isin([i for i, (kind, _) in enumerate(asked) if kind == "prefix"]), F.length("term")).otherwise(F.lit(0))
    nth = F.row_number().over(Window.partitionBy("asked").orderBy(short, F.desc("num_hits"), "term"))
    most = F.when(F.col("asked").isin([i for i, (kind, _) in enumerate(asked) if kind == "fuzzy"]), F.lit(options.max_expansions)).otherwise(F.lit(1))
    keys = F.array(*[F.lit(key) for _, key in asked])
    rows = rows.withColumn("nth", nth).filter((F.col("nth") <= options.max_expansions + 1) & (F.col("nth") <= most))
    found: dict[tuple[str, str], list] = {x: [] for x in asked}
    for r in rows.withColumn("distance", F.levenshtein("term", F.element_at(keys, F.col("asked") + 1))).collect():
        if asked[r["asked"]][0] != "fuzzy" or r["distance"] <= options.distance:
            found[asked[r["asked"]]].append(r)
    out = []
    for own in wanted:
        entries = list(found[own[0]])
        if len(own) > 1 and (not entries or options.no_limit):
            seen = {r["term"] for r in entries}
            entries += [r for r in sorted(found[own[1]], key=lambda r: (r["distance"], -r["num_hits"], r["term"])) if r["term"] not in seen]
        out.append([Expansion(r["term"], r["num_hits"], r["num_docs"], i) for i, r in enumerate(entries)])
    return out


def scores(index: Index, phrase: str, options: SearchOptions = SearchOptions(), words: DataFrame | None = None) -> DataFrame:
    """``doc_id, score`` of all documents that hold a term of the phrase.

    A term of the query that comes twice counts twice. The inverse document
    frequency is that of the term's best entry, whichever entry a document holds.
    Of each query term the ``max_docs`` postings with the nearest entries and the
    most hits count, all with ``no_limit``.
    """
    spark = index.postings.sparkSession
    tokens = query_terms(spark, phrase, index.analysis)
    if words is None and index.some and not (options.fuzziness or options.as_you_type):
        index = replace(index, postings=index.postings_of(sorted({t.lower() for t in tokens})))
    words = index.wordlist if words is None else words
    rows = [(at, e.term, e.place, found[0].num_docs) for at, found in enumerate(expansions(words, tokens, options)) for e in found]
    query = spark.createDataFrame(rows, "at int, term string, place int, df long")
    idf = F.log(F.lit(float(index.total_documents)) / F.greatest(F.lit(1), "df")) if index.total_documents else F.lit(0.0)
    terms = sorted({r[1] for r in rows})
    matched = index.postings.filter(F.col("term").isin(terms)).join(F.broadcast(query.withColumn("idf", idf)), "term")
    if not options.no_limit:
        best = Window.partitionBy("at").orderBy("place", F.desc("hit_count"), "doc_id")
        matched = matched.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= options.max_docs)
    gain = F.col("idf") * (2 * F.col("hit_count")) / (1 + F.col("hit_count"))
    return matched.groupBy("doc_id").agg(F.round(F.sum(gain), DECIMALS).alias("score"))


def top(of: DataFrame, limit: int = 100) -> DataFrame:
    """``doc_id, score, rank`` of the best ``limit`` documents; ties by id."""
    best = of.orderBy(F.desc("score"), "doc_id").limit(abs(limit))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def search(index: Index, phrase: str, limit: int = 100, options: SearchOptions = SearchOptions(), words: DataFrame | None = None) -> SearchResult:
    began = time.perf_counter()
    all_scores = scores(index, phrase, options, words)
    return SearchResult(top(all_scores, limit), all_scores, began)


def search_files(index: Index, phrase: str, limit: int = 100, options: SearchOptions = SearchOptions()) -> DataFrame:
    """``doc_id, path, rank``: the files of the best documents; the path is null where the file isn't known."""
    ranked = search(index, phrase, limit, options).ranked.select("doc_id", "rank")
    return ranked.join(index.filemap.select("doc_id", "path"), "doc_id", "left")


def _expanded(asked: DataFrame, words: DataFrame, options: SearchOptions) -> DataFrame:
    """``key, last, term, place, df`` for ``asked(key, last)``: what ``expansions`` finds, for many keys in one plan.

    Terms and keys meet by their first characters, so no key sees the whole dictionary.
    """
    first = 3 if options.as_you_type else 0
    reach = max(first, options.prefix_length if options.fuzziness else 0)
    exact = asked.join(words, asked["key"] == words["term"]).select("key", "last", "term", "num_hits", "num_docs")
    if reach:
        begins = words.withColumn("begin", F.explode(F.array_distinct(F.array(*[F.substring("term", 1, i) for i in range(1, reach + 1)]))))
    if options.as_you_type:
        typed = asked.filter("last").withColumn("begin", F.substring("key", 1, first)).join(begins, "begin").filter(F.col("term").startswith(F.col("key")))
        shortest = Window.partitionBy("key", "last").orderBy(F.length("term"), F.desc("num_hits"), "term")
        typed = typed.withColumn("nth", F.row_number().over(shortest)).filter("nth = 1").select(exact.columns)
        exact = exact.filter(~F.col("last")).unionByName(typed)
    found = exact.withColumn("place", F.lit(0))
    if options.fuzziness:
        near = asked.withColumn("begin", F.substring("key", 1, options.prefix_length)).join(begins, "begin")
        frequent = Window.partitionBy("key", "last").orderBy(F.desc("num_hits"), "term")
        near = near.withColumn("nth", F.row_number().over(frequent)).filter(F.col("nth") <= options.max_expansions).withColumn("distance", F.levenshtein("term", "key")).filter(F.col("distance") <= options.distance)
        known = exact.select("key", "last", F.col("term").alias("known"))
        near = near.join(known, ["key", "last"], "left").filter(F.col("known").isNull() | (F.lit(options.no_limit) & (F.col("known") != F.col("term"))))
        nearest = Window.partitionBy("key", "last").orderBy("distance", F.desc("num_hits"), "term")
        found = found.unionByName(near.withColumn("place", F.row_number().over(nearest)).select(*exact.columns, "place"))
    best = Window.partitionBy("key", "last").orderBy("place")
    return found.withColumn("df", F.first("num_docs").over(best)).select("key", "last", "term", "place", "df")


def search_many(index: Index, phrases: DataFrame, limit: int = 100, words: DataFrame | None = None, options: SearchOptions = SearchOptions(no_limit=True)) -> DataFrame:
    """``query_id, doc_id, score, rank`` for each of ``phrases(query_id, phrase)``, in one plan: what ``search`` finds for each with these options."""
    from lexigrain.functions.stemmers import stemmed
    from lexigrain.functions.tokenizers import tokenizer

    tokens = phrases.select("query_id", tokenizer(index.analysis.tokenizer).tokens(F.col("phrase")).alias("tokens"))
    asked = tokens.select("query_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "word")).withColumn("last", (F.col("at") == F.col("n") - 1) & F.lit(options.as_you_type))
    asked = asked.groupBy("query_id", "word", "last").agg(F.count("*").alias("times"))
    asked = asked.withColumn("key", F.lower(stemmed(F.col("word"), index.analysis.stemmer))).groupBy("query_id", "key", "last").agg(F.sum("times").alias("times"))
    plain = (T.IntegralType, T.StringType)
    if options.no_limit and not (options.fuzziness or options.as_you_type) and all(isinstance(of.schema[c].dataType, plain) for of, c in ((asked, "query_id"), (index.postings, "doc_id"))):
        few = asked.select("query_id", "key", "times").limit(QUERY_WORDS + 1).collect()
        if len(few) <= QUERY_WORDS:
            return _best(_scored_by_document(index, few, asked.select("query_id").schema, abs(limit), words), limit)
    words = index.wordlist if words is None else words
    found = _expanded(asked.select("key", "last").distinct(), words, options)
    matched = asked.join(found, ["key", "last"]).join(index.postings, "term")
    if not options.no_limit:
        best = Window.partitionBy("query_id", "key", "last").orderBy("place", F.desc("hit_count"), "doc_id")
        matched = matched.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= options.max_docs)
    idf = F.log(F.lit(float(max(1, index.total_documents))) / F.greatest(F.lit(1), "df"))
    gain = F.col("times") * idf * (2 * F.col("hit_count")) / (1 + F.col("hit_count"))
    scored = matched.groupBy("query_id", "doc_id").agg(F.round(F.sum(gain), DECIMALS).alias("score"))
    return _best(scored, limit)


def _best(scored: DataFrame, limit: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= abs(limit))


def _scored_by_document(index: Index, asked: list, queries: T.StructType, limit: int, words: DataFrame | None) -> DataFrame:
    """``query_id, doc_id, score`` of at least the best ``limit`` documents of each query; ``asked``: ``query_id, key, times``.

    The postings of the queries' words lie by document, and a task adds up the
    products of a document's words with all queries: no row is made for a word of
    a query in a document, and none for a document that is surely not among the best.
    """
    spark = index.postings.sparkSession
    coded = lambda terms: spark.createDataFrame(list(zip(terms, range(len(terms)))), "term string, code int")
    terms = sorted({r["key"] for r in asked})
    codes = coded(terms)
    found = words.join(F.broadcast(codes), "term").select("code", F.col("num_docs").alias("df")) if words is not None else index.hits(codes).groupBy("code").agg(F.count("*").alias("df"))
    df = {terms[r["code"]]: r["df"] for r in found.collect()}
    terms, ids = sorted(df), list(dict.fromkeys(r["query_id"] for r in asked))
    code, at = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(ids)}
    known = sorted((code[r["key"]], at[r["query_id"]], r["times"] * math.log(max(1, index.total_documents) / max(1, df[r["key"]]))) for r in asked if r["key"] in code)
    starts = np.searchsorted(np.array([c for c, _, _ in known], dtype=np.int64), np.arange(len(terms) + 1))
    scorer = _scorer(starts, np.array([q for _, q, _ in known], dtype=np.int64), np.array([w for _, _, w in known]), max(1, len(ids)), max(1, limit))
    hits = spread(index.hits(coded(terms)), "doc_id").sortWithinPartitions("doc_id")
    scores = hits.mapInArrow(scorer, T.StructType([hits.schema["doc_id"], T.StructField("at", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    named = spark.createDataFrame([(i, q) for i, q in enumerate(ids)], T.StructType([T.StructField("at", T.IntegerType()), *queries]))
    return scores.join(F.broadcast(named), "at").select("query_id", "doc_id", F.round("score", DECIMALS).alias("score"))


def _scorer(starts: np.ndarray, queries: np.ndarray, weights: np.ndarray, n: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of ``doc_id, code, hit_count`` by ``doc_id``: ``doc_id, at, score``. The word ``code`` has the ``queries`` and ``weights`` from ``starts[code]`` to the next start."""
    sizes = np.diff(starts)

    def begins(ids: pa.Array) -> np.ndarray:
        """Where documents begin."""
        none = pc.is_null(ids).to_numpy(zero_copy_only=False)
        other = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) | (none[1:] != none[:-1])
        return np.flatnonzero(np.concatenate([[True], other]))

    def scored(rows: pa.Table, first: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        code, hits = (rows[c].to_numpy() for c in ("code", "hit_count"))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
        size, gain = sizes[code], 2 * hits / (1 + hits)
        to = np.arange(size.sum()) + np.repeat(starts[code] - np.cumsum(size) + size, size)
        cell = np.repeat(of * n, size) + queries[to]
        sums = np.bincount(cell, np.repeat(gain, size) * weights[to], len(first) * n)
        there = np.bincount(cell, minlength=len(first) * n) > 0
        sums = np.where(there, sums, -np.inf).reshape(-1, n)
        if len(first) >= limit:
            np.maximum(least, np.partition(sums, len(first) - limit, axis=0)[len(first) - limit], out=least)
        document, at = np.nonzero(there.reshape(-1, n) & (sums >= least - 10.0 ** (1 - DECIMALS)))  # equal when rounded may differ before
        return pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks().take(pa.array(first[document])), pa.array(at.astype(np.int32)), pa.array(sums[document, at])], ["doc_id", "at", "score"])

    def pieces(rows: pa.Table, last: bool) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
        """Whole documents of at most ``PRODUCTS`` products, or one; then the rows of the last document, which may go on."""
        first = begins(rows["doc_id"].combine_chunks())
        ends = np.append(first[1:], rows.num_rows)[: len(first) if last else len(first) - 1]
        cost = np.append(0, np.cumsum(sizes[rows["code"].to_numpy()]))[ends] + n * np.arange(1, len(ends) + 1)
        done, paid = 0, 0
        while done < len(ends):
            to = max(done + 1, int(np.searchsorted(cost, paid + PRODUCTS, "right")))
            yield rows.slice(first[done], ends[to - 1] - first[done]), first[done:to] - first[done]
            done, paid = to, cost[to - 1]
        if not last:
            yield rows.slice(first[-1]), None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, rest = np.full(n, -np.inf), None
        for batch in batches:
            if batch.num_rows:
                new = pa.Table.from_batches([batch])
                for rows, first in pieces(pa.concat_tables([rest, new]).combine_chunks() if rest is not None else new, False):
                    if first is None:
                        rest = rows
                    else:
                        yield scored(rows, first, least)
        if rest is not None:
            for rows, first in pieces(rest, True):
                yield scored(rows, first, least)

    return score
