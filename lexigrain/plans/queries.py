"""The full-text operators as queries over whole tables, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions import highlight as H
from lexigrain.functions import strings as S
from lexigrain.functions.stemmers import STEMMERS, slavic, stemmed
from lexigrain.functions.stopwords import stopwords
from lexigrain.functions.tokenizers import TOKENIZERS, NGramTokenizer, decode_entities, padded_trigrams, tokenizer, without
from lexigrain.operators import boolean, classifier, geo, index, keywords, search
from lexigrain.operators.store import IndexStore, shared_storage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PHRASE, FUZZY, TYPED = "the worthless thatin with the hehely", "wort", "thatin wor"
_ENGLISH = sorted(stopwords("english"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _index(spark: SparkSession, sf_dir: str) -> index.Index:
    return index.build_index(_articles(spark, sf_dir), "doc_id")


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# SQL building blocks


def _words(text: str = "text", pattern: str = r"[^@\p{N}\p{Pd}\p{Pc}\p{L}]+") -> str:
    return f"list_filter(string_split_regex(lower({text}), '{pattern}'), lambda w: w <> '')"


_TOK = f"tok AS (SELECT doc_id, unnest({_words()}) AS term FROM documents)"
_DL = f"{_TOK}, dl AS (SELECT term, doc_id, count(*) AS hit_count FROM tok GROUP BY ALL)"
_WL = f"{_DL}, wl AS (SELECT term, sum(hit_count)::BIGINT AS num_hits, count(*) AS num_docs FROM dl GROUP BY term)"


def _texts(sql: str, columns: str = "doc_id, tokens") -> str:
    return f"SELECT {columns} FROM (SELECT doc_id, {sql} AS tokens FROM documents)"


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# tokens


def _tokens(name: str) -> Query:
    return lambda spark, sf_dir: _articles(spark, sf_dir).select("doc_id", TOKENIZERS[name].tokens(F.col("text")).alias("tokens"))


def _grams(least: int, most: int) -> str:
    parts = " || ".join(f"list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n}))" for n in range(least, most + 1))
    return f"flatten(list_transform({_words()}, lambda w: {parts}))"


QUERIES["tok_default"], SQL["tok_default"] = _tokens("default"), _texts(_words())
QUERIES["tok_product"], SQL["tok_product"] = _tokens("product"), _texts(_words(pattern=r"[\s,.]+"))
for _name, _n in (("bigram", 2), ("trigram", 3), ("fourgram", 4), ("fivegram", 5)):
    QUERIES[f"tok_{_name}"], SQL[f"tok_{_name}"] = _tokens(_name), _texts(_grams(_n, _n))
QUERIES["tok_edge_ngram"] = _tokens("edge_ngram")
SQL["tok_edge_ngram"] = _texts(f"flatten(list_transform({_words()}, lambda w: list_transform(range(2, length(w) + 1), lambda i: left(w, i))))")


@_query(_texts(_grams(1, 2)))
def tok_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select("doc_id", NGramTokenizer(least=1, most=2).tokens(F.col("text")).alias("tokens"))


@_query(_texts(f"list_filter({_words()}, lambda w: NOT list_contains({_quoted(_ENGLISH)}, w))"))
def tok_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select("doc_id", without(tokenizer("default").words(F.col("text")), _ENGLISH).alias("tokens"))


@_query(f"SELECT DISTINCT term, array_to_string(list_transform(range(1, length(term) + 3), lambda i: substr('__' || term || '__', i, 3)), ' ') AS trigrams FROM (SELECT unnest({_words()}) AS term FROM documents)")
def trigrams_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _articles(spark, sf_dir).select(F.explode(tokenizer("default").tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", padded_trigrams(F.col("term")).alias("trigrams"))


_RAKE_TOKENS = r"regexp_extract_all(lower(text), '[^\p{P}\p{Z}\p{C}]+|\p{P}')"


@_query(_texts(_RAKE_TOKENS))
def rake_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select("doc_id", keywords.rake_tokens(F.col("text")).alias("tokens"))


# the pages hold no other entities; an ampersand comes last, so what it makes isn't decoded again
_UNESCAPED = "regexp_replace(replace(replace(replace(html, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"


@_query(f"SELECT page_id, {_words(_UNESCAPED)} AS tokens FROM pages")
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", tokenizer("default").tokens(decode_entities(F.col("html"))).alias("tokens"))


@_query()
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stemmer over the whole vocabulary, a column each."""
    terms = _articles(spark, sf_dir).select(F.explode(tokenizer("default").tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", *[stemmed(F.col("term"), name).alias(name) for name in list(STEMMERS)[:12]])


_STRIPPED = "coalesce(list_filter({endings}, lambda e: ends_with({word}, e) AND {keep})[1], '')"


def _stripped(word: str, endings: Sequence[str], keep: str) -> str:
    """A word less the first of the endings that fits."""
    return f"left({word}, length({word}) - length({_STRIPPED.format(word=word, endings=_quoted(list(endings)), keep=keep)}))"


_POLISH = _stripped("term", [*slavic._POLISH_ENDINGS, "ek"], "length(term) - length(e) > 2 AND regexp_matches(left(term, length(term) - length(e)), '[aąeęioóuy]')")
_UKRAINIAN = _stripped("w", slavic._UKRAINIAN_ENDINGS, "length(w) - length(e) > f + 1")


@_query(f"""WITH {_TOK}, t AS (SELECT DISTINCT term, length(regexp_extract(term, '^[^аеєиіїоуюя]*')) AS f FROM tok),
u AS (SELECT *, CASE WHEN regexp_matches(term, '(ся|сь)$') AND length(term) - 2 >= f + 2 THEN left(term, length(term) - 2) ELSE term END AS w FROM t),
v AS (SELECT *, {_UKRAINIAN} AS cut FROM u)
SELECT term, term AS plain, CASE WHEN starts_with(term, 'naj') AND length(term) > 8 AND regexp_matches(term, 'sz[yae]$') THEN substr(term, 4, length(term) - 6) ELSE {_POLISH} END AS polish,
CASE WHEN regexp_matches(cut, '[іо]ст$') AND length(cut) - 3 >= f + 2 THEN left(cut, length(cut) - 3) ELSE cut END AS ukrainian FROM v""")
def stems_by_paradigm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stemmers that are lists of endings, over the whole vocabulary."""
    terms = _articles(spark, sf_dir).select(F.explode(tokenizer("default").tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", stemmed(F.col("term"), "no").alias("plain"), *[stemmed(F.col("term"), name).alias(name) for name in ("polish", "ukrainian")])


# index


@_query(f"WITH {_DL} SELECT term, doc_id, hit_count FROM dl")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(_articles(spark, sf_dir), "doc_id")


_PART = ("p_name", "p_brand", "p_type", "p_size")


@_query(f"WITH t AS (SELECT p_partkey AS doc_id, unnest({' || '.join(_words(f'{c}::VARCHAR') for c in ('p_partkey', *_PART))}) AS term FROM part) SELECT term, doc_id, count(*) AS hit_count FROM t GROUP BY ALL")
def postings_with_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns but the price, whose digits as text differ between engines."""
    return index.postings(_table(spark, sf_dir, "part").drop("p_retailprice"), "p_partkey", include_primary_key=True)


@_query(f"WITH t AS (SELECT p_partkey AS doc_id, unnest({' || '.join(_words(f'{c}::VARCHAR', '[[:space:],.]+') for c in _PART)}) AS term FROM part) SELECT term, doc_id, count(*) AS hit_count FROM t WHERE NOT list_contains({_quoted(_ENGLISH)}, term) GROUP BY ALL")
def postings_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(_table(spark, sf_dir, "part").drop("p_retailprice"), "p_partkey", analysis=index.Analysis("product", stopwords=tuple(_ENGLISH)))


@_query()
def postings_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(_articles(spark, sf_dir), "doc_id", analysis=index.Analysis(stemmer="porter"))


@_query(f"WITH {_WL} SELECT term, num_hits, num_docs FROM wl")
def wordlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.wordlist(index.postings(_articles(spark, sf_dir), "doc_id"))


@_query("SELECT count(*) AS total_documents FROM documents")
def total_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_index(spark, sf_dir).total_documents,)], "total_documents long")


@_query(f"WITH {_WL} SELECT coalesce(max(num_hits), 0)::BIGINT AS num_hits, coalesce(max(num_docs), 0)::BIGINT AS num_docs FROM wl WHERE term = 'the'")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_stats(_index(spark, sf_dir).wordlist, "The")


@_query(f"WITH {_WL} SELECT term || chr(9) || num_hits AS line FROM wl ORDER BY num_hits DESC, term LIMIT 1000")
def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1000 most frequent terms: the report that the count asks for."""
    return index.dictionary(_index(spark, sf_dir).wordlist, 1000)


@_query("SELECT doc_id, lang, n_chars FROM documents WHERE source IS NOT NULL")
def source_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrain.sources.connectors import read_query

    _table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return read_query(spark, "SELECT doc_id, lang, n_chars FROM documents WHERE source IS NOT NULL;")


# changes

_CONV = "SELECT 1000000000 + conv_id * 1000 + turn AS doc_id, text FROM conversations"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select((F.lit(1000000000) + F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").filter("n_chars < 600").select("doc_id")


def _counted(of: index.Index) -> DataFrame:
    return of.wordlist.withColumn("total_documents", F.lit(of.total_documents).cast("long"))


@_query(f"WITH docs AS (SELECT doc_id, text FROM documents UNION ALL {_CONV}), dl AS (SELECT doc_id, unnest({_words()}) AS term FROM docs) SELECT term, count(*) AS num_hits, count(DISTINCT doc_id) AS num_docs, (SELECT count(*) FROM docs) AS total_documents FROM dl GROUP BY term")
def idx_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_index(spark, sf_dir).insert(_messages(spark, sf_dir)))


_DELETED = f"""WITH {_DL}, gone AS (SELECT DISTINCT doc_id FROM dl WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars < 600))
SELECT term, sum(hit_count)::BIGINT AS num_hits, count(*) AS num_docs, (SELECT count(*) FROM documents) - (SELECT count(*) FROM gone) AS total_documents
FROM dl WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY term"""


@_query(_DELETED)
def idx_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_index(spark, sf_dir).delete(_short(spark, sf_dir)))


@_query(f"""WITH new AS (SELECT doc_id, lang || ' ' || source AS text FROM documents WHERE n_chars < 600),
docs AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT doc_id, text FROM new),
dl AS (SELECT doc_id, unnest({_words()}) AS term FROM docs)
SELECT term, count(*) AS num_hits, count(DISTINCT doc_id) AS num_docs FROM dl GROUP BY term""")
def idx_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _table(spark, sf_dir, "documents").filter("n_chars < 600").select("doc_id", F.concat_ws(" ", "lang", "source").alias("text"))
    return _index(spark, sf_dir).update(new).wordlist


# lookups


@_query(f"WITH {_WL} SELECT term, num_hits, num_docs FROM wl WHERE term = 'thatin'")
def lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lookup_exact(_index(spark, sf_dir).wordlist, "Thatin")


@_query(f"WITH {_WL} SELECT term, num_hits, num_docs FROM wl WHERE starts_with(term, 'wor') ORDER BY length(term), num_hits DESC, term LIMIT 1")
def lookup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lookup_prefix(_index(spark, sf_dir).wordlist, "wor")


_NEAR = f"""{_WL}, c AS (SELECT * FROM wl WHERE starts_with(term, 'wo') ORDER BY num_hits DESC, term LIMIT 50),
near AS (SELECT term, num_hits, num_docs, levenshtein(term, '{FUZZY}') AS distance FROM c WHERE levenshtein(term, '{FUZZY}') <= 2)"""


@_query(f"WITH {_NEAR} SELECT term, num_hits, num_docs, distance FROM near")
def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy_terms(_index(spark, sf_dir).wordlist, FUZZY).withColumn("distance", F.col("distance").cast("long"))


# DuckDB's levenshtein counts bytes; a character that the other word lacks may be any one byte
@_query(f"WITH {_TOK} SELECT term, length(term) - length(replace(term, 'e', '')) AS n, levenshtein(regexp_replace(term, '[^worthles]', '#', 'g'), 'worthless') AS distance FROM (SELECT DISTINCT term FROM tok)")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _index(spark, sf_dir).wordlist.select("term")
    return terms.select("term", (F.length("term") - F.length(F.replace(F.col("term"), F.lit("e"), F.lit("")))).cast("long").alias("n"), F.levenshtein("term", F.lit("worthless")).cast("long").alias("distance"))


# ranked search

_GAIN = "ln((SELECT count(*) FROM documents) * 1.0 / greatest(1, df)) * (2.0 * hit_count) / (1 + hit_count)"


def _ranked(query: str, cap: int | None = 500) -> str:
    limited = f"WHERE nth <= {cap}" if cap else ""
    return f"""m AS (SELECT q.at, q.df, d.doc_id, d.hit_count, row_number() OVER (PARTITION BY q.at ORDER BY q.place, d.hit_count DESC, d.doc_id) AS nth FROM ({query}) q JOIN dl d ON d.term = q.term),
s AS (SELECT doc_id, round(sum({_GAIN}), 9) AS score FROM m {limited} GROUP BY doc_id)"""


_PHRASE_TERMS = f"SELECT g.i AS at, wl.term, 0 AS place, wl.num_docs AS df FROM (SELECT unnest(range(1, 7)) AS i, unnest(string_split('{PHRASE}', ' ')) AS w) g JOIN wl ON wl.term = g.w"
_BM25 = f"WITH {_WL}, {_ranked(_PHRASE_TERMS)} "


@_query(_BM25 + "SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 100")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_index(spark, sf_dir), PHRASE).ranked.withColumn("rank", F.col("rank").cast("long"))


@_query(_BM25 + "SELECT doc_id, score FROM s")
def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_index(spark, sf_dir), PHRASE).doc_scores


@_query(f"WITH {_WL}, {_ranked(_PHRASE_TERMS, None)} SELECT doc_id, score FROM s")
def search_no_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_index(spark, sf_dir), PHRASE, options=search.SearchOptions(no_limit=True)).doc_scores


_TYPED_TERMS = """SELECT 0 AS at, term, 0 AS place, num_docs AS df FROM wl WHERE term = 'thatin' UNION ALL
SELECT * FROM (SELECT 1, term, 0, num_docs FROM wl WHERE starts_with(term, 'wor') ORDER BY length(term), num_hits DESC, term LIMIT 1)"""


@_query(f"WITH {_WL}, {_ranked(_TYPED_TERMS)} SELECT doc_id, score FROM s")
def search_asyoutype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_index(spark, sf_dir), TYPED, options=search.SearchOptions(as_you_type=True)).doc_scores


_FUZZY_TERMS = """SELECT 0 AS at, term, row_number() OVER (ORDER BY distance, num_hits DESC, term) AS place, first_value(num_docs) OVER (ORDER BY distance, num_hits DESC, term) AS df FROM near"""


@_query(f"WITH {_NEAR}, {_ranked(_FUZZY_TERMS)} SELECT doc_id, score FROM s")
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_index(spark, sf_dir), FUZZY, options=search.SearchOptions(fuzziness=True)).doc_scores


@_query(f"""WITH {_WL}, q AS (SELECT item_id AS query_id, unnest({_words()}) AS term FROM benchmark), a AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(times * ln((SELECT count(*) FROM documents) * 1.0 / num_docs) * (2.0 * hit_count) / (1 + hit_count)), 9) AS score FROM a JOIN wl USING (term) JOIN dl USING (term) GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"))
    return search.search_many(_index(spark, sf_dir), phrases, 10).withColumn("rank", F.col("rank").cast("long"))


@_query()
def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = index.build_index(_articles(spark, sf_dir), "doc_id", analysis=index.Analysis(stemmer="porter"))
    return search.search(made, "that things with thatin").doc_scores


# boolean search


def _having(condition: str) -> str:
    has = lambda w: f"coalesce(bool_or(term = '{w}'), false)"
    for w in ("thatin", "worthless", "rewh", "the"):
        condition = condition.replace(f"[{w}]", has(w))
    return f"WITH {_DL} SELECT doc_id FROM dl GROUP BY doc_id HAVING {condition}"


def _boolean(expression: str) -> Query:
    return lambda spark, sf_dir: boolean.boolean_documents(_index(spark, sf_dir), expression)


for _name, _expression, _condition in (
    ("bool_and", "thatin the", "[thatin] AND [the]"),
    ("bool_or", "thatin or worthless", "[thatin] OR [worthless]"),
    ("bool_not", "the -thatin", "[the] AND NOT [thatin]"),
    ("bool_only_not", "~the", "NOT [the]"),
    ("bool_query", "(thatin or worthless) -(rewh the)", "([thatin] OR [worthless]) AND NOT ([rewh] AND [the])"),
    ("bool_unknown_not", "the ~qqqzzzqqq", "false"),
):
    QUERIES[_name], SQL[_name] = _boolean(_expression), _having(_condition)


# stored indexes


def _stored(spark: SparkSession, sf_dir: str, change: Callable[[IndexStore], None] | None = None) -> index.Index:
    """An index of the documents, written, changed and opened again."""
    store = IndexStore(spark, shared_storage(spark))
    store.create("articles", _articles(spark, sf_dir), "doc_id")
    if change:
        change(store)
    return store.open("articles")


@_query(SQL["search_scores"])
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_stored(spark, sf_dir), PHRASE).doc_scores


@_query(SQL["search_fuzzy"])
def stored_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_stored(spark, sf_dir), FUZZY, options=search.SearchOptions(fuzziness=True)).doc_scores


@_query(SQL["bool_query"])
def stored_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean.boolean_documents(_stored(spark, sf_dir), "(thatin or worthless) -(rewh the)")


@_query(SQL["idx_insert"])
def stored_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_stored(spark, sf_dir, lambda store: store.insert("articles", _messages(spark, sf_dir))))


@_query(SQL["idx_delete"])
def stored_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_stored(spark, sf_dir, lambda store: store.delete("articles", _short(spark, sf_dir))))


@_query(SQL["idx_update"])
def stored_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _table(spark, sf_dir, "documents").filter("n_chars < 600").select("doc_id", F.concat_ws(" ", "lang", "source").alias("text"))
    return _stored(spark, sf_dir, lambda store: store.update("articles", new)).wordlist


@_query(SQL["idx_delete"])
def stored_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(store: IndexStore) -> None:
        store.delete("articles", _short(spark, sf_dir))
        store.compact("articles")

    return _counted(_stored(spark, sf_dir, change))


@_query("SELECT 'stemmer' AS key, 'no' AS value UNION ALL SELECT 'tokenizer', 'default' UNION ALL SELECT 'total_documents', count(*)::VARCHAR FROM documents UNION ALL SELECT 'language', 'mixed'")
def stored_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _stored(spark, sf_dir, lambda store: store.set_info("articles", "language", "mixed"))
    return spark.createDataFrame(sorted(made.info.items()), "key string, value string")


# places, classes, keyphrases

_LNG, _LAT = "((c_custkey * 7919) % 36000) / 100.0 - 180.0", "((c_custkey * 104729) % 17000) / 100.0 - 85.0"
_PLACES = f"p AS (SELECT c_custkey AS doc_id, ({_LNG})::DOUBLE AS longitude, ({_LAT})::DOUBLE AS latitude FROM customer)"
_NEAREST = "11.5833, 48.15, 1500.0"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(key.alias("id"), ((key * 7919) % 36000 / 100.0 - 180.0).alias("longitude"), ((key * 104729) % 17000 / 100.0 - 85.0).alias("latitude"))


@_query(f"WITH {_PLACES} SELECT doc_id, round(longitude, 9) AS longitude, round(latitude, 9) AS latitude, round(cos(radians(latitude)), 9) AS cos_lat, round(sin(radians(latitude)), 9) AS sin_lat, round(cos(radians(longitude)), 9) AS cos_lng, round(sin(radians(longitude)), 9) AS sin_lng FROM p")
def geo_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = geo.geo_index(_places(spark, sf_dir))
    return made.select("doc_id", *[F.round(c, 9).alias(c) for c in made.columns if c != "doc_id"])


@_query(f"WITH {_PLACES} SELECT doc_id, round(sin(radians(latitude)), 9) AS sin_lat FROM p UNION ALL SELECT 1000000000 + doc_id, round(sin(radians(latitude)), 9) FROM p")
def geo_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _places(spark, sf_dir)
    made = geo.geo_insert(geo.geo_index(places), places.withColumn("id", F.col("id") + 1000000000))
    return made.select("doc_id", F.round("sin_lat", 9).alias("sin_lat"))


@_query(f"WITH {_PLACES} SELECT doc_id, round(cos(radians(longitude)), 9) AS cos_lng FROM p WHERE doc_id NOT IN (1, 2, 3)")
def geo_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = geo.geo_delete(geo.geo_index(_places(spark, sf_dir)), [1, 2, 3])
    return made.select("doc_id", F.round("cos_lng", 9).alias("cos_lng"))


@_query(f"""WITH {_PLACES}, box AS (SELECT *, sin(radians(latitude)) * sin(radians(48.15)) + cos(radians(latitude)) * cos(radians(48.15)) * (cos(radians(longitude)) * cos(radians(11.5833)) + sin(radians(longitude)) * sin(radians(11.5833))) AS near FROM p
WHERE latitude BETWEEN 48.15 - 1500.0 / 111.045 AND 48.15 + 1500.0 / 111.045 AND longitude BETWEEN 11.5833 - 1500.0 / (111.045 * cos(radians(48.15))) AND 11.5833 + 1500.0 / (111.045 * cos(radians(48.15)))),
best AS (SELECT doc_id, acos(greatest(-1.0, least(1.0, near))) * 6371 AS distance FROM box ORDER BY near DESC, doc_id LIMIT 10)
SELECT doc_id, round(distance, 6) AS distance FROM best WHERE distance <= 1500.0""")
def geo_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geo.geo_nearest(geo.geo_index(_places(spark, sf_dir)), 11.5833, 48.15, 1500.0)
    return found.withColumn("distance", F.round("distance", 6))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).join(_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id")


_TRAIN = f"""ex AS (SELECT d.doc_id, d.text, l.quality::VARCHAR AS label FROM documents d JOIN labels l USING (doc_id)),
cd AS (SELECT label, count(*) AS n FROM ex GROUP BY label), cw AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest({_words()}) AS term FROM ex) GROUP BY ALL)"""


@_query(f"WITH {_TRAIN} SELECT label, term, n FROM cw")
def nb_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.train(_labelled(spark, sf_dir)).class_words


@_query(f"""WITH {_TRAIN}, v AS (SELECT count(DISTINCT term) AS v FROM cw), k AS (SELECT cd.label, ln(cd.n * 1.0 / (SELECT sum(n) FROM cd)) AS prior, (SELECT coalesce(sum(n), 0) FROM cw WHERE cw.label = cd.label) + v AS base FROM cd, v),
t AS (SELECT doc_id, unnest({_words()}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS times FROM t GROUP BY ALL),
x AS (SELECT c.doc_id, k.label, sum(c.times * ln((coalesce(cw.n, 0) + 1.0) / k.base)) AS s FROM c CROSS JOIN k LEFT JOIN cw ON cw.term = c.term AND cw.label = k.label GROUP BY ALL),
y AS (SELECT d.doc_id, k.label, k.prior + coalesce(x.s, 0) AS likelihood FROM documents d CROSS JOIN k LEFT JOIN x ON x.doc_id = d.doc_id AND x.label = k.label)
SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(likelihood, 9) DESC, label) AS nth FROM y) WHERE nth = 1""")
def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.predict(classifier.train(_labelled(spark, sf_dir)), _articles(spark, sf_dir)).select("doc_id", "label")


@_query(f"""WITH t AS (SELECT doc_id, {_RAKE_TOKENS} AS ts FROM documents),
u AS (SELECT doc_id, array_to_string(list_transform(ts, lambda t: CASE WHEN list_contains({_quoted(_ENGLISH)}, t) OR regexp_matches(t, '^[!-/:-@\\[-`{{-~]+$') THEN chr(10) ELSE t END), ' ') AS line FROM t),
p AS (SELECT doc_id, trim(unnest(string_split(line, chr(10)))) AS phrase FROM u),
w AS (SELECT doc_id, phrase, unnest(string_split(phrase, ' ')) AS word, len(string_split(phrase, ' ')) AS size FROM p WHERE phrase <> ''),
ws AS (SELECT doc_id, word, sum(size) * 1.0 / count(*) AS score FROM w GROUP BY ALL),
ph AS (SELECT doc_id, phrase, unnest(string_split(phrase, ' ')) AS word FROM (SELECT DISTINCT doc_id, phrase FROM p WHERE phrase <> '')),
sc AS (SELECT ph.doc_id, phrase, round(sum(score), 9) AS score FROM ph JOIN ws USING (doc_id, word) GROUP BY ALL),
r AS (SELECT doc_id, phrase, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM sc)
SELECT doc_id, phrase, score, place FROM r WHERE place <= ceil(n / 3.0) + 1""")
def rake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.rake(_articles(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


# text tools


@_query(r"SELECT doc_id, regexp_replace(text, '\b(thatin|worthless)\b', '<em>\1</em>', 'gi') AS marked FROM documents")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select("doc_id", H.highlight(F.col("text"), "thatin worthless", options=H.HighlightOptions(simple=True)).alias("marked"))


# a word is within a tag if the next bracket closes one
@_query(r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(html, '<a\s[^>]*>(\bthatin\b|\bworthless\b)</a>', '\1', 'gi'), '[^<>]*[<>]?'),
lambda s: CASE WHEN ends_with(s, '>') THEN s ELSE regexp_replace(s, '\b(thatin|worthless)\b', '<b>\1</b>', 'gi') END), '') AS marked FROM pages""")
def highlight_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", H.highlight(F.col("html"), "thatin worthless", "b", H.HighlightOptions(strip_links=True)).alias("marked"))


@_query()
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select("doc_id", H.snippet(F.col("text"), "thatin worthless the").alias("snippet"))


@_query(f"WITH {_TOK} SELECT DISTINCT term FROM tok WHERE regexp_matches(term, 'w.*o.*r')")
def subseq_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).wordlist.filter(S.has_subsequence("wor", F.col("term"))).select("term")


@_query()
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fuzzy_match(_index(spark, sf_dir).wordlist.select(F.col("term").alias("item")), "worthless")


# bytes of a term one by one; those beyond ASCII match nothing in the other word, so any byte may stand for them
_JARO = f"""RECURSIVE {_TOK}, t AS (SELECT DISTINCT term, regexp_replace(regexp_replace(regexp_replace(term, '[\\x{{10000}}-\\x{{10ffff}}]', '####', 'g'), '[\\x{{800}}-\\x{{ffff}}]', '###', 'g'), '[\\x{{80}}-\\x{{7ff}}]', '##', 'g') AS x FROM tok),
s AS (SELECT term, x, 0 AS i, 'worthless' AS free, '' AS mine FROM t UNION ALL
SELECT term, x, i + 1, CASE WHEN p > 0 THEN left(free, low + p - 1) || '.' || substr(free, low + p + 1) ELSE free END, CASE WHEN p > 0 THEN mine || c ELSE mine END
FROM (SELECT *, instr(substr(free, low + 1, greatest(0, high - low)), c) AS p FROM (SELECT *, substr(x, i + 1, 1) AS c, floor(greatest(0, i - reach))::INT AS low, floor(least(i + reach + 1, 9))::INT AS high
FROM (SELECT *, greatest(length(x), 9) / 2.0 - 1 AS reach FROM s WHERE i < length(x))))),
m AS (SELECT term, x, mine, length(mine) AS n, array_to_string(list_transform(range(1, 10), lambda k: CASE WHEN substr(free, k, 1) = '.' THEN substr('worthless', k, 1) ELSE '' END), '') AS theirs FROM s WHERE i = length(x)),
j AS (SELECT term, x, CASE WHEN n = 0 THEN 0.0 ELSE (n / length(x)::DOUBLE + n / 9.0::DOUBLE + (n - coalesce(list_sum(list_transform(range(1, n + 1), lambda k: CASE WHEN substr(mine, k, 1) <> substr(theirs, k, 1) THEN 1 ELSE 0 END)), 0) / 2.0::DOUBLE) / n) / 3 END AS jaro FROM m)"""


@_query(f"WITH {_JARO} SELECT term, round(jaro, 9) AS similarity FROM j")
def jaro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).wordlist.select("term", F.round(S.jaro_similarity(F.col("term"), F.lit("worthless")), 9).alias("similarity"))


@_query(f"""WITH {_JARO} SELECT term, round(CASE WHEN jaro < 0.7 THEN jaro ELSE jaro + least(0.1, 1.0::DOUBLE / greatest(length(x), 9)) * (1 - jaro)
* list_max(list_transform(range(0, 10), lambda k: CASE WHEN k <= length(x) AND left(x, k) = left('worthless', k) THEN k ELSE 0 END)) END, 9) AS similarity FROM j""")
def jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).wordlist.select("term", F.round(S.jaro_winkler_similarity(F.col("term"), F.lit("worthless")), 9).alias("similarity"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
