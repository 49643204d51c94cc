"""One object for making and searching indexes, with the defaults of each step kept on it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession

from lexigrain.functions import highlight as _highlight
from lexigrain.functions.stemmers import stemmer
from lexigrain.functions.tokenizers import tokenizer
from lexigrain.operators import boolean, geo, search
from lexigrain.operators.index import Analysis, Index, dictionary, query_terms, write_dictionary
from lexigrain.operators.store import IndexStore
from lexigrain.sources.connectors import connection, read_query
from lexigrain.sources.files import filemap, read_files


class Engine:
    """Full-text search over indexes in a storage folder.

    ``config`` may hold ``storage``, ``driver`` and what the driver needs,
    ``location``, ``extension`` and ``exclude`` for files, ``tokenizer`` and
    ``stemmer``.
    """

    def __init__(self, spark: SparkSession, config: Mapping | None = None) -> None:
        self.spark = spark
        self.load_config(config or {})

    def load_config(self, config: Mapping) -> None:
        self.config = dict(config)
        self.store = IndexStore(self.spark, str(config["storage"])) if "storage" in config else None
        self.options = search.SearchOptions()
        self.selected: Index | None = None
        self.name: str | None = None
        self.words: DataFrame | None = None

    def create_index(self, name: str) -> Indexer:
        return Indexer(self, name)

    def select_index(self, name: str) -> Index:
        """Search this index from now on; the dictionary is kept in memory where it fits, on disk where not."""
        if self.words is not None:
            self.words.unpersist()
        self.selected, self.name = self.store.open(name), name
        self.words = self.selected.wordlist.persist()
        return self.selected

    def get_index(self) -> Indexer:
        """The indexer of the selected index."""
        return Indexer(self, self._selected_name(), existing=True)

    def flush_index(self, name: str) -> None:
        self.store.flush(name)

    def _selected_name(self) -> str:
        if self.name is None:
            raise ValueError("no index is selected")
        return self.name

    def _index(self) -> Index:
        self._selected_name()
        return self.selected

    def set_options(self, **changes) -> None:
        """``fuzziness``, ``prefix_length``, ``max_expansions``, ``distance``, ``no_limit``, ``as_you_type`` or ``max_docs``."""
        self.options = replace(self.options, **changes)

    def search(self, phrase: str, limit: int = 100) -> search.SearchResult:
        return search.search(self._index(), phrase, limit, self.options, self.words)

    def search_files(self, phrase: str, limit: int = 100) -> DataFrame:
        return search.search_files(self._index(), phrase, limit, self.options)

    def search_boolean(self, expression: str, limit: int = 100, strict_not: bool = False) -> DataFrame:
        return boolean.boolean_search(self._index(), expression, limit, self.options, strict_not, self.words)

    def total_documents(self) -> int:
        return self._index().total_documents

    def info(self, key: str) -> str | None:
        return self.store.info(self._selected_name()).get(key)

    def stemmer(self) -> Callable[[str], str]:
        return stemmer(self._index().analysis.stemmer)

    def break_into_tokens(self, text: str) -> list[str]:
        return query_terms(self.spark, text, replace(self._index().analysis, stemmer="no"))

    def highlight(self, text: Column, needle: str, tag: str = "em", options: _highlight.HighlightOptions = _highlight.HighlightOptions()) -> Column:
        return _highlight.highlight(text, needle, tag, options, self._tokenizer())

    def snippet(self, text: Column, words: str, length: int = 300, before: int = 50, indicator: str = "...") -> Column:
        return _highlight.snippet(text, words, length, before, indicator, self._tokenizer())

    def _tokenizer(self):
        return tokenizer(self.selected.analysis.tokenizer if self.selected else "default")

    def find_nearest(self, places: DataFrame, longitude: float, latitude: float, distance_km: float, limit: int = 10) -> DataFrame:
        return geo.geo_nearest(places, longitude, latitude, distance_km, limit)


class Indexer:
    """Settings of an index to be built, and changes to one that is there."""

    def __init__(self, engine: Engine, name: str, existing: bool = False) -> None:
        config = engine.config
        self.engine, self.name, self.existing = engine, name, existing
        self.primary_key, self.include_key, self.source = "id", False, None
        self.analysis = engine.store.open(name).analysis if existing else Analysis(config.get("tokenizer", "default"), config.get("stemmer", "no"))

    def query(self, sql: str) -> Indexer:
        """Rows of a query: of the session's tables, or of the database of the configuration's driver."""
        remote = self.engine.config.get("driver") and connection(self.engine.config) is not None
        self.source = read_query(self.engine.spark, sql, self.engine.config if remote else None)
        return self

    def table(self, rows: DataFrame) -> Indexer:
        self.source = rows
        return self

    def set_primary_key(self, column: str) -> Indexer:
        self.primary_key = column
        return self

    def include_primary_key(self) -> Indexer:
        self.include_key = True
        return self

    def exclude_primary_key(self) -> Indexer:
        self.include_key = False
        return self

    def set_tokenizer(self, name: str) -> Indexer:
        tokenizer(name)
        self.analysis = replace(self.analysis, tokenizer=name)
        return self

    def set_stemmer(self, name: str) -> Indexer:
        stemmer(name)
        self.analysis = replace(self.analysis, stemmer=name)
        return self

    set_language = set_stemmer

    def set_stopwords(self, words: Sequence[str]) -> Indexer:
        self.analysis = replace(self.analysis, stopwords=tuple(words))
        return self

    def disable_output(self, wanted: bool = True) -> Indexer:
        """No lines of progress in the log."""
        self.engine.store.quiet = wanted
        return self

    def decode_html_entities(self, wanted: bool = True) -> Indexer:
        self.analysis = replace(self.analysis, decode_entities=wanted)
        return self

    def run(self, **file_options) -> Index:
        """Build the index from the query or table, or from the files of the configuration."""
        store = self.engine.store
        if self.source is None and self.engine.config.get("driver") == "filesystem":
            config = self.engine.config
            files = read_files(self.engine.spark, config["location"], config.get("extension"), config.get("exclude") or (), **file_options)
            return store.create(self.name, files.select("id", "name", "content"), "id", self.include_key, self.analysis, filemap(files), {"driver": "filesystem"})
        if self.source is None:
            raise ValueError("there is no query, table or folder to index")
        return store.create(self.name, self.source, self.primary_key, self.include_key, self.analysis)

    def insert(self, rows: DataFrame) -> None:
        self.engine.store.insert(self.name, rows)
        self._again()

    def update(self, rows: DataFrame) -> None:
        self.engine.store.update(self.name, rows)
        self._again()

    def delete(self, ids: DataFrame | Sequence) -> None:
        self.engine.store.delete(self.name, ids)
        self._again()

    def _again(self) -> None:
        if self.engine.name == self.name:
            self.engine.select_index(self.name)

    def count_word(self, word: str) -> int:
        return self.engine.store.open(self.name).hits_of(word)

    def count_documents_with(self, word: str) -> int:
        return self.engine.store.open(self.name).documents_with(word)

    def dictionary(self, count: int = -1, hits: bool = True, docs: bool = False) -> DataFrame:
        return dictionary(self.engine.store.open(self.name).wordlist, count, hits, docs)

    def build_dictionary(self, path: str, count: int = -1, hits: bool = True, docs: bool = False) -> None:
        write_dictionary(self.engine.store.open(self.name).wordlist, path, count, hits, docs)
