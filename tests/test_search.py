import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrain.engine import Engine
from lexigrain.functions.tokenizers import register_tokenizer
from lexigrain.operators import boolean, classifier, geo, search
from lexigrain.operators.index import Analysis, build_index, dictionary
from lexigrain.operators.search import SearchOptions
from lexigrain.operators import store as store_module
from lexigrain.operators.store import IndexNotFoundError, IndexStore
from lexigrain.sources import connectors
from lexigrain.sources.files import read_files

ARTICLES = [
    (1, "Romeo and Juliet", "a tale of Romeo, of Juliet, and of two houses"),
    (2, "Queen Mab", "queen mab has been with you"),
    (3, "King Lear", "an old king and three daughters of the king"),
    (4, "The Tempest", "a storm, an island and a duke with his daughter Miranda"),
    (5, "Empty", None),
]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(ARTICLES, "id long, title string, article string").cache()


@pytest.fixture(scope="module")
def index(articles):
    return build_index(articles)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_counts(spark):
    rows = spark.createDataFrame([(1, "alpha alpha beta", "alpha beta"), (2, "alpha", "alpha"), (3, None, "alpha")], "id long, title string, article string")
    made = build_index(rows)
    assert (made.hits_of("alpha"), made.documents_with("Alpha"), made.hits_of("beta"), made.documents_with("beta"), made.hits_of("none")) == (6, 3, 2, 1, 0)
    assert made.total_documents == 3
    assert [r["line"] for r in dictionary(made.wordlist, docs=True).collect()] == ["alpha\t6\t3", "beta\t2\t1"]
    assert [r["line"] for r in dictionary(made.wordlist, 1, hits=False).collect()] == ["alpha"]


def test_ranked(index):
    assert search.search(index, "Juliet").ids == [1]
    found = search.search(index, "king daughter")
    assert found.ids[0] == 4 or found.ids[0] == 3
    assert found.hits == 2 and found.execution_time.endswith("ms")
    assert search.search(index, "nothing").ids == []
    assert search.search(index, "").ids == []
    assert search.search(index, "of", limit=1).ids == search.search(index, "of").ids[:1]


def test_repeated_query_words_count_twice(index):
    once, twice = (search.search(index, q).doc_scores.first()["score"] for q in ("juliet", "juliet juliet"))
    assert twice == pytest.approx(2 * once)


def test_term_cap(spark):
    rows = spark.range(700).select(F.col("id"), F.lit("word").alias("content"))
    made = build_index(rows)
    assert search.search(made, "word").hits == 500
    assert search.search(made, "word", options=SearchOptions(no_limit=True)).hits == 700


def test_string_ids(spark):
    rows = spark.createDataFrame([("FP_1", "apple banana"), ("FP_2", "apple cherry"), ("TP_3", "banana date")], "id string, content string")
    made = build_index(rows)
    assert ids(search.search(made, "apple").doc_scores) == ["FP_1", "FP_2"]
    assert ids(boolean.boolean_search(made, "apple -banana")) == ["FP_2"]
    assert ids(made.delete(["FP_1"]).postings.filter("term = 'apple'")) == ["FP_2"]


def test_fuzzy_and_typed(spark):
    rows = [(20, "buzz buzz")] + [(i, " ".join([w] * 7)) for i, w in enumerate(["bunny", "bubble", "budget", "bucket", "bundle"], 21)]
    made = build_index(spark.createDataFrame(rows, "id long, content string"))
    assert search.search(made, "buzz", options=SearchOptions(fuzziness=True)).ids == [20]
    assert search.search(made, "buzz", options=SearchOptions(fuzziness=True, no_limit=True, distance=4)).hits > 1
    assert ids(search.search(made, "bunnt", options=SearchOptions(fuzziness=True)).doc_scores) == [21]
    assert ids(search.search(made, "bub", options=SearchOptions(as_you_type=True)).doc_scores) == [22]
    near = [r["term"] for r in search.fuzzy_terms(made.wordlist, "bucket").collect()]
    assert near == ["bucket", "budget"]


def test_postfix():
    for text, want in {
        "a&b|c": "a b & c |", "aw&bw|cw)": "aw bw & cw |", "a&(b|d&c)": "a b d c & | &", "great or awsome": "great awsome |", "great awsome": "great awsome &",
        "email test com": "email test & com &", "(first last) or (something else)": "first last & something else & |",
        "(first or last)&(something or else)": "first last | something else | &", "(first or last)&something or else)": "first last | something & else |",
        "foo -bar": "foo bar ~ &", "foo -bar -alpha": "foo bar ~ & alpha ~ &", "foo ~bar": "foo bar ~ &", "0 a": "0 a &", "-x": "-x", "": "", "A OR b": "a or & b &",
    }.items():
        assert boolean.to_postfix(text) == want.split(), text


@pytest.mark.parametrize(
    "expression, want",
    [
        ("romeo juliet", [1]), ("romeo or mab", [1, 2]), ("king -romeo", [3]), ("~king", [1, 2, 4, 5]), ("king ~unknown", []), ("unknown", []), ("", []),
        ("(king or queen) -(old daughters)", [2]), ("daughter or daughters", [3, 4]), ("king &", []),
    ],
)
def test_boolean(index, expression, want):
    assert ids(boolean.boolean_documents(index, expression)) == want


def test_strict_not(index):
    assert ids(boolean.boolean_documents(index, "king ~unknown", strict_not=True)) == [3]


def test_changes(spark, index):
    more = spark.createDataFrame([(9, "New", "juliet again")], "id long, title string, article string")
    grown = index.insert(more)
    assert grown.total_documents == 6 and ids(search.search(grown, "juliet").doc_scores) == [1, 9]
    assert grown.delete([9]).wordlist.exceptAll(index.wordlist).count() == 0
    assert grown.delete([9]).total_documents == 5 and grown.delete([77]).total_documents == 6
    assert index.insert(more).insert(more).documents_with("juliet") == 3
    changed = index.update(spark.createDataFrame([(1, "Other", "text")], "id long, title string, article string"))
    assert changed.total_documents == 5 and changed.hits_of("juliet") == 0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab c-", max_size=12), min_size=1, max_size=6))
def test_hits_add_up(spark, texts):
    made = build_index(spark.createDataFrame(list(enumerate(texts)), "id long, content string"))
    words = {r["term"]: (r["num_hits"], r["num_docs"]) for r in made.wordlist.collect()}
    all_words = [t.split() for t in texts]
    assert words == {w: (sum(t.count(w) for t in all_words), sum(w in t for t in all_words)) for t in all_words for w in t}


def test_store(spark, articles, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    with pytest.raises(IndexNotFoundError) as missing:
        store.open("a")
    assert missing.value.code == 1
    store.create("a", articles, analysis=Analysis(stemmer="porter", stopwords=("of",)))
    assert store.info("a") | {} == {"total_documents": "5", "stemmer": "porter", "tokenizer": "default"}
    assert ids(search.search(store.open("a"), "daughters").doc_scores) == [3, 4]
    store.delete("a", [3])
    store.insert("a", spark.createDataFrame([(3, "Again", "daughter")], "id long, title string, article string"))
    store.update("a", spark.createDataFrame([(4, "Again", "nothing")], "id long, title string, article string"))
    for _ in range(2):
        made = store.open("a")
        assert made.total_documents == 5 and ids(search.search(made, "daughters").doc_scores) == [3]
        store.compact("a")
    store.set_info("a", "note", "x")
    assert store.info("a")["note"] == "x"
    store.flush("a")
    assert not store.exists("a")


@pytest.mark.parametrize("broken", ["_write_meta", "_write_postings", "_sweep"])
@pytest.mark.parametrize("change", ["insert", "update", "delete", "compact", "create"])
def test_a_broken_change_is_seen_whole_or_not_at_all(spark, articles, tmp_path, monkeypatch, change, broken):
    store = IndexStore(spark, str(tmp_path))
    rows = spark.createDataFrame([(3, "Again", "daughter"), (9, "New", "daughter")], "id long, title string, article string")
    do = {"insert": lambda: store.insert("a", rows), "update": lambda: store.update("a", rows), "delete": lambda: store.delete("a", [3, 4]), "compact": lambda: store.compact("a"), "create": lambda: store.create("a", rows)}[change]
    store.create("a", articles)
    state = lambda: (store.open("a").total_documents, sorted(map(tuple, store.open("a").postings.collect())))
    before = state()

    def fail(*_):
        raise OSError("the driver died")

    with monkeypatch.context() as m:
        m.setattr(IndexStore, broken, fail)
        try:
            do()
            died = False
        except OSError:
            died = True
    after = state()
    if died and broken != "_sweep":
        assert after == before
    do()
    if died and broken == "_sweep":
        assert state() == after
    store.compact("a")
    assert len(list((tmp_path / "a" / "postings").glob("load_id=*"))) == 1 and len(list((tmp_path / "a").glob("info-*.json"))) == 1


def test_two_writers(spark, articles, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    store.create("a", articles)
    old = store.meta("a")
    store.set_info("a", "x", "1")
    with pytest.raises(RuntimeError):
        store._write_meta("a", old)


def test_engine(spark, articles, tmp_path):
    articles.createOrReplaceTempView("articles")
    engine = Engine(spark, {"storage": str(tmp_path)})
    engine.create_index("x").query("SELECT id, title, article FROM articles;").set_language("porter").run()
    engine.select_index("x")
    assert engine.search("daughter").hits == 2 and engine.total_documents() == 5 and engine.info("stemmer") == "porter"
    assert engine.stemmer()("houses") == "hous" and engine.break_into_tokens("Canon 70-200") == ["canon", "70-200"]
    engine.get_index().insert(spark.createDataFrame([(8, "t", "daughter")], "id long, title string, article string"))
    assert engine.search("daughter").hits == 3
    engine.get_index().delete([8])
    assert ids(engine.search_boolean("daughter -king")) == [4]
    engine.set_options(as_you_type=True)
    assert engine.search("tem").ids == [4]
    engine.get_index().build_dictionary(f"{tmp_path}/dict", 2)
    assert spark.read.text(f"{tmp_path}/dict").count() == 2
    engine.flush_index("x")
    with pytest.raises(IndexNotFoundError):
        engine.select_index("x")
    register_tokenizer("whole", lambda c: F.array(F.lower(c)))
    posts = spark.createDataFrame([(1, "First post"), (2, "Second post")], "post_id long, content string")
    engine.create_index("p").table(posts).set_primary_key("post_id").set_tokenizer("whole").run()
    engine.select_index("p")
    assert engine.info("tokenizer") == "whole"
    with pytest.raises(ValueError):
        engine.create_index("p").table(posts).run()


def test_files(spark, tmp_path):
    folder = tmp_path / "files"
    (folder / "deep").mkdir(parents=True)
    for name, text in (("1.txt", "first document"), ("2.txt", "second document"), ("deep/3.txt", "third document"), ("skip.txt", "document"), ("x.md", "other")):
        (folder / name).write_text(text)
    engine = Engine(spark, {"driver": "filesystem", "location": str(folder), "extension": "txt", "exclude": ["skip.txt"], "storage": str(tmp_path / "s")})
    engine.create_index("f").run()
    engine.select_index("f")
    assert engine.get_index().count_word("document") == 3 and engine.info("driver") == "filesystem" and engine.total_documents() == 3
    assert [r["path"].split("/")[-1] for r in engine.search_files("second").collect()] == ["2.txt"]
    named = lambda **o: sorted(r["name"] for r in read_files(spark, str(folder), **o).collect())
    assert named(extension=["md"]) == ["x.md"]
    assert named(extension=lambda p: p.endswith("3.txt")) == ["3.txt"]
    assert named(keep=lambda t: t.filter("content like 'f%'")) == ["1.txt"]
    upper = read_files(spark, str(folder), "md", reader=lambda path, raw: raw.decode().upper()).first()
    assert upper["content"] == "OTHER" and upper["id"] == 1


def test_connectors(tmp_path):
    with pytest.raises(ValueError):
        connectors.connection({})
    with pytest.raises(ValueError):
        connectors.connection({"driver": "csv"})
    with pytest.raises(FileNotFoundError):
        connectors.connection({"driver": "sqlite", "database": str(tmp_path / "none")})
    assert connectors.connection({"driver": "filesystem"}) is None
    assert connectors.jdbc_options({"options": {"fetchsize": 5, "x": "y"}}) == {"fetchsize": "5", "x": "y"}
    mysql = connectors.connection({"driver": "mysql", "host": "h", "port": 1, "database": "d", "username": "u", "password": "p", "charset": "utf8", "timezone": "+1:00", "modes": ["A", "B"]})
    assert mysql["url"].startswith("jdbc:mysql://h:1/d") and mysql["user"] == "u" and "utf8_unicode_ci" in mysql["sessionInitStatement"] and "A,B" in mysql["sessionInitStatement"]
    postgres = connectors.connection({"driver": "pgsql", "database": "d", "schema": ["a", "b"], "sslmode": "require", "application_name": "n"})
    assert postgres["url"] == "jdbc:postgresql://localhost:5432/d?sslmode=require&ApplicationName=n" and '"a", "b"' in postgres["sessionInitStatement"]
    assert connectors.connection({"driver": "sqlsrv", "host": "h", "database": "d"})["url"] == "jdbc:sqlserver://h:1433;databaseName=d"
    assert connectors.connection({"driver": "oracledb", "dbtns": "t"})["url"] == "jdbc:oracle:thin:@t"
    assert connectors.connection({"driver": "sqlite", "database": ":memory:"})["url"] == "jdbc:sqlite::memory:"


def test_classifier(spark, tmp_path):
    learned = spark.createDataFrame([(1, "chinese beijing chinese", "c"), (2, "chinese chinese shangai", "c"), (3, "chinese macao", "c"), (4, "tokyo japan chinese", "j")], "n long, text string, label string")
    model = classifier.train(learned, order="n")
    asked = spark.createDataFrame([(1, "chinese chinese chinese tokyo japan"), (2, ""), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["label"] for r in classifier.predict(model, asked).collect()} == {1: "c", 2: "c", 3: "c"}
    model.save(str(tmp_path))
    again = classifier.load_model(spark, str(tmp_path))
    assert {r["doc_id"]: r["label"] for r in classifier.predict(again, asked).collect()} == {1: "c", 2: "c", 3: "c"}
    sports = spark.createDataFrame([(1, "A great game", "Sports"), (2, "The election was over", "Not sports"), (3, "Very clean match", "Sports"), (4, "A clean but forgettable game", "Sports")], "n long, text string, label string")
    guess = classifier.predict(classifier.train(sports, order="n"), spark.createDataFrame([(1, "It was a close election")], "doc_id long, text string")).first()
    assert guess["label"] == "Not sports"
    even = spark.createDataFrame([(1, "b", "z"), (2, "a", "y")], "n long, text string, label string")
    assert classifier.predict(classifier.train(even, order="n"), asked.filter("doc_id = 2")).first()["label"] == "z"
    more = classifier.learn_more(model, spark.createDataFrame([("kyoto kyoto", "j")], "text string, label string"))
    assert classifier.predict(more, spark.createDataFrame([(1, "kyoto")], "doc_id long, text string")).first()["label"] == "j"


def test_geo(spark):
    places = spark.createDataFrame([(9389, 11.5833, 48.15), (2, 11.6, 48.2), (3, -11.6, 48.2), (4, None, 1.0)], "id long, longitude double, latitude double")
    made = geo.geo_index(places)
    found = geo.geo_nearest(made, 11.5833, 48.15, 25).collect()
    assert [r["doc_id"] for r in found] == [9389, 2] and found[0]["distance"] == pytest.approx(0, abs=1e-3)
    assert [r["doc_id"] for r in geo.geo_nearest(geo.geo_delete(made, [9389]), 11.5833, 48.15, 25, 1).collect()] == [2]
    assert geo.geo_insert(made, places).count() == 6


def test_streaming(spark, tmp_path):
    from lexigrain.streaming.ingest import index_stream

    store = IndexStore(spark, str(tmp_path / "store"))
    store.create("s", analysis=Analysis())
    source = tmp_path / "in"
    spark.createDataFrame([(1, "alpha beta")], "id long, content string").write.parquet(str(source))
    stream = spark.readStream.schema("id long, content string").parquet(str(source))
    for _ in range(2):
        index_stream(stream, store, "s", str(tmp_path / "c"), once=True).awaitTermination()
    spark.createDataFrame([(2, "beta")], "id long, content string").write.mode("append").parquet(str(source))
    index_stream(stream, store, "s", str(tmp_path / "c"), once=True).awaitTermination()
    assert ids(search.search(store.open("s"), "beta").doc_scores) == [1, 2] and store.open("s").total_documents == 2


def test_stream_batch_after_a_crash(spark, tmp_path, monkeypatch):
    """The load and its number are one change: a batch that runs again isn't loaded twice."""
    from lexigrain.streaming.ingest import index_stream

    store = IndexStore(spark, str(tmp_path / "store"))
    store.create("s", analysis=Analysis())
    source = tmp_path / "in"
    spark.createDataFrame([(1, "alpha beta")], "id long, content string").write.parquet(str(source))
    stream = spark.readStream.schema("id long, content string").parquet(str(source))
    index_stream(stream, store, "s", str(tmp_path / "c"), once=True).awaitTermination()
    (tmp_path / "c" / "commits" / "0").unlink()
    (tmp_path / "c" / "commits" / ".0.crc").unlink(missing_ok=True)
    index_stream(stream, store, "s", str(tmp_path / "c"), once=True).awaitTermination()
    assert store.open("s").total_documents == 1 and store.open("s").postings.count() == 2


def test_windowed_terms(spark, tmp_path):
    from lexigrain.streaming.ingest import windowed_terms

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:10", "alpha beta"), (2, "2024-01-01 00:00:50", "beta"), (3, "2024-01-01 00:01:10", "beta"), (4, "2024-01-01 01:00:00", "late")], "id long, at string, content string")
    rows.selectExpr("id", "cast(at as timestamp) at", "content").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, at timestamp, content string").parquet(str(tmp_path / "in"))
    query = windowed_terms(stream, "at", "id", "1 minute", "1 minute").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(str(r["start"])[11:16], r["term"]): r["num_hits"] for r in spark.table("windowed").collect()}
    assert got == {("00:00", "alpha"): 1, ("00:00", "beta"): 2, ("00:01", "beta"): 1, ("01:00", "late"): 1}


def test_stemmed_classes(spark):
    """Stems of the vocabulary give what stems of every word would."""
    learned = spark.createDataFrame([(1, "running runs", "a"), (2, "runs jumping", "b")], "n long, text string, label string")
    words = {(r["label"], r["term"]): r["n"] for r in classifier.train(learned, order="n", stemmer_name="porter").class_words.collect()}
    assert words == {("a", "run"): 2, ("b", "run"): 1, ("b", "jump"): 1}


def test_one_lookup_for_all_words(spark):
    made = build_index(spark.createDataFrame([(1, "word words worth world work"), (2, "word work")], "id long, content string"))
    options = search.SearchOptions(fuzziness=True, as_you_type=True, no_limit=True)
    found = search.expansions(made.wordlist, ["work", "nothing", "work", "wor"], options)
    assert [e.term for e in found[0]] == ["work", "word", "words", "world", "worth"] and found[0] == found[2] and found[1] == []
    assert [e.term for e in found[3]][:2] == ["word", "work"] and [e.place for e in found[3]] == list(range(5))
    assert search.expansions(made.wordlist, []) == []


@pytest.mark.parametrize("options", [SearchOptions(), SearchOptions(no_limit=True), SearchOptions(max_docs=2), SearchOptions(fuzziness=True), SearchOptions(as_you_type=True), SearchOptions(fuzziness=True, as_you_type=True, no_limit=True), SearchOptions(fuzziness=True, prefix_length=1, max_expansions=3, distance=1)])
def test_many_searches_are_as_single_ones(spark, options):
    texts = ["word words worth world work", "word work work", "worth a word", "wo w worthless", "a daughter and a duke", "daughters of the duke word"]
    made = build_index(spark.createDataFrame(list(enumerate(texts)), "id long, content string"))
    phrases = ["word wor", "wrk word word", "w", "daughte duk", "nothing here", "", "wort work"]
    got = {}
    for r in search.search_many(made, spark.createDataFrame(list(enumerate(phrases)), "query_id int, phrase string"), 10, options=options).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], round(r["score"], 6)))
    for i, phrase in enumerate(phrases):
        want = [(r["rank"], r["doc_id"], round(r["score"], 6)) for r in search.search(made, phrase, 10, options).ranked.collect()]
        assert sorted(got.get(i, [])) == sorted(want), phrase


def test_progress(spark, articles, tmp_path, caplog):
    caplog.set_level("INFO", logger="lexigrain.operators.store")
    engine = Engine(spark, {"storage": str(tmp_path)})
    engine.create_index("a").table(articles).run()
    engine.store.delete("a", [1])
    assert [r.getMessage() for r in caplog.records] == ["index a: created, 5 documents in 1 loads", "index a: ids deleted, 4 documents in 1 loads"]
    caplog.clear()
    engine.create_index("a").table(articles).disable_output().run()
    engine.store.compact("a")
    assert not caplog.records


def test_index_of_a_database(spark, articles, tmp_path):
    """Rows of a database over JDBC, read by one task and by several, give the index of the table."""
    spark.sparkContext._jvm.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:articles"
    articles.write.jdbc(f"{url};create=true", "articles", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    config = {"driver": "derby", "database": "memory:articles", "storage": str(tmp_path / "store"), "options": {"fetchsize": 2}}
    for more in ({}, {"partition_column": '"id"', "lower": 1, "upper": 6, "partitions": 3}):
        engine = Engine(spark, config | more)
        made = engine.create_index("a").query('SELECT "id", "title", "article" FROM articles;').run()
        assert sorted(map(tuple, made.postings.collect())) == sorted(map(tuple, build_index(articles).postings.collect())) and made.total_documents == 5
        engine.select_index("a")
        assert engine.search("daughters king").ids == [3]
    read = connectors.read_query(spark, 'SELECT "id" FROM articles', config | more)
    assert read.rdd.getNumPartitions() == 3 and read.count() == 5


def test_filters_on_stems_see_distinct_words(spark):
    rows = spark.createDataFrame([(1, "things thing the"), (2, "thing")], "id long, text string")
    made = build_index(rows, analysis=Analysis(stemmer="porter"))
    for plan in (made.wordlist.filter("term = 'thing'"), made.postings_of(["thing"])):
        lines = plan._jdf.queryExecution().optimizedPlan().toString().split("\n")
        at = [i for i, line in enumerate(lines) if "ArrowEvalPython" in line or "pythonUDF" in line or "stems(" in line]
        assert at and all(any("Aggregate [term" in below for below in lines[i + 1 :]) for i in at)
        assert not any("Filter" in line and "stems(" in line for line in lines)
    assert {(r["term"], r["doc_id"], r["hit_count"]) for r in made.postings_of(["thing"]).collect()} == {("thing", 1, 2), ("thing", 2, 1)}
    assert {(r["term"], r["doc_id"], r["hit_count"]) for r in made.postings.collect()} == {("thing", 1, 2), ("thing", 2, 1), ("the", 1, 1)}
    assert made.delete([2]).postings_of(["thing"]).count() == 1
    found = search.search(made, "things").doc_scores
    assert found.count() == 2


def test_changes_concern_rows_and_the_dictionary_needs_no_postings(spark):
    rows = spark.createDataFrame([(1, "one two two"), (2, "two, three"), (3, None), (4, "...")], "id long, text string")
    made = build_index(rows)
    for changed in (made, made.delete([1]), made.insert(rows), made.update(rows.filter("id = 2"))):
        plan = changed.wordlist._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [term" in plan and not any("Aggregate [term" in line and "doc_id" in line.split("]")[0] for line in plan.split("\n"))
    kept = made.delete([1, 3, 4, 9])  # ids without words don't lower the number of documents
    assert kept.total_documents == 3 and {tuple(r) for r in kept.wordlist.collect()} == {("two", 1, 1), ("three", 1, 1)}
    assert {tuple(r) for r in made.update(spark.createDataFrame([(2, "two two"), (5, "six")], rows.schema)).wordlist.collect()} == {("one", 1, 1), ("two", 4, 2), ("six", 1, 1)}
    twice = build_index(rows.unionByName(rows.filter("id = 1")))  # an id that comes twice is one document of the dictionary
    assert {tuple(r) for r in twice.wordlist.collect()} == {("one", 2, 1), ("two", 5, 2), ("three", 1, 1)} and twice.total_documents == 5
    assert {tuple(r) for r in twice.delete([1]).wordlist.collect()} == {("two", 1, 1), ("three", 1, 1)} and twice.delete([1]).total_documents == 4


def test_batches_are_scored_by_document(spark, monkeypatch):
    rows = spark.createDataFrame([(i, " ".join(w for j, w in enumerate(("one", "two", "three", "four", "all")) for _ in range((i * (j + 3)) % 4 + (j == 4)))) for i in range(300)] + [(7, "one two"), (None, "two all")], "id long, text string")
    phrases = spark.createDataFrame([(1, "one two"), (2, "All all three"), (3, "none"), (4, "four one none"), (5, "")], "query_id int, phrase string")
    made = build_index(rows)
    for index in (made, made.insert(rows.filter("id < 9")), made.delete([8])):
        found = {}
        for words in (search.QUERY_WORDS, 0):  # few words, and more than go to every task
            for products in (search.PRODUCTS, 40):
                monkeypatch.setattr(search, "QUERY_WORDS", words)
                monkeypatch.setattr(search, "PRODUCTS", products)
                plan = search.search_many(index, phrases, 7)
                if words:
                    assert "MapInArrow" in plan._jdf.queryExecution().optimizedPlan().toString()
                found[words, products] = sorted((r["query_id"], r["rank"], r["doc_id"] or -1, r["score"]) for r in plan.collect())
        assert len({str(f) for f in found.values()}) == 1 and {q for q, *_ in plan.select("query_id").distinct().collect()} == {1, 2, 4}


def test_stored_postings_are_counted_by_row_and_ranged(spark, tmp_path, monkeypatch):
    texts = [(i, None if i % 9 == 0 else " ".join(f"w{(i * j) % 31:02}" + "é𝒳" * (j % 2) for j in range(i % 12))) for i in range(200)]
    rows = spark.createDataFrame(texts, "id long, text string")
    wanted = sorted(map(tuple, build_index(rows, "id").postings.collect()))
    ranged = []
    monkeypatch.setattr(store_module, "_counted", lambda *of, counted=store_module._counted: ranged.append(of) or counted(*of))
    monkeypatch.setattr(store_module, "_TOKENS", 50)
    store = IndexStore(spark, str(tmp_path))
    made = store.create("a", rows, "id")
    assert ranged and sorted(map(tuple, made.postings.collect())) == wanted and made.total_documents == 200
    spans = sorted((r["low"], r["high"]) for r in made.postings.groupBy(F.input_file_name()).agg(F.min("term").alias("low"), F.max("term").alias("high")).collect())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    twice = store.create("b", rows.unionByName(rows.filter("id = 5")), "id")  # an id that comes twice has one posting of a term
    assert len(ranged) == 1 and twice.postings.count() == len(wanted) and twice.total_documents == 201
    assert store.create("c", rows.limit(0), "id").postings.count() == 0


def test_counts_of_classified_words_move_once(spark):
    rows = spark.createDataFrame([(i, ("spam offer", "plain letter")[i % 2] + f" w{i}", ("bad", "good")[i % 2]) for i in range(20)] + [(20, None, None)], "doc_id long, text string, label string")
    found = classifier.predict(classifier.train(rows), rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    texts = [i for i, line in enumerate(plan) if "RepartitionByExpression [doc_id" in line]
    counts = [i for i, line in enumerate(plan) if "Aggregate [doc_id" in line and "term" in line.split("]")[0]]
    assert counts and all(any(i < at < i + 6 for at in texts) for i in counts)
    assert {r["doc_id"]: r["label"] for r in found.collect()} == {i: ("bad", "good")[i % 2] for i in range(20)} | {20: "bad"}
