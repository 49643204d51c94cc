import pytest
from pyspark.sql import functions as F

from lexigrain.functions import highlight as H
from lexigrain.functions import strings as S
from lexigrain.functions.stopwords import STOPWORDS
from lexigrain.functions.tokenizers import EdgeNGramTokenizer, NGramTokenizer, Tokenizer, decode_entities, padded_trigrams, register_tokenizer, tokenizer
from lexigrain.operators import keywords


def tokens(spark, by, text, stop=()):
    return spark.createDataFrame([(text,)], "t string").select(by.tokens(F.col("t"), stop).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("bigram", "Quick Foxes", "qu ui ic ck fo ox xe es"),
        ("trigram", "Quick Foxes", "qui uic ick fox oxe xes"),
        ("fourgram", "Quick Foxes", "quic uick foxe oxes"),
        ("fivegram", "Quick Foxes", "quick foxes"),
        ("edge_ngram", "Quick Foxes", "qu qui quic quick fo fox foxe foxes"),
        ("edge_ngram", "Germany a", "ge ger germ germa german germany"),
        ("default", "Oh, 2 mails: me@home.org; Bob's_x čćž-šđ", "oh 2 mails me@home org bob s_x čćž-šđ"),
        ("product", "Superman (1941), test's v1.2", "superman (1941) test's v1 2"),
    ],
)
def test_tokens(spark, name, text, want):
    assert tokens(spark, tokenizer(name), text) == want.split()


def test_ngrams_of_several_lengths(spark):
    assert tokens(spark, NGramTokenizer(least=1, most=2), "Quick Fox") == "q u i c k qu ui ic ck f o x fo ox".split()


def test_no_tokens(spark):
    for by in (Tokenizer(), NGramTokenizer(), EdgeNGramTokenizer()):
        assert tokens(spark, by, "") == []
        assert tokens(spark, by, None) == []


def test_stopwords_keep_repeats(spark):
    assert tokens(spark, Tokenizer(), "the fox the fox", ["the"]) == ["fox", "fox"]
    assert len(STOPWORDS) == 10 and all(len(w) > 30 for w in STOPWORDS.values())


def test_own_tokenizer(spark):
    register_tokenizer("semicolons", lambda c: F.split(F.lower(c), ";"))
    assert tokens(spark, tokenizer("semicolons"), "A b;C") == ["a b", "c"]
    with pytest.raises(ValueError):
        tokenizer("nothing")


def test_trigrams_and_entities(spark):
    row = spark.createDataFrame([("mood", "caf&eacute; &amp; bar")], "w string, h string").select(padded_trigrams(F.col("w")).alias("t"), decode_entities(F.col("h")).alias("d")).first()
    assert row["t"] == "__m _mo moo ood od_ d__"
    assert row["d"] == "café & bar"


def test_entities_cut_off(spark):
    rows = spark.createDataFrame([("token = &quot</title>",), ("&amp&amp;&amp</b> &amp;quot; &#233;&#xe9;&#233 &nosuch;&copyx; &copy;",), (None,)], "h string")
    assert [r[0] for r in rows.select(decode_entities("h")).collect()] == ["token = &quot</title>", "&&&</b> &quot; éé&#233 &nosuch;&copyx; ©", None]


def marked(spark, text, needle, tag="em", **options):
    return spark.createDataFrame([(text,)], "t string").select(H.highlight(F.col("t"), needle, tag, H.HighlightOptions(**options)).alias("x")).first()["x"]


def test_highlight(spark):
    text = "Thin ice is thin"
    assert marked(spark, text, "in ice", whole_word=False) == "Th<em>in</em> <em>ice</em> is th<em>in</em>"
    assert marked(spark, text, "in ice") == "Thin <em>ice</em> is thin"
    assert marked(spark, text, "thin", case_sensitive=True) == "Thin ice is <em>thin</em>"
    assert marked(spark, text, "thin", "b") == "<b>Thin</b> ice is <b>thin</b>"
    assert marked(spark, text, "") == text
    assert marked(spark, None, "text") is None
    out = marked(spark, "the price and the weight", "price weight", "span", simple=True, attributes={"class": "price-weight", "x": "$1\\"})
    assert out.count("<span") == 2 and 'x="$1\\"' in out
    assert marked(spark, '<a href="text">text</a> b', "text") == '<a href="text"><em>text</em></a> b'
    assert marked(spark, '<a href="u">text</a> b', "text", strip_links=True) == "<em>text</em> b"


def test_snippet(spark):
    text = "bla " * 20 + "here we see the phrase some red fox somewhere " + "bla " * 55
    assert H.snippet_of(text, "red fox", 60, 20) == "...the phrase some red fox somewhere bla bla bla bla bla..."
    assert H.snippet_of("short", "x") == "short"
    assert H.snippet_of("word " * 100, "nothing", 50).endswith("...")
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(H.snippet(F.col("t"), "phrase", 60).alias("x")).toPandas().x.tolist()
    assert "phrase" in got[0] and got[1] is None and got[2] == ""


@pytest.mark.parametrize("a, b, want", [("DWAYNE", "DUANE", 0.822), ("MARTHA", "MARHTA", 0.944444), ("DIXON", "DICKSONX", 0.766667), ("JELLYFISH", "SMELLYFISH", 0.896296), ("a", "a", 0), ("", "", 1), ("", "a", 0)])
def test_jaro(a, b, want):
    assert S.jaro(a, b) == pytest.approx(want, abs=1e-3)


def test_jaro_winkler(spark):
    jw = S.jaro_winkler
    assert jw("al", "al") == 1
    assert 0.961 < jw("martha", "marhta") < 0.962
    assert 0.832 <= jw("jones", "johnson") <= 0.833
    assert 0.84 <= jw("dwayne", "duane") <= 0.841
    assert 0.813 <= jw("dixon", "dicksonx") <= 0.814
    assert jw("fvie", "ten") == 0
    assert jw("zac ephron", "zac efron") > jw("zac ephron", "kai ephron")
    assert jw("brittney spears", "britney spears") > jw("brittney spears", "brittney startzman")
    rows = spark.createDataFrame([("martha", "marhta"), (None, "a")], "a string, b string")
    got = [r[0] for r in rows.select(S.jaro_winkler_similarity("a", "b")).collect()]
    assert got[0] == pytest.approx(0.9611, abs=1e-3) and got[1] is None


def test_vectors():
    assert S.norm([3, 4]) == 5
    assert S.dot([1, 2, -5], [4, 8, 1]) == 15
    place = {c: S.vector(c)[0] for c in "otn"}
    assert len(set(place.values())) == 3 and S.vector("toot") == [place["t"], place["o"], place["o"], place["t"]]
    assert S.cosine([1, 2, 3], [4, 5, 6]) == pytest.approx(0.9746318461970762)
    assert S.cosine([], []) == 0
    assert [bool(x) for x in S.aligned(S.vector("abcxd"), S.vector("abd"))] == [True, True, False, False, True]
    assert S.edit_distance("kitten", "sitting") == 3 and S.edit_distance("Керол", "Кэрол") == 1


def test_fuzzy_match(spark, tmp_path):
    items = spark.createDataFrame([("search",), ("research",), ("something",), (None,)], "item string")
    got = {r["item"]: r["score"] for r in S.fuzzy_match(items, "search").collect()}
    assert got["search"] == pytest.approx(1.2, abs=1e-2) and got["research"] == pytest.approx(1.066, abs=1e-2) and len(got) == 2
    (tmp_path / "words.txt").write_text("Search \nresearch\nother\n")
    got = [r["item"] for r in S.fuzzy_match_file(spark, str(tmp_path / "words.txt"), "search").collect()]
    assert got == ["Search", "research"]
    odd = spark.createDataFrame([("a.b",), ("axb",)], "item string")
    assert [r["item"] for r in S.fuzzy_match(odd, "a.").collect()] == ["a.b"]


def test_rake(spark):
    docs = spark.createDataFrame([(1, "A scoop of ice cream"), (2, ""), (3, None), (4, "the of and")], "doc_id long, text string")
    got = [(r["doc_id"], r["phrase"], r["score"]) for r in keywords.rake(docs).orderBy("doc_id", "place").collect()]
    assert got == [(1, "ice cream", 4.0), (1, "scoop", 1.0)]
    text = "Deep red sea and red sea birds; the sea"
    got = [(r["phrase"], r["score"]) for r in keywords.rake(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("place").collect()]
    assert got == [("deep red sea", pytest.approx(25 / 3)), ("red sea birds", pytest.approx(25 / 3))]


def test_rake_shuffles_texts_once(spark):
    docs = spark.createDataFrame([(1, "red sea birds"), (2, "deep red sea")], "doc_id long, text string")
    plan = keywords.rake(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange" in plan.split("Generate")[-1]


def test_edit_distance_of_whole_dictionary(spark):
    from lexigrain.plans import queries as plans
    from tests.compare import DATA

    sf_dir = str(DATA / "sf0.001")
    got = {r["term"]: (r["n"], r["distance"]) for r in plans.QUERIES["edit_distance"](spark, sf_dir).collect()}
    terms = {r["term"] for r in plans.QUERIES["wordlist"](spark, sf_dir).collect()}
    assert any(not t.isascii() for t in terms)
    assert got == {t: (t.count("e"), S.edit_distance(t, "worthless")) for t in terms}


def test_single_characters_need_no_lambda(spark):
    rows = spark.createDataFrame([(1, "é𝒳a b"), (2, "𝒳"), (3, ""), (4, None)], "id int, text string")
    made = rows.select("id", NGramTokenizer(least=1, most=2).tokens(F.col("text")).alias("tokens"))
    assert dict(map(tuple, made.collect())) == {1: ["é", "𝒳", "a", "é𝒳", "𝒳a", "b"], 2: ["𝒳"], 3: [], 4: []}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("substr") == 1
