"""The operators against plain versions, and on odd tables: nulls, empty and long texts, repeated rows, no rows, columns with clashing names."""

import base64
import random

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrain.llm import bpe, exact_dedup, ngram_join, nn_descent, packing, page_diff, quality, substring_dedup, suffix_dedup, toxicity
from tests.llm import brute

#: Names that operators use within.
CLASHES = ["bucket", "over", "p", "node", "set_id", "gone_doc", "cuts", "cut_doc", "shard", "h", "root"]


def table(spark, rows, extra=True):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASHES if extra else []:
        docs = docs.withColumn(c, F.lit(7))
    return docs


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed=1, n=60):
    """Near and exact copies, shared passages, short and empty texts, nulls, a repeated row and a long text."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmno") + r.choice("pqr")
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(70)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and rows:
            base = r.choice(rows)[1] or ""
            ws = base.split()
            if ws:
                ws[r.randrange(len(ws))] = "changed"
            rows.append((i, " ".join(ws)))
        elif kind == 2 and rows:
            rows.append((i, r.choice(rows)[1]))
        elif kind == 3:
            rows.append((i, text(20) + "\n" + shared + "  " + text(10)))
        else:
            rows.append((i, text(r.choice([1, 2, 5, 60, 120]))))
    return rows + [(None, "no id"), (900, None), (901, ""), (902, " \n "), (903, ""), rows[0], (904, text(30_000)), (905, "ÄÖ ÄÖ éé"), (906, "äö äö ÉÉ")]


@pytest.fixture(scope="module")
def odd():
    return corpus()


# --- exact dedup


@pytest.mark.parametrize("table_bytes", [64 << 20, 400])
def test_exact(spark, odd, table_bytes):
    got = exact_dedup.exact_duplicates(table(spark, odd), table_bytes, 4 << 20)
    assert [tuple(r) for r in sorted(got.collect())] == brute.copies(odd)


def test_one_content_in_most_rows(spark):
    """A content that overflows the table by its rows alone is spread and joined again."""
    rows = [(i % 700, "the same text") for i in range(1000)] + [(i, f"text {i % 40}") for i in range(1000, 1100)] + [(5, "text 3"), (3000, "alone"), (None, "the same text")]
    docs = table(spark, rows)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs, 2000).collect())) == brute.copies(rows)
    kept = exact_dedup.drop_exact_duplicates(docs, 2000)
    best = {}
    for d, t in rows:
        best[t] = min(best.get(t, (True, 0)), (d is None, d or 0))
    assert kept.columns == docs.columns and rows_of(kept.select("doc_id", "text")) == sorted(((d, t) for t, (_, d) in best.items()), key=repr)


def test_exact_survivors(spark, odd):
    docs = table(spark, odd)
    got = exact_dedup.drop_exact_duplicates(docs, 400)
    assert got.columns == docs.columns
    best = {}
    for d, t in odd:
        key = t if t is not None else (d,)
        best[key] = min([best[key], (d is None, d or 0, d)] if key in best else [(d is None, d or 0, d)])
    assert rows_of(got.select("doc_id", "text")) == sorted(((v[2], k if isinstance(k, str) else None) for k, v in best.items()), key=repr)


def test_table_compares_contents():
    t = exact_dedup.ContentTable()
    words = [str(i) for i in range(5000)]
    assert [t.find_or_add(w) for w in words] == [(i, True) for i in range(5000)]
    assert [t.find_or_add(w) for w in words] == [(i, False) for i in range(5000)]


# --- passages


@pytest.mark.parametrize("operator", [substring_dedup.repeated_passages, suffix_dedup.suffix_repeats])
@pytest.mark.parametrize("k, m", [(50, 6), (5, 2), (7, 7)])
def test_passages(spark, odd, operator, k, m):
    got = operator(table(spark, odd), k, m)
    assert sorted(tuple(r) for r in got.collect()) == brute.passages(odd, k)


@pytest.mark.parametrize("flush", [1, 3000, 40 << 20])
def test_one_passage_in_every_document(spark, monkeypatch, flush):
    from lexigrain.llm import superkmers

    monkeypatch.setattr(superkmers, "FLUSH_BYTES", flush)
    r = random.Random(6)
    text = lambda n: " ".join(r.choice("abcdefghij") * 2 + r.choice("klmno") for _ in range(n))
    shared = text(60)
    rows = [(i, f"{text(i % 7)} {shared} {text(9)} {shared if i % 10 == 0 else ''}") for i in range(150)]
    rows += rows[:40] + rows[20:30]
    for operator in (substring_dedup.repeated_passages, suffix_dedup.suffix_repeats):
        assert sorted(tuple(x) for x in operator(table(spark, rows).repartition(3)).collect()) == brute.passages(rows, 50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 9))
def test_groupers(tokens, k):
    tokens = np.array(tokens, np.int64)
    starts = np.arange(max(0, len(tokens) - k + 1))
    want = [tuple(tokens[s : s + k]) for s in starts]
    for group in (substring_dedup.by_sorting, suffix_dedup.by_suffix_array):
        got = group(tokens, starts, k).tolist()
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=90), st.integers(1, 12), st.integers(1, 4), st.sampled_from([1, 4, 1 << 16]))
def test_suffix_order(tokens, k, q, batch):
    pointer = suffix_dedup.bucket_pointers(np.array(tokens, np.int64), k, q, batch)
    order = sorted(range(len(tokens)), key=lambda i: tokens[i:])
    assert sorted(set(pointer.tolist())) == sorted(int(x) for x in set(pointer))
    by_place = sorted(range(len(tokens)), key=lambda i: pointer[i])
    assert [tokens[i : i + k] for i in by_place] == [tokens[i : i + k] for i in order]
    for end in set(pointer.tolist()):
        bucket = [i for i in range(len(tokens)) if pointer[i] == end]
        assert len({tuple(tokens[i : i + k]) for i in bucket}) == 1
        assert sum(p <= end for p in pointer) == end + 1


def test_deep_repeats():
    r = np.random.default_rng(1)
    part = r.integers(0, 5, 400)
    tokens = np.concatenate([part, r.integers(0, 5, 50), part[100:], np.zeros(200, np.int64), part])
    starts = np.arange(len(tokens) - 49)
    want = np.unique(np.stack([tokens[s : s + 50] for s in starts]), axis=0, return_inverse=True)[1].reshape(-1)
    got = suffix_dedup.by_suffix_array(tokens, starts, 50)
    assert len(set(zip(want.tolist(), got.tolist()))) == len(set(want.tolist())) == len(set(got.tolist()))


def test_colliding_hashes(monkeypatch):
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda a, k: np.zeros(len(a) - k + 1, np.uint64))
    tokens = np.array([1, 2, 1, 2, 3, 1, 2], np.int64)
    got = substring_dedup.by_sorting(tokens, np.arange(6), 2)
    assert got[0] == got[2] == got[5] and len(set(got.tolist())) == 4


def test_removal(spark):
    docs = spark.createDataFrame([(1, "a b\tc  d ", 9, 0), (2, None, 1, 0), (3, "", 0, 0), (None, "x", 1, 0)], "doc_id long, text string, n_chars long, cuts int")
    spans = spark.createDataFrame([(1, 1, 3, True), (1, 0, 1, False), (2, 0, 5, True), (3, 0, 5, True)], "doc_id long, start_word long, end_word long, removed boolean")
    got = substring_dedup.remove_passages(docs, spans)
    assert got.columns == docs.columns
    assert rows_of(got) == sorted([(1, "a d ", 4, 0), (2, None, 1, 0), (3, "", 0, 0), (None, "x", 1, 0)], key=repr)


def test_removal_leaves_first_copies(spark, odd):
    docs = table(spark, odd)
    got = dict(rows_of(substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs)).select("doc_id", "text").filter("doc_id is not null").distinct()))
    assert got[904] == dict(odd)[904]
    assert brute.passages(sorted(got.items()), 60) == []


# --- near pairs


def near_rows(rows, n, t):
    pairs = brute.near(rows, n, t)
    root, links = brute.roots(pairs), {}
    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    return sorted(((d, root[d], links[d]) for d in links), key=repr)


@pytest.mark.parametrize("n, t", [(3, 0.4), (1, 0.8), (2, 0.25)])
def test_near_documents(spark, odd, n, t):
    assert rows_of(ngram_join.near_documents(table(spark, odd), n, t)) == near_rows(odd, n, t)


@pytest.mark.parametrize("setting", [("BLOCK", 3), ("FLUSH_GRAMS", 50), ("FRAGMENT_BYTES", 40)])
def test_small_blocks_of_near_documents(spark, odd, monkeypatch, setting):
    monkeypatch.setattr(ngram_join, *setting)
    assert rows_of(ngram_join.near_documents(table(spark, odd))) == near_rows(odd, 3, 0.4)


def test_one_gram_in_every_document(spark):
    r = random.Random(8)
    text = lambda i: f"one for all {' '.join(r.choice('abcdefghijklmnop') * 3 for _ in range(30))} {i}"
    rows = [(i, text(i)) for i in range(200)] + [(i, "one for all one for all") for i in range(200, 400)] + [(i, f"one for all of us and number {i} and all the rest of the words") for i in range(400, 430)]
    assert rows_of(ngram_join.near_documents(table(spark, rows))) == near_rows(rows, 3, 0.4)


def test_no_shared_gram_in_the_lowest_bucket(spark):
    rows = [(i, f"w{i} x{i} y{i} z{i}") for i in range(300)] + [(1000, "w7 x7 y7 z7 more")]
    assert rows_of(ngram_join.near_documents(table(spark, rows))) == near_rows(rows, 3, 0.4) == [(1000, 7, 1), (7, 7, 1)]


def test_one_of_each_group(spark, odd):
    docs = table(spark, odd)
    got = ngram_join.keep_one_of_each_group(docs)
    assert got.columns == docs.columns
    gone = {d for d, root in brute.roots(brute.near(odd, 3, 0.4)).items() if d != root}
    assert rows_of(got.select("doc_id", "text")) == sorted([r for r in odd if r[0] not in gone], key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = dict(rows_of(ngram_join.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 105: 100}
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("fan", [2, 5])
def test_many_buckets_are_reached_in_passes(spark, odd, monkeypatch, fan):
    from lexigrain.llm import common, superkmers

    monkeypatch.setattr(common, "FAN", fan)
    monkeypatch.setattr(ngram_join, "FRAGMENT_BYTES", 20_000)
    monkeypatch.setattr(superkmers, "BUCKET_BYTES", 20_000)
    assert [common.first_width(b) for b in (1, fan, fan + 1, fan**2 + 1)] == [1, 1, fan, fan**2]
    assert rows_of(ngram_join.near_documents(table(spark, odd))) == near_rows(odd, 3, 0.4)
    assert sorted(tuple(r) for r in substring_dedup.repeated_passages(table(spark, odd)).collect()) == brute.passages(odd, 50)


# --- packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_sum_of_squares(sizes):
    bins = packing.pack_sizes(sizes, 12)
    assert bins == brute.packed(sizes, 12)
    assert all(sum(s for s, b in zip(sizes, bins) if b == x) <= 12 for x in bins)


def test_packing(spark, odd):
    got = packing.pack_documents(table(spark, odd), 64, 20).toPandas()
    assert (got.groupby(["shard", "bin"]).n_words.sum() <= 64).all()
    want = sorted((d, len(t.split())) for d, t in odd if d is not None and t and t.split())
    words = got.groupby("doc_id").n_words.sum()
    totals = {}
    for d, n in want:
        totals[d] = totals.get(d, 0) + n
    assert words.to_dict() == totals
    for shard, part in got.groupby("shard", sort=False):
        assert part.bin.tolist() == brute.packed(part.n_words.tolist(), 64), shard


# --- classifiers


def test_discriminant():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1, (300, 4)), r.normal(2, 2, (300, 4))])
    y = np.repeat([0, 1], 300)
    model = quality.fit(x, y, pool=0.0, ridge=0.0, loss=0.0)
    want = []
    for c in (1, 0):
        part = x[y == c]
        cov = np.cov(part.T, bias=True)
        d = x - part.mean(axis=0)
        want.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov)))
    # without shrinkage only the small addition that keeps factors from failing is left
    assert np.corrcoef(model.score(x), want[0] - want[1])[0, 1] > 0.999
    assert quality.fit(x, np.ones(600)) is None
    assert quality.fit(np.ones((4, 2)), np.array([0, 0, 1, 1])) is not None


@pytest.mark.parametrize("pool, ridge", [(0.5, 0.1), (1.0, 0.0), (0.0, 0.7)])
def test_regularised_discriminant(pool, ridge):
    """Covariances shrunk towards the pooled one and then towards the identity, on scaled statistics, by inverses and determinants."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, (200, 5)) @ r.normal(size=(5, 5)), r.normal(1, 2, (90, 5))])
    y = np.repeat([0, 1], [200, 90])
    model = quality.fit(x, y, pool, ridge, 0.1)
    parts = [x[y == c] for c in (0, 1)]
    within = sum(len(p) * np.cov(p.T, bias=True) for p in parts) / len(x)
    scale = np.sqrt(np.diag(within)) + 1e-6
    z, logs = x / scale, []
    for p in parts:
        cov = ((1 - pool) * np.cov(p.T, bias=True) + pool * within) / np.outer(scale, scale)
        cov = (1 - ridge) * cov + ridge * (np.trace(cov) / 5 + 1e-3) * np.eye(5)
        d = z - p.mean(axis=0) / scale
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov)) + np.log(len(p) / len(x)))
    assert np.allclose(model.score(x), logs[1] - logs[0])
    assert model.threshold == pytest.approx(min(0, np.quantile((logs[1] - logs[0])[y == 1], 0.1)))


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0
    got = quality.score_quality(docs.join(labels.filter(held), "doc_id", "left_semi").union(docs.join(labels.filter(~held), "doc_id", "left_semi")), labels.filter(~held))
    got = got.join(labels.filter(held), "doc_id").toPandas()
    assert ((got.score > 0) == (got.quality == 1)).mean() > 0.9
    assert got[got.quality == 1].keep.mean() > 0.99
    assert got[got.quality == 0].keep.mean() < 0.05


def test_odd_texts_for_quality(spark):
    rows = [(1, "Good words in a row. " * 9), (2, "x " * 50), (3, None), (4, ""), (None, "text"), (1, "Good words in a row. " * 9)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (5, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels)
    assert got.count() == 6 and {r["doc_id"]: r["keep"] for r in got.collect()}[3] is False
    assert quality.keep_good(docs, labels).columns == docs.columns
    none = quality.score_quality(docs, labels.filter("quality = 1")).collect()
    assert [r["keep"] for r in none if r["doc_id"] != 3] == [True] * 5
    assert quality.score_quality(docs.limit(0), labels).count() == quality.keep_good(docs.limit(0), labels).count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0
    labelled = docs.join(labels, "doc_id", "left_semi")
    found = {r["doc_id"] for r in toxicity.toxic_documents(labelled, labels.filter(~held)).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.filter(held).collect()}
    bad = [d for d in truth if truth[d] == 1]
    good = [d for d in truth if truth[d] == 0]
    # three hundred toxic documents teach few of the words, some thousand (the bound of training) most
    assert sum(d in found for d in bad) / len(bad) > 0.5
    assert sum(d in found for d in good) / len(good) < 0.01


def test_windows_are_compared_by_plain_frames():
    """Each window's figures are the lengths of frames that a decompressor with the same dictionary reads back."""
    r = random.Random(4)
    usual = [("".join(r.choice("abcdefgh") for _ in range(6))) for _ in range(300)]
    model = toxicity.fit([" ".join(r.choice(usual) for _ in range(60)) + (" grobnix" if i % 2 else "") for i in range(200)], [bool(i % 2) for i in range(200)])
    gains = toxicity.Gains(model)
    for word in ["grobnix", *usual[:20], "ßü", "x" * 5000]:
        raw, sizes = toxicity._MARK + toxicity.widened(f"\n{word}\n"), []
        for content in (model.ordinary, model.ordinary + model.toxic):
            known = zstandard.ZstdCompressionDict(content + toxicity._MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            frame = toxicity.Gains._compressor(content)(raw)
            assert zstandard.ZstdDecompressor(dict_data=known).decompress(frame, max_output_size=len(raw)) == raw
            sizes.append(len(frame))
        assert gains.measured(word)[0] == sizes[0] - sizes[1]
    assert gains["grobnix"] >= model.gain > max(gains[w] for w in usual)


def test_odd_texts_for_toxicity(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    usual = [word() for _ in range(400)]
    text = lambda bad: " ".join("grobnix" if bad and i % 9 == 0 else r.choice(usual) for i in range(80))
    rows = [(i, text(i % 2)) for i in range(120)] + [(500, None), (501, ""), (None, text(1)), (502, text(1)), (502, text(1)), (503, "grobnix " + text(0) * 300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (501, None)], "doc_id long, toxic int")
    docs = table(spark, rows)
    got = [r["doc_id"] for r in toxicity.toxic_documents(docs, labels).collect()]
    assert sorted(d for d in got if d is not None) == [i for i in range(120) if i % 2] + [502, 502] and got.count(None) == 1
    assert toxicity.toxic_documents(docs, labels.filter("toxic = 0")).count() == 0
    assert toxicity.toxic_documents(docs.limit(0), labels).count() == 0


# --- embeddings


def clustered(n=700, dim=16, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x[100:240] = x[100] + r.normal(size=(140, dim)) * 0.05
    for i in range(300, 400, 2):
        x[i + 1] = x[i] + r.normal(size=dim) * 0.1
    x[500:505] = x[500]
    return x


def near_vectors(pairs):
    root, links = brute.roots(pairs), {}
    for x in (x for p in pairs for x in p):
        links[x] = links.get(x, 0) + 1
    return {d: (root[d], links[d]) for d in links}


def found_vectors(spark, x, **how):
    docs = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<double>")
    rows = nn_descent.near_embeddings(docs, **how).collect()
    assert len({r["vec_id"] for r in rows}) == len(rows)
    return {r["vec_id"]: (r["class_id"], r["n_links"]) for r in rows}


def most_links(got, want, share=0.97):
    """No link too many, and nearly all of them."""
    assert set(got) <= set(want) and all(got[d][1] <= want[d][1] for d in got)
    return sum(n for _, n in got.values()) >= share * sum(n for _, n in want.values())


def test_near_embeddings(spark):
    x = clustered()
    rows = [(int(i) * 3, [float(v) for v in x[i]], 1) for i in np.random.default_rng(0).permutation(len(x))]
    rows += [(90_001, None, 1), (None, [1.0] * 16, 1), (90_002, [], 1), (90_003, [0.0] * 16, 1), (90_004, [float("nan")] * 16, 1), (90_005, [None] * 16, 1), (90_006, [1.0, 2.0], 1), (90_007, [2.0, 4.0], 1), rows[0]]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int").withColumn("a", F.lit(1)).withColumn("many", F.lit(1))
    got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in nn_descent.near_embeddings(docs, k=8, leaf=32).collect()}
    want = near_vectors({(3 * a, 3 * b) for a, b in brute.cosines(x, 0.9)} | {(90_006, 90_007)})
    assert len(want) > 200 and most_links(got, want)
    assert nn_descent.near_embeddings(docs.limit(0)).count() == 0
    assert nn_descent.near_embeddings(docs.filter("vec_id = 0")).count() == 0


@pytest.mark.parametrize("settings", [{"BLOCK": 50}, {"TOP": 64}, {"CHUNK": 12}])
def test_small_blocks_of_near_embeddings(spark, monkeypatch, settings):
    for name, value in (settings | {"PARTNERED": 20, "AUDITED": 64}).items():
        monkeypatch.setattr(nn_descent, name, value)
    monkeypatch.setattr(nn_descent, "_whole", None)  # the graph itself must be good enough
    x = clustered(520)
    assert most_links(found_vectors(spark, x, k=6, leaf=16), near_vectors(brute.cosines(x, 0.9)))


def sparse(n=2400, pairs=20, dim=64, seed=5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for i in range(0, 2 * pairs, 2):
        x[i + 1] = x[i] + r.normal(size=dim) * 0.4
    return x


def test_few_near_embeddings_among_many(spark):
    x = sparse()
    want = near_vectors(brute.cosines(x, 0.9))
    assert found_vectors(spark, x, k=2, trees=1, leaf=8) == want and len(want) >= 30


def test_trees_grow_with_sign_bits():
    assert nn_descent.grown(nn_descent.TOP, 6, 0.9) == 6
    per_tree = 1 - np.arccos(0.9) / np.pi
    for bits in (1, 5, 14):
        trees = nn_descent.grown(nn_descent.TOP << bits, 6, 0.9)
        assert trees * per_tree**bits >= 6 > (trees - 1) * per_tree**bits


def test_nearly_all_embeddings_equal(spark):
    x = np.tile(np.eye(16)[0], (600, 1))
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))] + [(700, [0.0, 1.0]), (701, [-0.0, 2.0]), (702, [0.1, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in nn_descent.near_embeddings(docs, k=6, leaf=16).collect()}
    assert got == {i: (0, 599) for i in range(600)} | {i: (700, 2) for i in (700, 701, 702)}


def test_low_recall_of_embeddings_ends_in_comparison_of_all(spark, monkeypatch):
    for name, value in (("PARTNERED", 8), ("AUDITED", 64), ("FORESTS", 1), ("RECALL", 1.01), ("PASS_BYTES", 64 * 64), ("ROWS", 40)):
        monkeypatch.setattr(nn_descent, name, value)
    x = clustered(520)
    assert found_vectors(spark, x, k=2, trees=1, leaf=8) == near_vectors(brute.cosines(x, 0.9))


# --- pages


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25), st.sampled_from([1, 8, 1 << 28]))
def test_longest_common_subsequence(a, b, cells):
    at = page_diff.common_positions(a, b, cells)
    assert at == sorted(set(at)) and len(at) == brute.lcs_length(a, b)
    it = iter(b)
    assert all(a[i] in it for i in at)


def page(main):
    return f"<html><head><title>T</title><script>x<y</script></head><body><ul><li>Home</li><li>About &amp; more</li></ul><p>{main}</p><footer>End</footer></body></html>"


@pytest.mark.parametrize("block_bytes", [4 << 20, 1])
def test_pages(spark, block_bytes):
    rows = [
        (1, "http://h/a/1", page("first")), (2, "https://H/a/2/", page("second<br>line")), (3, "http://h/b/1", page("third")), (4, "http://other/", page("alone")),
        (5, "http://h/a/1?x=1", page("query")), (6, None, page("nowhere")), (7, "http://[bad", None), (None, "http://h/a/9", page("none")), (1, "http://h/a/1", page("first")), (8, "http://h/b/2", ""),
        (9, "http://long/1", page("w<br>" * 3000 + "own")), (10, "http://long/2", page("w<br>" * 2999 + "other")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(1)).withColumn("lines", F.lit(2))
    got = {r["page_id"]: r for r in page_diff.extract_text(pages, block_bytes).collect()}
    texts = {k: v["text"] for k, v in got.items()}
    assert texts[1] == "first" and texts[2] == "second\nline" and texts[5] == "query" and texts[3].startswith("T") is True
    assert texts[4] == "T\nHome\nAbout & more\nalone\nEnd" and got[4]["mate_id"] is None
    assert texts[7] == "" and texts[8] == "" and texts[9] == "w\nown" and texts[10] == "other" and None not in texts
    assert page_diff.extract_text(pages, block_bytes).count() == 11
    assert page_diff.extract_text(pages.limit(0)).count() == 0


def brute_extract(rows):
    """Rows (page_id, url, html) -> (page_id, mate_id, text, n_lines, n_shared), every pair of neighbours looked up in one sorted list."""
    pages = sorted((page_diff.url_key(u or ""), i, page_diff.text_lines(h or "")) for i, u, h in rows if i is not None)
    out = []
    for (host, path), i, own in pages:
        before = [p for p in pages if p[0][0] == host and p[0][1] < path][-1:]
        after = [p for p in pages if p[0][0] == host and p[0][1] > path][:1]
        mate = max([*before, *after], key=lambda p: page_diff.nearness(path, p[0][1]), default=None)
        kept = own if mate is None else page_diff.unshared_lines(own, mate[2])
        out.append((i, mate and mate[1], "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [16 << 20, 2000, 1])
def test_pages_against_brute_force(spark, block_bytes):
    r = random.Random(5)
    paths = ["", "a", "a/b", "a/c/d", "a/c/e", "b", "b/1", "b/2?x=1", "hot"]
    rows = [(i, f"http://{r.choice(['h', 'k', 'l'])}/{r.choice(paths)}", page(r.choice(["one", "two<br>three", "four"]))) for i in range(60)]
    rows += [(100 + i, f"http://hot/same?id={i}", page(f"item {i}")) for i in range(80)] + [(300, "http://hot/a", page("start")), (301, "http://hot/z", page("end")), (302, None, None), (303, "http://empty/x", ""), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("low", F.lit(1)).withColumn("host", F.lit(2))
    assert rows_of(page_diff.extract_text(pages, block_bytes)) == brute_extract(rows)


def test_ranges_change_nothing(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = brute_extract([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    assert rows_of(page_diff.extract_text(pages)) == rows_of(page_diff.extract_text(pages, 2000)) == want


# --- byte pairs


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_encoding(text):
    coder = bpe.codec(bpe.VOCABULARY)
    want = [i for piece in coder.find(text) for i in brute.merges(piece.encode(), coder.ranks)]
    assert coder.encode(text).tolist() == want
    assert coder.decode(want) == text


def test_encoding_as_the_public_library_does(spark, ranks):
    import tiktoken

    known = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = bpe.encode_documents(docs).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    assert got.round_trip.all() and len(got) == docs.count()
    assert all(known.encode_ordinary(t) == list(ids) for t, ids in zip(got.text, got.token_ids))


def test_odd_texts_for_encoding(spark):
    rows = [(1, None), (2, ""), (3, " a  b \n"), (None, "x"), (3, " a  b \n"), (4, "long " * 50_000), (5, "a" * 3000), (6, "퟿🙂é")]
    docs = table(spark, rows).withColumn("token_ids", F.lit(1))
    got = bpe.encode_documents(docs)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["token_ids"] is None and by[1]["n_tokens"] is None and by[2]["token_ids"] == [] and by[2]["round_trip"] is True
    assert rows_of(bpe.decode_documents(got)) == sorted(rows, key=repr)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_other_vocabulary(spark, tmp_path):
    path = tmp_path / "tiny"
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"abab"]
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    got = bpe.encode_documents(table(spark, [(1, "ababab")]), str(path)).first()
    assert got["token_ids"] == [257, 256]


# --- empty tables


@pytest.mark.parametrize("operator", [exact_dedup.exact_duplicates, exact_dedup.drop_exact_duplicates, substring_dedup.repeated_passages, suffix_dedup.suffix_repeats, ngram_join.near_documents, ngram_join.keep_one_of_each_group, packing.pack_documents])
def test_no_rows(spark, operator):
    for rows in ([], [(None, None)], [(1, None)], [(2, "")]):
        got = operator(table(spark, rows)).count()
        assert got == (len(rows) if operator in (exact_dedup.drop_exact_duplicates, ngram_join.keep_one_of_each_group) else 0)
