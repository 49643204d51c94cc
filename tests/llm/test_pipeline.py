"""The pipeline against plain versions of its stages, on whole small tables."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrain.llm import quality
from lexigrain.llm.packing import pack_sizes
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def packed_words(docs, model):
    """Words of each document that the pipeline should pack, by plain versions of its stages, for rows (doc_id, text)."""
    kept = [(d, t) for d, t in docs if t is not None and brute_score(model, t) >= model.threshold]
    firsts = {}
    for d, t in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
        firsts.setdefault(t, d)
    unique = [(d, t) for t, d in firsts.items() if d is not None]
    gone = {d for d, root in brute.roots(brute.near(unique, 3, 0.4)).items() if d != root}
    apart = sorted((d, t) for d, t in unique if d not in gone)
    later = {}
    for doc, s, e, removed in brute.passages(apart, 50):
        if removed:
            later.setdefault(doc, set()).update(range(s, e))
    left = {d: len(t.split()) - len(later.get(d, ())) for d, t in apart}
    return {d: n for d, n in left.items() if n}


def brute_score(model, text):
    """Log densities by the inverse of each covariance, from the statistics alone."""
    x, d = np.array(quality.statistics(text)), []
    for mean, root in zip(model.means, model.roots):
        precision = root.T @ root
        d.append((x - mean) @ precision @ (x - mean))
    return 0.5 * (d[0] - d[1]) + model.offset


def check_bins(got, docs):
    for _, shard in got.sort_values(["doc_id", "piece"]).groupby("shard"):
        assert shard.bin.tolist() == pack_sizes(shard.n_words.tolist(), 2048)
    assert (got.groupby(["shard", "bin"]).n_words.sum() <= 2048).all()


def test_run(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = packed_words(docs, model)
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert 0 < len(want) < len(docs) and got.groupby("doc_id").n_words.sum().to_dict() == want
    check_bins(got, docs)


def test_run_on_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    long = " ".join(t for _, t in rows if t) * 4
    rows += rows[:5] + [(None, rows[3][1]), (None, "no id but some words in a row"), (9001, None), (9002, ""), (9003, " \n "), (9004, ""), (9005, long), (9006, long + " and more"), (9007, rows[7][1]), (1, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("x")).withColumn("N_chars", F.lit(None).cast("long")).withColumn("sign", F.lit(1)).withColumn("salt", F.lit(2))
    for name, table in (("odd", odd), ("none", odd.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
    model = quality.train(odd, spark.read.parquet(f"{SF}/labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).toPandas()
    assert got.groupby("doc_id").n_words.sum().to_dict() == packed_words(rows, model)
    check_bins(got, rows)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path / "odd"))
        assert out.columns == odd.columns
        nulls = out.filter("text is null").count()
        assert nulls == (0 if stage is corpus_pipeline.judge_quality else 2)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
