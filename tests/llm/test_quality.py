import numpy as np
from pyspark.sql import functions as F

from terrajobs.llm import quality as op

from .common import SMALL, awkward

MEDIUM = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    scored = op.op2_quality_classifier(spark, MEDIUM)
    assert scored.count() == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    held = scored.where("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.93
    assert scored.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> cast(score >= 0.3 as int)").count() == 0


def test_awkward_documents(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (8, 1), (10, None), (None, 1), (9, 0), (12, 1), (6, 0)], "doc_id long, quality int")
    out = op.score_documents(docs, labels)
    assert out.count() == docs.count() and out.where("score IS NULL").count() == 0
    same = {r["score"] for r in out.where("doc_id IN (3, 4)").collect()}
    assert len(same) == 1  # null and empty are one text
    assert {r["score"] for r in op.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert op.score_documents(awkward(spark, []), labels).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("quality", F.when(op.fold() == op.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (op.score_documents(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_model_does_not_depend_on_partitions(spark):
    stats = op.with_statistics(spark.read.parquet(f"{MEDIUM}/documents.parquet"))
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    a, b = op.fit(stats, labels), op.fit(stats.repartition(13), labels.repartition(5))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.values, b.values)


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    d = len(op.STATISTICS)
    model = op.Model(np.zeros(d), np.ones(d), np.random.default_rng(0).normal(0, 1 / np.sqrt(d), (d, 4096)), rng.uniform(0, 2 * np.pi, 4096), None, None, None)
    x = rng.normal(size=(20, d))
    phi = model.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(phi @ phi.T - want).max() < 0.1


def test_isotonic():
    assert op.pool_adjacent_violators(np.array([0.0, 1.0, 0.5, 2.0]), np.ones(4)).tolist() == [0.0, 0.75, 0.75, 2.0]
    rng = np.random.default_rng(2)
    v, w = rng.random(200), rng.integers(1, 9, 200)
    out = op.pool_adjacent_violators(v, w)
    assert (np.diff(out) >= -1e-12).all() and abs((out * w).sum() - (v * w).sum()) < 1e-9


def test_long_texts_go_by_chunks(monkeypatch):
    text = "some words repeat here and there " * 3000
    whole = op.statistics(text)
    monkeypatch.setattr(op, "CHUNK", 4096)
    assert np.allclose(op.statistics(text), whole, atol=0.02)


def test_stage_keeps_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = op.keep_good(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
