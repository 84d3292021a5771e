"""Samples of the classifiers hold one row per id, however often it is repeated; other odd tables."""

import numpy as np
from pyspark.sql import functions as F

from wayframe.llm import quality, toxicity
from wayframe.llm.registry import table

FOLDER = "/root/testdata/sf0.01"


def test_a_repeated_labelled_id_changes_no_model(spark, monkeypatch):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    one = labels.where("toxic = 1").agg(F.min("doc_id")).first()[0]
    free = docs.join(labels, "doc_id", "left_anti").agg(F.min("doc_id")).first()[0]
    more = docs.unionByName(docs.where(F.col("doc_id").isin(one, free)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(400)))).drop("copy"))
    a, b = toxicity.fit_toxicity(docs, labels), toxicity.fit_toxicity(more, labels)
    assert np.array_equal(a.weights, b.weights)
    named = quality.feature_columns("text", "lang", "source", "n_chars").alias("features")
    x, y = (quality.fit_quality(d.select("doc_id", named), labels) for d in (docs, more))
    assert np.array_equal(x.mixing, y.mixing)
    scored = toxicity.toxicity(more, labels)
    assert scored.count() == more.count() and scored.where(F.col("doc_id") == one).select("severity").distinct().count() == 1


def test_no_documents_and_null_ids(spark):
    labels = table(spark, FOLDER, "labels")
    rows = [(None, "some words", "en", "s", 10), (None, None, None, None, None), (1, "x" * 400_000, "en", "s", 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for run in (toxicity.toxicity, quality.quality_scores):
        assert run(docs, labels).count() == 3 and run(docs.limit(0), labels).collect() == []
