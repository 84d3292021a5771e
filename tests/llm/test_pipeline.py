"""The pipeline against brute force, stage by stage, and on odd documents."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayframe.llm.registry import QUERIES, SQL

from .test_exact_and_archives import check_pieces
from .test_near_duplicates import brute_near
from .test_substrings import brute, split

FOLDER = "/root/testdata/sf0.01"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def after_exact(rows):
    last = {}
    for d, t in rows:
        last[t or ""] = max(last.get(t or "", d), d)
    return sorted((d, t) for d, t in rows if last[t or ""] == d)


def after_near(rows):
    kept = {c for _, c, _, _ in brute_near(rows)}
    return sorted((d, t) for d, t in rows if d in kept)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    outs, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        path = str(tmp_path / name.replace(" ", "-"))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        outs.append(docs)
        assert docs.columns == columns or name == "packing"
    whole, good = rows_of(spark.read.parquet(f"{FOLDER}/documents.parquet")), rows_of(outs[0])
    scores = {r.doc_id: r.kept for r in QUERIES["op9_quality"](spark, FOLDER).collect()}
    assert sorted(good) == sorted((d, t) for d, t in whole if scores[d])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert sum(d in {x for x, _ in good} for d, q in labels.items() if q) > 0.98 * sum(labels.values())
    assert sorted(rows_of(outs[1])) == after_exact(good)
    assert sorted(rows_of(outs[2])) == after_near(after_exact(good))
    near = after_near(after_exact(good))
    cut = rows_of(outs[3])
    want = {(d, s) for d, _, _, s in brute(near, 20)}
    assert {(d, hashlib.sha256(" ".join(split(t)).encode()).hexdigest()) for d, t in cut} == want and len(cut) == len(near)
    assert check_pieces(outs[4].collect(), dict(cut), 2048) < 0.01
    # run() is these stages
    piece = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ran = corpus_pipeline.run(spark, FOLDER)
    tokens = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect())
    assert ran.columns[:1] == piece[:1] and tokens(ran) == tokens(outs[4])


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents(spark, empty):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "words here", "en", "s", 10), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3),
            (4, "q " * 100_000, "en", "s", 200_000), (5, "a b", None, "s", 3), (3, "other text of that id", "en", "s", 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("node", F.lit(1)).withColumn("batch", F.lit("x")).withColumn("key", F.lit(2))
    if empty:
        docs = docs.limit(0)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns or name == "packing"
    assert (docs.count() == 0) == empty
    assert corpus_pipeline.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), FOLDER).count() <= len(rows)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twins(spark, name):
    from checks.compare import duck, run_one

    text, good = run_one(spark, duck(FOLDER), FOLDER, name, QUERIES[name], SQL[name])
    assert good, text
