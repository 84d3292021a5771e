"""Components and the n-gram Jaccard join against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayframe.llm import jaccard_join as near
from wayframe.llm.components import components
from wayframe.llm.tables import Steps


def brute_components(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = np.random.default_rng(1)
    edges = {
        "path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 300)], "none": [],
        "random": [tuple(map(int, e)) for e in rng.integers(0, 200, (150, 2)) if e[0] != e[1]],
    }[kind]
    df = spark.createDataFrame(edges + edges[:3], "a long, b long").repartition(3)
    got = {r.node: r.component for r in components(df, Steps(spark, "test"), "t").collect()}
    assert got == brute_components(edges)


def grams(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if len(words) >= n else frozenset([tuple(words)])


def brute_near(rows, similarity=0.8):
    sets = [grams(t) for _, t in rows]
    links = [0] * len(rows)
    edges = [(i, i) for i in range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / union if union else 1) >= similarity:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    component = brute_components(edges)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(component[i], []).append(d)
    lows = {c: min((d for d in x if d is not None), default=None) for c, x in ids.items()}
    return sorted(((d, lows[component[i]], links[i], len(sets[i])) for i, (d, _) in enumerate(rows)), key=str)


def planted(seed=3, hot=40):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    base = [word() for _ in range(100)]
    rows = []
    for i in range(hot):  # different texts, each close to the others
        own = list(base)
        own[int(rng.integers(0, 100))] = f"edit{i}"
        rows.append((i, " ".join(own)))
    for i in range(30):
        rows.append((1000 + i, " ".join([word() for _ in range(60)])))
    passage = " ".join(word() for _ in range(40))
    rows += [(2000 + i, passage + " " + " ".join(word() for _ in range(40 + i))) for i in range(20)]
    rows += [(3000 + i, "same copy of a text that has more words") for i in range(25)]
    rows += [(4000, None), (4001, ""), (4002, " \n"), (4003, "one"), (4004, "one"), (4005, "two words"), (4006, "words two")]
    rows += [(None, rows[0][1]), (None, "nameless text of six whole words"), (5000, "x y z " * 2000), (5000, "x y z " * 2000), (5000, "another text under a known id number")]
    long = [word() for _ in range(3000)]
    rows += [(6000, " ".join(long)), (6001, " ".join(long[:2900])), (6002, " ".join(long[:1500]))]
    return rows


@pytest.mark.parametrize("block", [256, 7])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("node", F.lit(1)).withColumn("size", F.lit("x"))
    got = near.near_duplicates(df)
    assert got.columns == ["doc_id", "class_id", "n_links", "n_grams"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_near(rows)
    kept = near.near_dedup(df)
    assert kept.columns == df.columns
    want = {}
    for d, c, _, _ in brute_near(rows):
        want[c] = c
    left = sorted((r.doc_id for r in kept.collect()), key=str)
    assert left == sorted([c for c in want if c is not None] + [None] + [5000], key=str)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_duplicates(df).collect() == [] and near.near_dedup(df).collect() == []


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = near.near_duplicates(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_near(rows)


def test_shape_reaches_the_recall():
    bands, rows = near.band_shape()
    assert bands * rows <= near.VALUES and 1 - (1 - 0.8**rows) ** bands >= near.RECALL
    with pytest.raises(ValueError):
        near.band_shape(0.1, 0.999, 5)


def test_keys_do_not_depend_on_the_batch():
    texts = pa.array([r[1] for r in planted()])
    (_, _, g, off), = near.gram_sets(texts)
    keys = near.band_keys(g, off, 18, 5)
    for i in (0, 5, 60, len(texts) - 1):
        (_, _, own, o), = near.gram_sets(texts.slice(i, 1))
        assert (near.band_keys(own, o, 18, 5)[0] == keys[i]).all()


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (0, 1, 20, 40, 50)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert near.overlaps(sets, 7).astype(int).tolist() == want
