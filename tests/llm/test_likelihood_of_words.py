"""Scores of single words, not of their buckets."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wayframe.llm import pseudo_likelihood as likelihood


def word_hash(word):
    (_, _, words), = likelihood.window_slices(pa.array([word]))
    return words.hash


def test_bucketed_words_count_with_their_share(spark, monkeypatch):
    """Sums against brute force over the words' own counts; blocks of few texts and several shards."""
    monkeypatch.setattr(likelihood, "BLOCK", 3000)
    monkeypatch.setattr(likelihood, "SLICE", 1000)
    rng = np.random.default_rng(3)
    frequent = [f"common{i}" for i in range(likelihood.FREQUENT)]
    rare = [f"rare{i}" for i in range(1500)]
    texts = [" ".join(frequent)] * 9 + [" ".join(rng.choice(rare, 60) if i % 3 else rng.choice(frequent + rare, 200)) for i in range(60)] + ["", None, "rare1 once", "rare1 rare1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    got = {r.doc_id: r for r in likelihood.pseudo_likelihood(df, rounds=0).collect()}
    assert sorted(got) == list(range(len(texts)))
    counts = likelihood.corpus_counts(df.select("text").na.fill(""))
    vocabulary, shares = likelihood.fit_vocabulary(counts)
    weights = likelihood.new_weights(shares)
    split = [re.findall(r"\S+", t or "") for t in texts]
    count = Counter(w for ws in split for w in ws)
    symbol = {w: int(vocabulary(word_hash(w))[0]) for w in count}
    bucket = defaultdict(int)
    for w, n in count.items():
        bucket[symbol[w]] += n
    assert sum(symbol[w] >= likelihood.FREQUENT for w in count) > 1000
    for i, ws in enumerate(split):
        ids = np.array([symbol[w] for w in ws], np.int64)
        around = likelihood.windows(ids, np.zeros(len(ids), int), np.arange(len(ids)))
        want = likelihood.log_probabilities(weights, around, ids).sum() + sum(math.log(count[w] / bucket[symbol[w]]) for w in ws) if ws else 0
        assert got[i].n_words == len(ws) and got[i].log_likelihood == pytest.approx(want, rel=1e-5, abs=1e-9)


def test_each_place_is_a_target_once():
    """Rounds partition the places, and copies of a text do not mask the same ones."""
    counts = np.array([400, 0, 400, 1])
    salt = np.array([7, 8, 9, 9], np.uint64)
    for rounds in (1, 2, 3):
        parts = [likelihood.masked_places(counts, salt, turn, rounds) for turn in range(rounds)]
        assert sorted(np.concatenate(parts).tolist()) == list(range(801))
        assert all(len(p) > 600 / rounds for p in parts)
    masked = set(parts[0].tolist())
    assert {p for p in masked if p < 400} != {p - 400 for p in masked if 400 <= p < 800}
