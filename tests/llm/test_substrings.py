"""Recompression and repeated passages against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayframe.llm import substring_dedup as sub
from wayframe.llm.recompression import rounds
from wayframe.llm.words import Words, separators, text_bytes


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))


def brute(rows, width):
    seen, out = set(), []
    for d, t in order(rows):
        words = split(t)
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def planted():
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdeé"), int(rng.integers(1, 6)))) for _ in range(60)]
    word = lambda n: [vocabulary[int(i)] for i in rng.integers(0, 60, n)]
    passage = word(55)
    rows = [(i, " ".join(word(int(rng.integers(0, 200))))) for i in range(60)]
    rows += [(100 + i, " ".join(word(int(rng.integers(0, 30))) + passage + word(int(rng.integers(0, 30))))) for i in range(60)]
    rows += [(200 + i, "  the\n" * int(rng.integers(15, 60))) for i in range(12)]
    rows += [(230 + i, "a b " * int(rng.integers(5, 40)) + "x y") for i in range(12)]
    rows += [(260 + i, " ".join(passage[:19]) + "\x0b" + " ".join(word(3))) for i in range(3)]
    rows += [(300, " ".join(word(10) + passage + word(10) + passage)), (-5, " ".join(passage[5:45]))]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "lone"), (None, " ".join(passage)), (None, None)]
    rows += [(500, rows[60][1]), (500, rows[60][1]), (500, "other " + rows[61][1]), (501, rows[0][1]), (1 << 40, " ".join(word(3000) + passage))]
    return rows


@pytest.mark.parametrize("batch,meeting,width", [(4 << 20, 1 << 20, 20), (3000, 50, 20), (700, 20, 20), (3000, 50, 7), (3000, 50, 1)])
def test_repeated_words(spark, monkeypatch, batch, meeting, width):
    monkeypatch.setattr(sub, "BATCH", batch)
    monkeypatch.setattr(sub, "MEETING", meeting)
    monkeypatch.setattr(sub, "LONG_ROUNDS", 14 if batch > 3000 else 8)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("batch", F.lit("b")).withColumn("id", F.lit(1)).withColumn("rest", F.lit(2))
    got = sub.repeated_words(df, width=width)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, width)


def test_texts_without_repeats(spark):
    rows = planted()
    df = spark.createDataFrame([(d, t, len(t or ""), "x") for d, t in rows], "doc_id long, text string, n_chars int, batch string").repartition(5)
    got = sub.without_repeats(df, size_column="n_chars")
    assert got.columns == df.columns and dict(got.dtypes)["n_chars"] == "int"
    want = {(d, s) for d, _, _, s in brute(rows, 20)}
    found = got.collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, hashlib.sha256(" ".join(split(r.text)).encode()).hexdigest()) for r in found} == want
    assert all(r.n_chars == len(r.text or "") for r in found)
    untouched = {t for (d, t), (_, _, n, _) in zip(order(rows), [brute_one for brute_one in in_order(rows)]) if not n}
    assert untouched <= {r.text for r in found}


def in_order(rows):
    found = {}
    for r in brute(rows, 20):
        found.setdefault(r[0], []).append(r)
    for d, t in order(rows):
        own = found[d]
        n = len(split(t))
        yield next((own.pop(i) for i, r in enumerate(own) if r[1] == n), (d, n, 1, ""))


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sub.repeated_words(df).collect() == [] and sub.without_repeats(df).collect() == []
    nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [r.n_words for r in sub.repeated_words(nulls).collect()] == [0, 0]


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in sub.repeated_words(df).collect()), key=str) == brute(rows, 20)


def test_equal_texts_have_equal_symbols_inside():
    """Symbols whose contexts lie in a repeated stretch are the same, at the same places, in both occurrences."""
    rng = np.random.default_rng(1)
    for turn in range(40):
        letters = int(rng.integers(2, 9))
        shared = rng.integers(0, letters, int(rng.integers(5, 60)))
        both = []
        for _ in range(2):
            before, after = rng.integers(0, letters, int(rng.integers(0, 9))), rng.integers(0, letters, int(rng.integers(0, 9)))
            text = np.concatenate([before, shared, after]).astype(np.uint64)
            found = []
            for level, s in enumerate(rounds(text, np.zeros(len(text), int), 5)):
                assert s.first[0] == 0 and s.end[-1] == len(text) and (s.end[:-1] == s.first[1:]).all()
                assert (np.diff(s.low) >= 0).all() and (np.diff(s.high) >= 0).all()
                inside = (s.low >= len(before)) & (s.high <= len(before) + len(shared))
                found.append([(int(a) - len(before), int(b) - len(before), int(n)) for a, b, n in zip(s.first[inside], s.end[inside], s.name[inside])])
            both.append(found)
        assert both[0] == both[1]


def test_symbols_name_their_words():
    """Equal names stand for equal words, and texts do not run into each other."""
    rng = np.random.default_rng(2)
    names, owner = rng.integers(0, 3, 4000).astype(np.uint64), np.repeat(np.arange(40), 100)
    stands = {}
    for s in rounds(names, owner, 8):
        for a, b, n in zip(s.first, s.end, s.name):
            assert owner[a] == owner[b - 1]
            assert stands.setdefault(int(n), names[a:b].tobytes()) == names[a:b].tobytes()


def test_picks_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(6)]
    texts = [" ".join(rng.choice(vocabulary, 300)) for _ in range(20)]
    words = Words(*text_bytes(pa.array(texts)), separators())
    places, name, _ = sub.picks(words, 5, rounds(words.hash, words.owner(), 2)[-1])
    by = {}
    for p, n in zip(places.tolist(), name.tolist()):
        assert by.setdefault(tuple(words.hash[p : p + 5].tolist()), n) == n
