"""The trie of conversations against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            name = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append(((t is not None, t or 0), name, (r, x)))
    own = {c: [x for *_, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + turns[h:] if rebuild else turns
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    childless = set(members) - {k[:-1] for k in members if k}
    kin, leaves, saved = (dict.fromkeys(members, 0) for _ in range(3))
    for k, v in members.items():
        if k:
            kin[k[:-1]] += 1
        for d in range(len(k) + 1):
            leaves[k[:d]] += k in childless
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, v in members.items():
        ends = ",".join(str(c) for c in sorted(v) if len(built[c]) == len(k))
        out.append((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), kin[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, convs, most, texts):
    rng = np.random.default_rng(seed)
    out = []
    for c in convs:
        out += [(c, t, ["user", "assistant"][t % 2], f"é{rng.integers(texts)}" * (1 + t % 3)) for t in range(int(rng.integers(1, most)))]
    return out


ODD = [(1, None, "user", "x"), (1, 0, None, "y"), (1, 0, None, "y"), (1, 1, "user", None), (2, 5, "a", "b:c"), (3, 5, "a:", "bc"), (None, 1, "user", "lost"),
       (-3, 0, "u", "v"), (0, 0, "u", "v"), (-7, 2, "u", "v"), (10**15, 3, "u", ""), *[(20, t, "u", "long") for t in range(90)], *[(21, t, "u", "long") for t in range(87)],
       *[(1000 + i, 0, "u", "copy") for i in range(400)], (31, 0, "u", "w" * 200_000)]
MANY = rows_of(1, range(0, 300), 14, 2) + rows_of(2, range(300, 340), 3, 50)


@pytest.mark.parametrize("rows, limits, rebuild", [(ODD, (256, 1 << 14), True), (ODD, (16, 20), False), (MANY, (256, 20), True), (MANY, (4, 7), False), (MANY, (1, 3), True)])
def test_trie(spark, rows, limits, rebuild, monkeypatch):
    if limits[0] == 1:  # a level per turn
        rows = rows_of(3, range(40), 5, 2)
    monkeypatch.setattr(prefix_trie, "SPLITTER", 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("conv", F.lit("x")).withColumn("depth", F.lit(1)).withColumn("name", F.lit(2))
    got = prefix_trie.prefix_trie(df, rebuild, *limits)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, rebuild)


def test_shards_share_only_the_skeleton(spark):
    rows = MANY + [(c, 0, "s", "one first turn") for c in range(1000, 1300)] + [(c, 1, "u", str(c)) for c in range(1000, 1300)]
    paths = spark.createDataFrame([(hashlib.sha256(str(i).encode()).hexdigest()[:32], "0" * 32 + "a" * 32 + hashlib.md5(str(i).encode()).hexdigest()) for i in range(500)], "node string, path string")
    splitters = prefix_trie._splitters(paths, 100)
    assert 10 < len(splitters) <= 15 and splitters == sorted(set(splitters))
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), False, 256, 50)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, False)


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).collect() == []
    assert [tuple(r)[:7] for r in prefix_trie.prefix_trie(spark.createDataFrame([(2, 1, "u", "x")], SCHEMA)).collect()] in (
        [(2, 0, None, 1, 0, 1, 0)],)  # h is 4: nothing of its own is left, and there is no conversation 0
