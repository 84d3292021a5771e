"""Source mixing and fill-in-the-middle against brute force."""

import hashlib
import heapq
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayframe.llm import apportionment, fill_in_middle

SCHEMA = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_seats(votes, seats, caps):
    got = [0] * len(votes)
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0 and caps[i]]
    heapq.heapify(heap)
    while heap and sum(got) < seats:
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def test_seats_go_to_the_highest_quotients():
    rng = np.random.default_rng(7)
    for turn in range(200):
        n = int(rng.integers(1, 12))
        votes = rng.integers(0, 40, n) * (1.0 if turn % 2 else rng.random())
        caps = rng.integers(0, 60, n)
        seats = int(rng.integers(0, 200))
        assert apportionment.apportioned(votes, seats, caps).tolist() == brute_seats(votes.tolist(), min(seats, int(caps.sum())), caps.tolist())


def test_targets_stop_at_twice_the_size():
    assert apportionment.targets([100, 100, 100], [3, 1, 2], 1.5, 2) == [200.0, 250 / 3, 2 * 250 / 3]
    assert apportionment.targets([1, 1000, 0], [3, 1, 2], 1.5, 2) == [2.0, 1.5 * 1001 - 2, 0.0]
    assert apportionment.targets([0, 0], [3, 1], 1.5, 2) == [0.0, 0.0]


ROWS = [(1, "a b c " * 40, "x"), (2, None, "x"), (3, "", "y"), (4, " \t", None), (5, "w " * 30_000, "z"), (6, "é ü " * 50, None), (None, "q r " * 30, "y"),
        (7, "u v", "é"), (7, "u v", "é"), (7, "other of that id", "é"), (8, "only", ""), *[(9, "one of many copies " * 5, "hot")] * 1000, *[(100 + i, "s t u " * i, "y") for i in range(80)]]


def check_mix(rows, found, shards_blocks):
    """Rows, targets and taken words; nearness in blocks."""
    assert sorted((str(d), n) for d, n, *_ in found) == sorted((str(d), len(WORD.findall(t or ""))) for d, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, apportionment.targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)))
    taken = dict.fromkeys(names, 0)
    for _, n, s, size, target, spans in found:
        assert size == sizes[s] and target == want[s]
        assert all(0 <= x.start and x.length > 0 and x.start + x.length <= n and 0 < x.times <= 2 for x in spans)
        assert all(x.start + x.length <= y.start for x, y in zip(spans, spans[1:]))
        taken[s] += sum(x.length * x.times for x in spans)
    assert all(abs(taken[s] - want[s]) <= shards_blocks for s in names), (taken, want)


@pytest.mark.parametrize("limits", [(64, 1 << 22), (8, 500)])
def test_mix_of_odd_documents(spark, limits):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("shard", F.lit(1)).withColumn("words", F.lit("x")).withColumn("size", F.lit(3))
    mix = apportionment.mixed(docs.repartition(5), block_words=limits[0], shard_words=limits[1])
    found = [(r.doc_id, r["size"], r.source, r.source_size, r.target, r.spans) for r in mix.collect()]
    check_mix(ROWS, found, limits[0])
    again = apportionment.mixed(docs.coalesce(1), block_words=limits[0], shard_words=limits[1]).collect()
    assert sorted(map(str, again)) == sorted(map(str, mix.collect()))
    texts = apportionment.mixed_texts(mix, docs).collect()
    assert sum(len(WORD.findall(r.text)) * r.times for r in texts) == sum(x.length * x.times for *_, spans in found for x in spans)
    whole = {}
    for d, t, s in ROWS:
        whole.setdefault((d, s), []).append(" ".join(WORD.findall(t or "")))
    assert all(any(r.text in t for t in whole[r.doc_id, r.source]) for r in texts)


def test_mix_of_nothing(spark):
    assert apportionment.mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    none = apportionment.mixed(spark.createDataFrame([(1, None, None), (2, "", "a")], SCHEMA)).collect()
    assert [(r.doc_id, r["size"], r.source_size, r.target, r.spans) for r in sorted(none, key=lambda r: r.doc_id)] == [(1, 0, 0, 0.0, []), (2, 0, 0, 0.0, [])]


def brute_middle(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MIDDLES = [(1, None), (2, ""), (3, "  "), (4, " a "), (5, "é日本 x\ty z"), (6, "a <P> b"), (7, "<S>"), (8, "x<M>"), (None, "abc d"), (9, "w " * 300_000), (10, "q" * 3_000_000),
           *[(i, "😀 b\n\nc d  ") for i in range(20, 60)], *[(i, "a < P> <P <S b <M") for i in range(60, 90)], (30, "again"), (30, "again")]


def test_middles(spark):
    docs = spark.createDataFrame(MIDDLES, "doc_id long, text string").repartition(4).withColumn("n", F.lit("x")).withColumn("cut", F.lit(1)).withColumn("digest", F.lit(2))
    out = fill_in_middle.fill_in_middle(docs)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(brute_middle(*r)) for r in MIDDLES)
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}
    back = out.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((d, t or "")) for d, t in MIDDLES)
    assert fill_in_middle.fill_in_middle(docs.limit(0)).collect() == []


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(2)
    for n in (1, 2, 15, 16, 17, 100, 5000):
        points = rng.integers(1, 9, n)
        units = fill_in_middle.SkipList(points, seed=int(rng.integers(99)))
        assert all(units.code_points(k) == points[:k].sum() for k in ({*range(0, min(n, 40) + 1)} | {n, n // 2, n // 3}))
        for lane, (width, code, below) in enumerate(units.lanes):
            assert width.sum() == n and code.sum() == points.sum() and (lane == 0 or len(below) < len(units.lanes[lane - 1][0]))
    assert len(fill_in_middle.SkipList(np.ones(5000, np.int64)).lanes) > 2
