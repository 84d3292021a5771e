"""Windows over hot keys against plain Python, with segments far smaller than the keys."""

import random

import pytest
from pyspark.sql import functions as F

from wayframe.operators.segments import dense_positions, exact_median, full_rank, nth_values, segmented


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # one key holds most rows
    return [(0 if rng.random() < 0.7 else rng.randrange(1, 9), i, rng.choice([None, rng.randrange(100)]), rng.random() * 50) for i in range(1500)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, pos int, v int, x double").repartition(7)


@pytest.mark.parametrize("width", [3, 64, 100000])
def test_segmented_matches_a_loop(frame, rows, width):
    v = F.col("v")
    got = segmented(frame, ["k"], "pos", sums={"total": F.coalesce(v, F.lit(0))}, lasts={"before": v}, nexts={"after": v}, width=width)
    got = {(r["k"], r["pos"]): (r["total"], r["before"], r["after"]) for r in got.collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == k)
        total, before = 0, None
        for i, r in enumerate(own):
            total += r[2] or 0
            after = next((x[2] for x in own[i + 1:] if x[2] is not None), None)
            assert got[(k, r[1])] == (total, before, after)
            before = r[2] if r[2] is not None else before


def test_dense_positions(frame, rows):
    got = {(r["k"], r["pos"]): r["seq"] for r in dense_positions(frame, ["k"], "pos", width=5).collect()}
    for k in {r[0] for r in rows}:
        own = sorted(r[1] for r in rows if r[0] == k)
        assert [got[(k, p)] for p in own] == list(range(1, len(own) + 1))


def test_full_rank_with_null_buckets(frame, rows):
    ranked = full_rank(frame, ["k"], [F.col("v")], [F.col("v"), F.col("pos")])
    got = {(r["k"], r["pos"]): r["rank"] for r in ranked.collect()}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        assert [got[(k, r[1])] for r in own] == list(range(1, len(own) + 1))


def test_order_statistics(frame, rows):
    upper = nth_values(frame, ["k"], "x", {"m": F.floor(F.col("n") / 2) + 1}, F.floor(F.col("__value") * 2))
    upper = {r["k"]: r["m"] for r in upper.collect()}
    middle = {r["k"]: r["median"] for r in exact_median(frame, ["k"], "x", 2.0).collect()}
    for k in {r[0] for r in rows}:
        xs = sorted(r[3] for r in rows if r[0] == k)
        n = len(xs)
        assert upper[k] == xs[n // 2]
        assert middle[k] == pytest.approx((xs[(n - 1) // 2] + xs[n // 2]) / 2)


def test_days_over_many_segments(spark):
    """Journey days do not depend on where a train is cut, with missing clocks at the edges."""
    import random

    from wayframe.operators.timetable import infer_day

    rng = random.Random(5)
    rows, want = [], {}
    for train in ("1", "2", "3"):
        day, prev = 1, None
        for seq in range(1, 60):
            arr, dep = (rng.randrange(1440) if rng.random() < 0.6 else None for _ in range(2))
            rows.append((train, seq, arr, dep))
            for t in (arr, dep):
                if t is not None:
                    if prev is not None and t < prev:
                        day += 1
                    prev = t
            want[train, seq] = day
    df = spark.createDataFrame(rows, "train_number string, seq int, arr_min int, dep_min int").repartition(5)
    for width in (1, 4, 1024):
        got = {(r["train_number"], r["seq"]): r["day"] for r in infer_day(df, width=width).collect()}
        assert got == want


def test_lines_of_a_network_are_numbered_once(spark, tmp_path):
    """Windows and carried sums of the stops read the numbered lines, not the table again; NULLs and equal rows keep their place."""
    import datetime

    from wayframe.sources.adapters import Network

    day = datetime.date(2024, 1, 1)
    rows = [(1, 2, 5, 7, 1.0, day), (1, 1, 6, 8, 1.0, day), (1, 1, 6, 8, 1.0, day), (1, None, 9, 4, 1.0, day), (2, 1, 3, 3, 2.0, day), (None, 1, 3, 3, 2.0, day)]
    spark.createDataFrame(
        rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, l_extendedprice double, l_shipdate date"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    stops = Network(spark, f"{tmp_path}").stops()
    assert not any("lineitem" in f for f in stops.inputFiles())
    got = sorted((r["train_number"], r["seq"], r["station_code"], r["cum_km"]) for r in stops.collect())
    assert got == [("0000001", 1, "S9", 0.0), ("0000001", 2, "S6", 28.0), ("0000001", 3, "S6", 56.0), ("0000001", 4, "S5", 83.0), ("0000002", 1, "S3", 0.0)]


def test_keys_of_one_segment_carry_nothing(spark):
    """Keys within the first segment are not joined to carried rows; longer ones beside them are, with the same results."""
    from wayframe.operators.segments import segmented

    rows = [("a", 1, 5), ("a", 2, None), ("a", 3, 7), ("b", 1, 2), ("c", 9, 1), ("c", 2, 4), ("c", 12, 6), (None, 1, 3)]
    df = spark.createDataFrame(rows, "k string, pos int, v int")
    how = dict(sums={"total": F.coalesce("v", F.lit(0))}, lasts={"before": F.col("v")}, nexts={"after": F.col("v")})
    for width in (4, 8, 64):
        got = segmented(df, ["k"], "pos", **how, width=width, lengths=df)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, segmented(df, ["k"], "pos", **how, width=width).select(got.columns).collect()), key=str)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_stops_are_written_once(spark, tmp_path, monkeypatch):
    """Stops are read as they were written, without a shuffle; orders too large for a task give the same rows in segments."""
    import datetime

    from wayframe.sources import adapters

    day = datetime.date(2024, 1, 1)
    rows = [(o, n % 3, n % 5, 3 + n, 1.0, day) for o in range(6) for n in range(40 if o == 3 else 4)] + [(None, 1, 3, 3, 2.0, day), (2, None, None, None, None, None)]
    spark.createDataFrame(
        rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, l_extendedprice double, l_shipdate date"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    net = adapters.Network(spark, f"{tmp_path}")
    stops = net.stops()
    plan = net.stops()._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and net.stops().inputFiles() == stops.inputFiles()
    light = adapters.by_weight
    monkeypatch.setattr(adapters, "by_weight", lambda df, keys: light(df, keys, limit=10))
    both = adapters.Network(spark, f"{tmp_path}").stops()
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, stops.collect()), key=str)
    short, long = light(spark.createDataFrame([(r[0],) for r in rows], "k bigint"), ["k"], limit=10)
    assert long.count() >= 40 and short.count() + long.count() == len(rows)
