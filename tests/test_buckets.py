"""Stops in buckets by train and segment: ordered work reads them without a shuffle, and gives the same rows."""

import re

import pytest

from wayframe.operators import repair, segments, timetable
from wayframe.sources import sinks


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    # one train holds a third of all stops
    rows, clock = [], 0
    for t, n in [(0, 4000), *((i, 8) for i in range(1, 1001))]:
        for seq in range(1, n + 1):
            clock = (clock + 37 * (seq % 11) + 5) % 1440
            rows.append((f"{t:05d}", f"S{(t * 7 + seq * 13) % 50}", seq, clock, (clock + 3) % 1440))
    stops = spark.createDataFrame(rows, "train_number string, station_code string, seq int, arr_min int, dep_min int")
    stations = spark.createDataFrame([(f"S{i}", 10.0 + i * 37 % 28, 70.0 + i * 53 % 29) for i in range(50)], "code string, lat double, lng double")
    path = str(tmp_path_factory.mktemp("stations") / "all")
    stations.coalesce(1).write.parquet(path)  # Spark knows the size of a file
    stations = spark.read.parquet(path)
    table = sinks.bucketed_by_segment(stops, str(tmp_path_factory.mktemp("buckets") / "stops"), ["train_number"], "seq", 8, width=256)
    return stops, stations, table


OPERATORS = {
    "days": lambda stops, stations: timetable.infer_day(stops),
    "detours": lambda stops, stations: timetable.stop_detour(stops, stations),
    "midpoints": lambda stops, stations: repair.neighbour_midpoints(stops, stations),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_are_those_of_unbucketed_stops(tables, name):
    stops, stations, table = tables
    want, got = OPERATORS[name](stops, stations), OPERATORS[name](table, stations)
    assert segments.SEGMENT not in got.columns and sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_stops_are_not_shuffled(spark, tables, name):
    """Every exchange in the plan moves summary rows: it stands above an aggregate, never right above the scan of the stops."""
    _, stations, table = tables
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # the stations fit, the stops do not
    try:
        lines = OPERATORS[name](table, stations)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    depth = lambda line: len(re.match(r"[ :+\-*]*", re.sub(r"\*?\(\d+\)", "", line)).group())
    assert any("FileScan parquet spark_catalog.default.bucketed_" in x and "Bucketed: true" in x for x in lines)
    for at, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = []
            for other in lines[at + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            text = "\n".join(below)
            assert "bucketed_" not in text or "Aggregate" in text, f"{line}\n{text}"


def test_a_long_train_is_spread_over_buckets(spark, tables):
    stops, _, table = tables
    files = {r[0] for r in table.where("train_number = '00000'").selectExpr("_metadata.file_name").distinct().collect()}
    assert len(files) > 3
