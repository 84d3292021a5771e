"""The whole search with a model, on the smallest folder."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from checks import group_search as g
from wayframe.plans.search import TripSearch
from wayframe.sources.adapters import Network


@pytest.fixture(scope="module")
def found(spark):
    net = Network(spark, "/root/testdata/sf0.001")
    tables = g.search_tables(net)
    seen = net.trains().select(
        F.col("number").alias("train_no"), F.lit(40.0).alias("avg_delay"), F.lit(25.0).alias("p50"), F.lit(60.0).alias("p80"),
        F.lit(90.0).alias("p90"), F.lit(60.0).alias("on_time_pct"), F.lit(500).cast("bigint").alias("n_obs"),
    )
    settings = replace(g.settings(), hub_min=1, few_directs=1000)
    search = TripSearch(net.requests(), replace(tables, delays=seen), F.lit(g.AS_OF).cast("date"), settings, g.trained(net).forest)
    return search, {(r["request_id"], r["position"]): r for r in search.routes.collect()}


def test_prediction_needs_a_date(found):
    search, rows = found
    undated = {r["request_id"] for r in search.trips.filter(F.col("day").isNull()).select("request_id").collect()}
    sources = {r["source"] for r in rows.values() if r["request_id"] in undated and not r["road_only"]}
    assert "predicted" not in sources and sources
    assert "predicted" in {r["source"] for r in rows.values()}


def test_lists_are_cut_dense_and_explained(found):
    _, rows = found
    by_request = {}
    for (request, position), r in rows.items():
        by_request.setdefault(request, []).append(position)
        assert sum(p["weight"] or 0 for p in r["breakdown"]) == (0 if r["road_only"] else 100)
        assert 25 <= r["reliability"] <= 97 and r["why"]
        total = sum(leg["minutes"] or 0 for leg in r["legs"]) + (r["wait"] or 0)
        assert r["minutes"] == (max(15, total) if r["road_only"] else total)
        assert r["fare"] == sum(leg["fare"] or 0 for leg in r["legs"])
        if not r["road_only"]:
            fares = [c["fare"] for c in r["class_fares"]]
            assert fares == sorted(fares)
    assert all(sorted(p) == list(range(1, len(p) + 1)) and len(p) <= 16 for p in by_request.values())


def test_plan_b_leaves_later_and_changes_leave_time(found):
    _, rows = found
    keys = {(r["request_id"], r["route_key"]): r for r in rows.values()}
    later = [(r, keys[(r["request_id"], r["plan_b_route"])]) for r in rows.values() if r["plan_b_route"]]
    assert later and all(alt["dep_min"] > r["dep_min"] for r, alt in later)
    assert all(r["plan_b"].startswith("Miss it? Next train: ") for r, _ in later)
    changes = [r for r in rows.values() if r["transfers"] == 1]
    assert changes and all(30 <= r["wait"] <= 360 and 35 <= r["safety"] <= 98 for r in changes)


def test_reasoning_covers_every_request(found):
    search, rows = found
    modes = {r["request_id"]: r for r in search.reasoning.collect()}
    assert set(modes) == {request for request, _ in rows}
    assert {r["mode"] for r in modes.values()} <= {"direct", "cross-origin"}
    assert all(r["conclusion"] for r in modes.values())


def test_many_points_of_one_cell_are_spread(spark, monkeypatch):
    """A radius search cuts its points by their number, those of one cell too, and finds the same pairs."""
    from wayframe.operators import stations as places

    points = spark.range(600).select("id", (20 + F.col("id") % 7 / 100).alias("lat"), (75 + F.col("id") % 11 / 100).alias("lng"))
    stations = spark.createDataFrame([(f"S{i}", 20.0 + i / 10, 75.0) for i in range(20)] + [("N", None, None)], "code string, lat double, lng double")
    pairs = lambda: places.within_km(points, stations, 50.0)
    want = sorted((r["p_id"], r["code"], round(r["km"], 6)) for r in pairs().collect())
    monkeypatch.setattr(places, "POINTS_PER_TASK", 20, raising=False)
    monkeypatch.setattr(places, "POINTS_PER_PIECE", 100, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables of any size
    try:
        rows = pairs().withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r["p_id"], r["code"], round(r["km"], 6)) for r in rows) == want and len(want) > 600
    assert len({r["task"] for r in rows}) > 8


def test_tables_of_requests_and_trains_are_not_broadcast(found):
    """Their files are small for their rows: what is joined with them is sorted and merged."""
    search, _ = found
    tables = [search.trips, *search.heads, search.directs, search.changes, search.rail, search.shown]
    tables += [search.tables.trains, search.tables.delays, search.tables.distances, search.tables.stops]
    for t in tables:
        key = t.columns[0]
        few = t.sparkSession.range(9).select(F.col("id").cast(t.schema[key].dataType).alias(key))
        for joined in (few.join(t.groupBy(key).count(), key), few.join(t, key, "left"), t.join(few, key)):
            assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_written_steps_release_their_shuffle_files(spark):
    import time

    from wayframe.session import cut_lineage, release

    held = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()

    def settled(most):
        until = time.time() + 20
        while held() > most and time.time() < until:
            time.sleep(0.2)
        return held()

    release(spark)
    time.sleep(2)
    before = held()
    for _ in range(3):
        assert cut_lineage(spark.range(100).groupBy(F.col("id") % 7).count()).count() == 7
    assert settled(before + 1) <= before + 1  # of the last count alone
