import random

import pytest
from pyspark.sql import functions as F

from wayframe.operators import model, ranking, repair, userlog
from wayframe.plans import jobs


def test_misplaced_station_is_found_and_remapped(spark):
    line = [("A", "Alpha", 20.0, 75.0), ("SGRR", "Sangar", 33.0, 75.0), ("C", "Gamma", 20.0, 75.6), ("SGRA", "Sangaria", 20.02, 75.31), ("D", "Delta", 20.0, 76.0)]
    stations = spark.createDataFrame(line, "code string, name string, lat double, lng double")
    stops = spark.createDataFrame(
        [(str(t), c, i + 1, n) for t in range(4) for i, (c, n) in enumerate([("A", "Alpha"), ("SGRR", "Sangar"), ("C", "Gamma"), ("D", "Delta")])],
        "train_number string, station_code string, seq int, station_name string",
    )
    flagged, remap, moved, counted = jobs.repair_stations(stops, stations)
    assert "SGRR" in {r["code"] for r in flagged.collect()}
    fix = remap.collect()
    assert [(r["bad_code"], r["good_code"]) for r in fix] == [("SGRR", "SGRA")] and fix[0]["match_km"] <= 10
    assert {r["station_name"] for r in moved.filter("seq = 2").collect()} == {"Sangaria"}
    assert {r["code"]: r["num_trains"] for r in counted.collect()} == {"A": 4, "SGRR": 0, "C": 4, "SGRA": 4, "D": 4}
    assert "SGRR" not in {r["code"] for r in repair.unfixed(flagged, remap).collect()}


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40000):
        train, dow = rng.randrange(20), rng.randrange(7)
        mean = 10 + 3 * train + (25 if dow >= 5 else 0)
        rows.append((str(train), i, 17.0 + 3 * train, float(train % 4), 100.0 * rng.randrange(10), rng.random(), float(rng.randrange(24)),
                     float(rng.choice([0, 0, 0, 1, 2])), float(dow), float(rng.randrange(1, 13)), float(int(max(0, rng.gauss(mean, 10))))))
    names = "train_no string, row_id int, baseline double, tier_code double, dist_km double, frac_route double, sched_hour double, day_offset double, dow double, month double, delay double"
    return jobs.train_delay_model(spark.createDataFrame(rows, names), "2025-06-01T00:00:00", ["train_no", "row_id"], cap=500, trees=10, depth=5, min_leaf=100)


def test_forest_is_calibrated_and_beats_the_flat_average(trained):
    covered = {r["level"]: r["covered"] for r in trained.coverage.collect()}
    assert all(abs(covered[q] - q) <= 0.03 for q in covered) and len(covered) == 6
    errors = trained.errors.first()
    assert errors["mae_model"] < errors["mae_baseline"]
    curves = [r["curve"] for r in trained.scored.select("curve").take(50)]
    assert all(c == sorted(c) for c in curves)
    assert {r["day_bucket"] for r in trained.strata.collect()} >= {"0"}


def test_prediction_gate_and_missing_position(trained, spark):
    names = "id int, baseline double, tier_code double, dist_km double, frac_route double, sched_hour double, day_offset double, dow double, month double"
    rows = spark.createDataFrame(
        [(1, 30.0, 1.0, 100.0, 0.5, 9.0, 0.0, 6.0, 3.0), (2, 30.0, 1.0, None, None, -1.0, 1.0, 6.0, 3.0), (3, 30.0, 1.0, 100.0, 0.5, 9.0, 2.0, 6.0, 3.0),
         (4, None, 1.0, 100.0, 0.5, 9.0, 0.0, 6.0, 3.0), (5, 30.0, 1.0, 100.0, 0.5, 9.0, 0.0, None, 3.0)], names)
    got = {r["id"]: r["p50"] for r in model.predict_quantiles(trained.forest, rows).collect()}
    assert got[1] is not None and got[2] is not None and got[3] is None and got[4] is None and got[5] is None


def test_forest_survives_saving(trained, spark, tmp_path):
    trained.forest.save(str(tmp_path / "m"))
    again = model.load_forest(spark, str(tmp_path / "m"))
    rows = trained.scored.select(*model.FEATURES, "row_id").limit(40)
    a = {r["row_id"]: r["p50"] for r in model.predict_quantiles(trained.forest, rows, gate=False).collect()}
    b = {r["row_id"]: r["p50"] for r in model.predict_quantiles(again, rows, gate=False).collect()}
    assert a == b
    aged = model.model_age(trained.forest.metadata(spark), F.lit("2025-12-15").cast("date")).first()
    assert aged["age_days"] == 197 and aged["stale"]


def test_sampling_is_whole_below_the_cap_and_repeatable(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("row_id"))
    one = {r["row_id"] for r in model.sample_per_key(df, "k", ["row_id"], cap=50).collect()}
    two = {r["row_id"] for r in model.sample_per_key(df.repartition(13), "k", ["row_id"], cap=50).collect()}
    assert one == two and len(one) == 150


def test_limiter(spark):
    base = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 10, 20, 30, 30, 100])], "key string, event_id int, sec int")
    hits = base.withColumn("ts", F.timestamp_seconds("sec"))
    got = [(r["hits"], r["flagged"], r["retry_after"]) for r in userlog.sliding_limit(hits, "key", "ts", "event_id", 3, 60).orderBy("event_id").collect()]
    assert got == [(1, False, None), (2, False, None), (3, False, None), (4, True, 31), (5, True, 31), (1, False, None)]
    assert not any(r["flagged"] for r in userlog.sliding_limit(hits, "key", "ts", "event_id", 3, 0).collect())


def test_recent_searches_ignore_case_and_saved_trips_can_go(spark):
    log = spark.createDataFrame([(1, 1, "Delhi", "Mumbai"), (1, 2, "delhi ", "MUMBAI"), (1, 3, " ", "X")], "user_id int, event_id int, from_place string, to_place string")
    log = log.withColumn("ts", F.timestamp_seconds("event_id"))
    rows = userlog.recent_searches(log).collect()
    assert [(r["from_place"], r["event_id"]) for r in rows] == [("delhi ", 2)]
    saved = spark.createDataFrame([(1, "r", 1, False), (1, "q", 1, False), (1, "r", 2, True)], "user_id int, route_id string, t int, gone boolean")
    assert [r["route_id"] for r in userlog.current_rows(saved, ["user_id", "route_id"], ["t"], F.col("gone")).collect()] == ["q"]


def test_plan_b_leaves_later(spark):
    routes = spark.createDataFrame([(1, "a", 100, 10, 60, False, 1), (1, "b", 200, 20, 60, False, 2), (1, "c", 200, 5, 60, False, 3), (1, "r", None, 1, 1, True, 4)],
                                   "request_id int, route_id string, dep_min int, fare int, minutes int, road_only boolean, position int")
    got = {r["route_id"]: r["plan_b_route"] for r in ranking.plan_b(routes).collect()}
    assert got == {"a": "b", "b": None, "c": None, "r": None}


def test_a_remap_meets_few_stations_that_share_first_letters(spark, monkeypatch):
    """Stations meet by whole name and widening radii; the plain search over all pairs gives the same remaps."""
    from wayframe.functions import geo
    from wayframe.functions.text import same_name

    rng = random.Random(8)
    names = ["Town A", "Town AB", "Town", "TOWN-A", "Twn", "T w n", "", None] + [f"City {i}" for i in range(12)]
    rows = [(f"S{i}", rng.choice(names), 10 + rng.randrange(40) / 4, 70 + rng.randrange(40) / 4) for i in range(400)]
    stations = spark.createDataFrame([*rows, ("N", "Town A", None, None), (None, "Town A", 15.0, 75.0)], "code string, name string, lat double, lng double")
    bad = stations.filter("lat is not null and code is not null").select(
        "code", "name", (F.col("lat") + 1).alias("exp_lat"), (F.col("lng") + 1).alias("exp_lng"), F.lit(7).alias("off_km"), F.lit(3).cast("bigint").alias("trains"))
    g = stations.select(F.col("code").alias("good_code"), F.col("name").alias("good_name"), "lat", "lng")
    km = geo.haversine_km(F.col("exp_lat"), F.col("exp_lng"), F.col("lat"), F.col("lng"))
    plain = bad.crossJoin(g).filter((F.col("code") != F.col("good_code")) & same_name(F.col("name"), F.col("good_name"))).withColumn("km", km).filter("km <= 300")
    plain = plain.groupBy("code").agg(F.min(F.struct("km", "good_code")).alias("r"))
    met = []

    def counted(df, *keys):
        met.append(df)
        return cut(df)

    cut = repair.cut_lineage
    monkeypatch.setattr(repair, "cut_lineage", counted)
    out = repair.propose_remap(bad, stations, max_km=300.0).collect()
    assert {(r["bad_code"], r["good_code"], r["match_km"]) for r in out} == {
        (r["code"], r["r"]["good_code"], r["m"]) for r in plain.withColumn("m", F.bround("r.km", 1)).collect()}
    assert len(out) > 300 and len(met) >= 5  # the stations, the names, the points and two radii at least


def test_features_read_the_timetable_once(spark, tmp_path):
    """Positions and the whole length come from one grouping of the stops of trains with an average."""
    rows = [("1", 1, 0.0, None, 1), ("1", 2, 90.0, 300, 1), ("1", 2, 80.0, 400, 2), ("2", 1, 5.0, 60, 1), ("3", 1, 7.0, 60, 1)]
    spark.createDataFrame(rows, "train_no string, station_no int, cum_km double, arr_min int, day int").write.parquet(f"{tmp_path}/stops")
    stops = spark.read.parquet(f"{tmp_path}/stops")
    obs = spark.createDataFrame([("1", "2025-01-04", 2, 12), ("1", "2025-01-05", 1, 3), ("3", "2025-01-05", 1, 3)], "train_no string, obs_date string, station_no int, delay_min int")
    stats = spark.createDataFrame([("1", 9.5), ("2", 4.0)], "train_no string, avg_delay double")
    tiers = spark.createDataFrame([("1", "premium")], "train_no string, tier string")
    out = model.build_features(obs, stops, stats, tiers)
    assert not any(f"{tmp_path}" in f for f in out.inputFiles())
    got = {(r["station_no"]): (r["baseline"], r["dist_km"], r["frac_route"], r["sched_hour"], r["day_offset"]) for r in out.collect()}
    assert got == {2: (9.5, 80.0, 80 / 90, 6.0, 1.0), 1: (9.5, 0.0, 0.0, -1.0, 0.0)}
