import json

import pytest
from pyspark.sql import functions as F

from wayframe.operators import timetable
from wayframe.plans import jobs
from wayframe.sources import files, sinks


def test_delay_dump_keeps_sightings_without_delay(spark, tmp_path):
    lines = ["date,station_no,station_name,delay,train_no", "2024-01-01,1,A,5.9,00123", "2024-01-02,1,A,None,123", "2024-01-03,1,A,,123",
             "2024-01-03,1,A,B,7,123", "2024-01-04,2,A,9999,123", "2024-01-05,x,A,-3,123", "2024-01-06,1,A,7, "]
    (tmp_path / "d.csv").write_text("\n".join(lines))
    from wayframe.operators.delays import clean_observations

    rows = clean_observations(files.read_delay_dump(spark, str(tmp_path / "d.csv"))).orderBy("obs_date").collect()
    assert [(r["train_no"], r["station_no"], r["delay_min"]) for r in rows] == [
        ("123", 1, 5), ("123", 1, None), ("123", 1, None), ("123", 2, None), ("123", None, -3)
    ]


def test_timetable_load_end_to_end(spark, tmp_path):
    fresh = spark.createDataFrame(
        [(" 101 ", "Night Mail", "NEW DELHI (arr=Source,dep=22:30) | Agra Cantt. (arr=01:10,dep=01:15) | junk | Bhopal (arr=8:05,dep=Destination)", "MON,TUE", "SL,3A", "700"),
         ("102", "One stop", "New Delhi (arr=Source,dep=10:00)", "MON", "SL", "x")],
        "train_no string, train_name string, intermediate_stops string, days_of_week string, classes string, distance string",
    )
    cell = "[{'stationCode': 'ndls', 'stationName': 'NEW DELHI', 'arrivalTime': '--', 'departureTime': '10:00', 'dayCount': '1', 'distance': '0'}, " \
           "{'stationCode': 'PRYJ', 'stationName': 'PRAYAGRAJ', 'arrivalTime': '18:00', 'departureTime': None, 'dayCount': '1', 'distance': '600'}]"
    flags = ", ".join(f"trainRunsOn{d} string" for d in ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"])
    listed = spark.createDataFrame(
        # a broken list and a list of one stop give no train, but the one stop's name counts, after those of earlier lines
        [("203", "One", "[{'stationCode': 'XX', 'stationName': 'PRAYAGRAJ', 'dayCount': '1', 'distance': '0'}]", "Y", "N", "N", "N", "N", "N", "N"),
         ("201", "Day Exp", cell, "Y", "N", "N", "N", "N", "N", "Y"), ("101", "Night Mail", cell, "Y", "Y", "Y", "Y", "Y", "Y", "Y"), ("202", "Bad", "[{", "Y", "N", "N", "N", "N", "N", "N")],
        f"trainNumber string, trainName string, stationList string, {flags}",
    )
    stations = spark.createDataFrame(
        [("NDLS", "NEW DELHI", 28.6, 77.2), ("AGC", "AGRA CANTT", 27.2, 78.0), ("BPL", "BHOPAL JN", 23.3, 77.4), ("ALD", "ALLAHABAD", 25.4, 81.8)],
        "code string, name string, lat double, lng double",
    )
    out = str(tmp_path / "net")
    load = jobs.load_timetable(fresh, listed, stations, "fresh", "older", out)
    stops = {(r["train_number"], r["seq"]): (r["station_code"], r["day"], r["source"]) for r in load.stops.collect()}
    assert stops[("101", 1)] == ("NDLS", 1, "fresh") and stops[("101", 2)] == ("AGC", 2, "fresh") and stops[("101", 3)] == ("BPL", 2, "fresh")
    assert stops[("201", 2)] == ("ALD", 1, "older") and len(stops) == 5
    trains = {r["number"]: (r["source"], r["days_of_week"], r["num_stops"], r["distance_km"]) for r in load.trains.collect()}
    assert trains["101"][:3] == ("fresh", "MON,TUE", 3) and trains["201"] == ("older", "MON,SUN", 2, 600.0) and len(trains) == 2
    counted = {r["code"]: r["num_trains"] for r in files.read_table(spark, f"{out}/stations").collect()}
    assert counted == {"NDLS": 2, "AGC": 1, "BPL": 1, "ALD": 1}
    assert load.report.first()["unmatched"] == 0


def test_dry_run_writes_nothing(spark, tmp_path):
    df = spark.range(3).withColumn("train_number", F.lit("1"))
    sinks.overwrite_table(df, str(tmp_path / "t"), write=False)
    assert not (tmp_path / "t").exists()
    sinks.overwrite_table(df, str(tmp_path / "t"), ["train_number"])
    sinks.append_table(df, str(tmp_path / "t2"))
    sinks.append_table(df, str(tmp_path / "t2"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3 and spark.read.parquet(str(tmp_path / "t2")).count() == 6


def test_extra_schedule(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "station_no,station_name,distance_from_origin,arrival_day,arrival_time,departure_day,departure_time,train_no\n"
        "1,aa,0,1,,1,10:00,0301\nx,bb,50,1,11:00,1,11:05,0301\n3,zz,80,1,12:00,1,12:05,0301\n4,cc,90,2,00:10,2,,0301\n1,aa,0,1,,1,9:00,101\n2,bb,5,1,9:30,1,,101\n"
    )
    (tmp_path / "t.csv").write_text("train_no,train_name,type_code\n0301,Hill Exp,EXP-2\n")
    (tmp_path / "n.csv").write_text("station_name,station_full_name\naa,Alpha\n")
    schedule = files.read_coded_schedule(spark, str(tmp_path / "s.csv"))
    known = spark.createDataFrame([("101", "Old")], "number string, name string")
    stations = spark.createDataFrame(
        [("AA", 1.0, 1.0, 0), ("BB", 1.0, 2.0, 0), ("CC", 1.0, 3.0, 0), ("ZZ", None, None, 7)], "code string, lat double, lng double, num_trains int")
    old = spark.createDataFrame([(40, "101", "AA", 1)], "id bigint, train_number string, station_code string, seq int")
    load = jobs.load_extra_schedule(
        schedule, files.read_train_types(spark, str(tmp_path / "t.csv")), files.read_station_names(spark, str(tmp_path / "n.csv")), known, old, stations,
        out=str(tmp_path / "net"),
    )
    maps = load.maps
    assert {r["number"] for r in load.trains.collect()} == {"101", "301"} and load.stops.count() == 4
    counted = {r["code"]: r["num_trains"] for r in files.read_table(spark, str(tmp_path / "net" / "stations")).collect()}
    assert counted == {"AA": 2, "BB": 1, "CC": 1, "ZZ": 7}
    t = load.trains.filter("number = '301'").collect()
    stops = load.stops.filter("train_number = '301'")
    assert [(r["number"], r["name"], r["num_stops"], r["classes"], r["distance_km"]) for r in t] == [("301", "Hill Exp", 3, "2S,SL,3A,2A", 90.0)]
    rows = stops.orderBy("seq").collect()
    assert [(r["station_code"], r["station_name"], r["seq"], r["day"]) for r in rows] == [("AA", "Alpha", 1, 1), ("BB", "BB", 2, 1), ("CC", "CC", 3, 2)]
    assert sorted(r["id"] for r in rows) == [41, 42, 43]
    by_train = {r["train_number"]: r["stations"] for r in maps.collect()}
    assert by_train["301"] == {"AA": 0.0, "BB": 50.0, "ZZ": 80.0, "CC": 90.0} and len(by_train) == 2


def test_side_files(spark, tmp_path):
    (tmp_path / "cal.json").write_text(json.dumps({"_meta": "text", "2026-01-26": {"name": "R", "kind": "holiday"}}, indent=1))
    cal = files.read_calendar_json(spark, str(tmp_path / "cal.json")).collect()
    assert [(str(r["d"]), r["name"], r["kind"]) for r in cal] == [("2026-01-26", "R", "holiday")]
    (tmp_path / "fare.json").write_text(json.dumps({"class": {"SL": [[10.0, 50], [20.0, 80]]}, "fit": {"SL": {"rate": 0.5, "base": 60.0}}}))
    knots, fits = files.read_fare_json(spark, str(tmp_path / "fare.json"))
    assert knots.count() == 2 and fits.first()["rate"] == 0.5
    (tmp_path / "cum.json").write_text(json.dumps({"1": {"A": 0, "B": 12.5}}))
    assert {r["station_code"]: r["cum_km"] for r in files.read_distance_json(spark, str(tmp_path / "cum.json")).collect()} == {"A": 0.0, "B": 12.5}
    lines = files.read_distance_json(spark, str(tmp_path / "cum.json"))
    sinks.write_json(sinks.distance_maps(lines), str(tmp_path / "maps"))
    assert {tuple(r) for r in files.read_distance_lines(spark, str(tmp_path / "maps")).collect()} == {tuple(r) for r in lines.collect()}
    assert files.read_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "st.json").write_text(json.dumps({"features": [
        {"geometry": {"coordinates": [77.2, 28.6]}, "properties": {"code": "NDLS", "name": "New Delhi", "state": "Delhi"}},
        {"geometry": None, "properties": {"code": "X", "name": "Nowhere"}}]}))
    st = {r["code"]: (r["lat"], r["lng"]) for r in files.read_station_geojson(spark, str(tmp_path / "st.json")).collect()}
    assert st == {"NDLS": (28.6, 77.2), "X": (None, None)}
    (tmp_path / "IN.txt").write_text("\t".join(["1", "Pune", "Pune", "", "18.5", "73.8", "P", "PPL", "IN", "", "16", "", "", "", "3000000", "", "", "", ""]))
    city = files.read_gazetteer(spark, str(tmp_path / "IN.txt")).first()
    assert (city["name"], city["admin1"], city["population"], city["lat"]) == ("Pune", "16", 3000000, 18.5)


def test_fare_load_and_quotes_file(spark, tmp_path):
    rows = ["totalFare,distance,classCode"] + [f"{100 + km * 0.5 + (km * 7) % 13},{km},SL" for km in range(10, 500, 5)] + ["x,10,SL", "50,5000,SL", "10,10,"]
    (tmp_path / "p.csv").write_text("\n".join(rows))
    knots, fits = jobs.load_fares(files.read_fare_quotes(spark, str(tmp_path / "p.csv")), str(tmp_path))
    fares = [r["fare"] for r in knots.orderBy("km", "fare").collect()]
    assert fares == sorted(fares) and fits.first()["rate"] == pytest.approx(0.5, abs=0.02)
    saved = spark.read.json(str(tmp_path / "fare_table")).first()
    assert saved["class_code"] == "SL" and len(saved["points"]) == len(fares)


def test_optional_columns_and_partitioned_read(spark, tmp_path):
    spark.createDataFrame([("1",)], "number string").write.parquet(str(tmp_path / "t"))
    df = files.read_table(spark, str(tmp_path / "t"), {"operating_months": "string"})
    assert df.columns == ["number", "operating_months"] and df.first()["operating_months"] is None


def test_ids_go_on_after_the_largest(spark):
    new = spark.range(500).select(F.col("id").cast("string").alias("k"))
    ids = [r["id"] for r in timetable.append_with_ids(spark.range(10), new, ["k"]).select("id").collect()]
    assert sorted(ids) == list(range(10, 510))
