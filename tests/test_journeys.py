"""Journeys on a small random network against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from wayframe.operators import journeys

DAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]


@pytest.fixture(scope="module")
def network():
    rng = random.Random(3)
    stops, trains = [], {}
    for t in range(60):
        number = f"{t:05d}"
        trains[number] = rng.choice([None, rng.sample(DAYS, 3)])
        clock = rng.randrange(1440)
        # trains may call twice at one station; one train is far longer than the others
        codes = [f"S{rng.randrange(14)}" for _ in range(40 if t == 0 else rng.randrange(2, 8))]
        for i, code in enumerate(codes):
            arr = clock
            clock += rng.choice([2, 5])
            dep = clock
            stops.append((number, code, i + 1, None if i == 0 else arr % 1440, None if i == len(codes) - 1 else dep % 1440, dep // 1440 + 1, rng.choice([0.0, 0.0, 0.0, 500.0])))
            clock += rng.randrange(20, 400)
    requests = []
    for r in range(25):
        o, d = rng.sample(range(14), 3), rng.sample(range(14), 3)
        d = [x for x in d if x not in o]
        requests.append((r, rng.choice([None, *DAYS]), [f"S{x}" for x in o], [f"S{x}" for x in d]))
    return stops, trains, requests


@pytest.fixture(scope="module")
def frames(spark, network):
    stops, trains, requests = network
    s = spark.createDataFrame(stops, "train_number string, station_code string, seq int, arr_min int, dep_min int, day int, detour_km double")
    t = spark.createDataFrame(list(trains.items()), "number string, days array<string>")
    r = spark.createDataFrame([(q[0], q[1]) for q in requests], "request_id int, day3 string")
    o = spark.createDataFrame([(q[0], c) for q in requests for c in q[2]], "request_id int, code string")
    d = spark.createDataFrame([(q[0], c) for q in requests for c in q[3]], "request_id int, code string")
    counts = s.groupBy("station_code").agg(F.count_distinct("train_number").cast("int").alias("num_trains"))
    return r, o, d, s, t, counts.withColumnRenamed("station_code", "code")


def rides_of(stops):
    by_train = {}
    for x in stops:
        by_train.setdefault(x[0], []).append(x)
    for train, rows in by_train.items():
        for i, b in enumerate(rows):
            dep = b[4] if b[4] is not None else b[3]
            for a in rows[i + 1:]:
                arr = a[3] if a[3] is not None else a[4]
                if dep is None or arr is None:
                    continue
                minutes = (a[5] - b[5]) * 1440 + arr - dep
                if minutes > 0:
                    yield train, b, a, dep, arr, minutes


def runs(trains, train, day):
    return day is None or trains[train] is None or day in trains[train]


@pytest.mark.parametrize("span", [1, 3, 512])
def test_direct_rides(frames, network, span):
    stops, trains, requests = network
    r, o, d, s, t, _ = frames
    got = {tuple(x) for x in journeys.direct(r, o, d, s, t, span=span).select("request_id", "train", "b_seq", "a_seq", "minutes").collect()}
    want = {
        (q[0], train, b[2], a[2], m) for q in requests for train, b, a, _, _, m in rides_of(stops)
        if b[1] in q[2] and a[1] in q[3] and b[6] <= 150 and a[6] <= 150 and runs(trains, train, q[1])
    }
    assert got == want and want


def test_one_change(frames, network):
    stops, trains, requests = network
    r, o, d, s, t, stations = frames
    counts = {x["code"]: x["num_trains"] for x in stations.collect()}
    floor = sorted(counts.values())[5]
    hubs = {c for c, n in counts.items() if n >= floor}
    typical = {f"{i:05d}": float(i) for i in range(0, 60, 3)}
    p50 = r.sparkSession.createDataFrame(list(typical.items()), "train_no string, p50 double")
    out = journeys.one_change(r, o, d, s, t, stations, p50, hub_min=floor, top_hubs=4, k=3)
    got = {}
    for x in out.collect():
        got.setdefault(x["request_id"], []).append((x["position"], x["cost"], x["hub"], x["board"], x["alight"], x["t1"], x["t2"]))
    rides = list(rides_of(stops))
    for q in requests:
        reached = {}
        for train, b, a, dep, arr, m in rides:
            if b[1] in q[2] and b[6] <= 150 and a[1] in hubs and a[1] not in q[2] and a[1] not in q[3] and runs(trains, train, q[1]):
                key = (m, train, b[1], b[2], a[2])
                if a[1] not in reached or key < reached[a[1]][0]:
                    reached[a[1]] = (key, arr)
        best = {}
        for hub in sorted(reached, key=lambda h: (-counts[h], h))[:4]:
            (m1, t1, board, _, _), arr1 = reached[hub]
            buffer = max(30, min(round(typical[t1]), 90)) if t1 in typical else 30
            first = {}
            for t2, b, a, dep, _, m2 in rides:
                if b[1] != hub or t2 == t1 or a[1] not in q[3] or a[6] > 150 or not runs(trains, t2, q[1]):
                    continue
                wait = (dep - arr1) % 1440
                if buffer <= wait <= 360 and ((t2, b[2]) not in first or a[2] < first[(t2, b[2])][0]):
                    first[(t2, b[2])] = (a[2], a[1], m1 + wait + m2)
            for (t2, b2), (a2, alight, cost) in first.items():
                key = (board, hub, alight)
                if key not in best or (cost, t2, b2, a2) < best[key][0]:
                    best[key] = ((cost, t2, b2, a2), t1)
        rows = sorted((v[0][0], k[1], k[2], v[1], v[0][1], k[0]) for k, v in best.items())[:3]
        want = [(i + 1, c, hub, board, alight, t1, t2) for i, (c, hub, alight, t1, t2, board) in enumerate(rows)]
        assert sorted(got.get(q[0], [])) == want


def test_arrivals_meet_few_departures_outside_their_wait(spark):
    """A busy pair of stations: what is joined is near what is found, over midnight too."""
    legs = [(r, "H", "A", f"f{r}", (r * 97) % 1440, 30 + r % 60) for r in range(200)]
    wanted = spark.createDataFrame(legs, "request_id int, hub string, alight string, t1 string, arr1 int, min_buf int")
    trains = [("H", "A", f"t{i}", (i * 7) % 1440) for i in range(800)]
    second = spark.createDataFrame(trains, "hub string, alight string, t2 string, dep2 int")
    want = {(r, t, (dep - arr) % 1440) for r, _, _, _, arr, buf in legs for _, _, t, dep in trains if buf <= (dep - arr) % 1440 <= 360}
    for bucket in (60, 240, 1440):
        got = journeys._met(wanted, second, 360, bucket).select("request_id", "t2", "wait").collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    # departures in the buckets of an arrival's wait: those in the wait and at most two buckets more
    spread = journeys._spread(wanted, 360, 60)
    met = spread.join(second.withColumn("__bucket", F.floor(F.col("dep2") / 60).cast("int")), ["hub", "alight", "__bucket"]).count()
    assert met <= len(want) * (330 + 120) / 300 and met < 200 * 800 / 3
    assert journeys._met(wanted.withColumn("min_buf", F.lit(500)), second, 360).count() == 0
    assert journeys._met(wanted, second, 5000).count() == sum(1 for r in legs for t in trains if (t[3] - r[4]) % 1440 >= r[5])


def test_seasonal_trains_hide_without_a_date(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (None, [1]), (3, [1]), (None, None)], "month int, months array<int>")
    got = [r["ok"] for r in rows.select(journeys.runs_in_month(F.col("months"), F.col("month")).alias("ok")).collect()]
    assert got == [True, False, False, True]


def test_route_ids(one):
    got = one(a=journeys.parse_direct_id(F.lit("101-NDLS-BPL")), b=journeys.parse_direct_id(F.lit("101-NDLS-102")), c=journeys.parse_direct_id(F.lit("road-a-b")))
    assert tuple(got["a"]) == ("101", "NDLS", "BPL") and got["b"] is None and got["c"] is None


def test_hubs_of_a_board_are_cut_before_their_rides(spark):
    """Of each board and day only the busiest hubs stay, before any ride to them is kept."""
    rng = random.Random(11)
    rides = [(f"B{rng.randrange(6)}", f"H{rng.randrange(30)}", rng.randrange(1, 256)) for _ in range(400)]
    hubs = [(f"H{h}", 100 + h % 7) for h in range(28)]
    limit = spark.createDataFrame([(4, 1)], "__limit int, __one int")
    out = journeys._reached_hubs(
        spark.createDataFrame(rides, "board string, alight string, on int"), spark.createDataFrame(hubs, "hub string, hub_trains int"), limit).collect()
    trains, want = dict(hubs), {}
    for day in range(8):
        for board in {b for b, _, _ in rides}:
            reached = {h for b, h, on in rides if b == board and on >> day & 1 and h in trains}
            for h in sorted(reached, key=lambda h: (-trains[h], h))[:4]:
                want[board, h] = want.get((board, h), 0) | 1 << day
    assert {(r["board"], r["hub"]): r["kept"] for r in out} == want


def test_requests_meet_rides_on_one_number(spark, frames):
    """Pairs of railheads carry one number and no codes; equal railheads of a request count as often as they are given."""
    r, o, d, s, t, _ = frames
    rides = journeys.direct(r, o, d, s, t)
    assert "__both" in rides._jdf.queryExecution().optimizedPlan().toString()
    twice = journeys.direct(r, o.unionByName(o), d, s, t)
    assert twice.count() == 2 * rides.count() > 0
    numbers = [x["no"] for x in journeys._numbers(o.select("code")).collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))


def test_ids_are_read_once_for_both_ends(spark, frames):
    """The parsed ids are written, not parsed again for each end; repeated and foreign ids change nothing."""
    s = frames[3]
    first = s.filter("seq = 1").join(s.filter("seq = 2").select("train_number", F.col("station_code").alias("to")), "train_number")
    ids = first.select(F.concat_ws("-", "train_number", "station_code", "to").alias("route_id"))
    got = journeys.rebuild_direct(ids.unionByName(ids).unionByName(spark.createDataFrame([("x-y-z",), (None,)], "route_id string")), s, 1e9)
    assert "split" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(x["route_id"] for x in got.collect()) == sorted({x["route_id"] for x in ids.collect()})


def test_distances_of_a_train_go_to_its_legs_as_one_row(spark):
    """Both ends of a leg are found by one join, with the rows that a join per end gives: none, one, or one for each repeat."""
    known = [("1", "A", 1.0), ("1", "B", 4.5), ("1", "C", None), ("2", "A", 2.0), ("2", "A", 3.0), ("2", "B", 9.0), (None, "A", 1.0), ("3", None, 1.0)]
    legs = [(t, s, e, i) for i, (t, s, e) in enumerate((t, s, e) for t in ("1", "2", "3", "4", None) for s in ("A", "C", "X", None) for e in ("A", "B"))]
    cum = spark.createDataFrame(known, "train_number string, station_code string, cum_km double")
    rows = spark.createDataFrame(legs, "train string, start string, end string, i int")
    one = journeys._with_cum_km(rows, cum, "train", "start", "end")
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    two = journeys._with_cum_km(rows, cum, "train", "start", "end", limit=1)
    assert two._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    got, want = (sorted(map(tuple, df.select("i", "train", "start", "end", "__c1", "__c2").collect()), key=str) for df in (one, two))
    assert got == want and len(got) > len(legs)


def test_ids_are_not_sent_with_both_ends(spark, frames):
    """Boardings carry the id to its alightings: one join, and no route id in it."""
    ids = spark.createDataFrame([("00001-S1-S2",), ("00002-S3-S4",)], "route_id string")
    plan = journeys.rebuild_direct(ids, frames[3], 1e9)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("route_id") == 1


def test_journeys_of_a_request_are_sought_in_place(frames):
    """Rides to hubs and met departures are sent by request once, not again by request and hub."""
    import re

    r, o, d, s, t, stations = frames
    hubs = stations.filter("num_trains > 1").select("code", "num_trains")
    legs = journeys.best_first_legs(r, o, d, s, t, hubs, 4)
    changes = journeys.one_change(r, o, d, s, t, stations, hub_min=1, top_hubs=4, k=3)
    for df in (legs, changes):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(request_id" in plan
        assert not re.search(r"hashpartitioning\(request_id#\d+L?, (hub|board)", plan)
