"""Queries for direct and one-change journeys."""

from pyspark.sql import functions as F

from wayframe.operators import journeys, stations as places, timetable
from wayframe.plans.search import dated
from wayframe.session import cut_lineage, cut_lineages

from .catalog import query
from .views import VIEWS, hav

GUARD = 3000.0  # neighbouring stations of these tables are far apart
HUB_MIN = 610

VIEWS["v_detour"] = f"""
SELECT train_number, seq, CASE WHEN plat IS NULL OR nlat IS NULL THEN 0.0
  ELSE {hav('plat', 'plng', 'lat', 'lng')} + {hav('lat', 'lng', 'nlat', 'nlng')} - {hav('plat', 'plng', 'nlat', 'nlng')} END AS detour_km
FROM (SELECT train_number, seq, lat, lng, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lead(lat) OVER w AS nlat, lead(lng) OVER w AS nlng
      FROM v_stops JOIN v_stations_raw ON station_code = code WINDOW w AS (PARTITION BY train_number ORDER BY seq))
"""
VIEWS["v_guarded"] = f"SELECT s.*, d.detour_km <= {GUARD} AS fine FROM v_stops s JOIN v_detour d USING (train_number, seq)"
VIEWS["v_trip"] = """
SELECT r.*, o.lat AS o_lat, o.lng AS o_lng, d.lat AS d_lat, d.lng AS d_lng FROM v_requests r JOIN v_places o ON o.id = r.request_id
JOIN v_places d ON d.id = (r.request_id * 7 + 3) % (SELECT count(*) FROM customer)
"""


def heads_sql(lat: str, lng: str, ladder: list[float]) -> str:
    """Railheads of every trip: six nearest inside the ladder and six nearest hubs."""
    tiers = " ".join(f"WHEN closest <= {r} THEN {r}" for r in ladder[1:])
    km = hav(f"t.{lat}", f"t.{lng}", "s.lat", "s.lng")
    return f"""
SELECT request_id, code, name, trains, km, lat, lng FROM (
  SELECT *, CASE WHEN any_hub = 1 OR closest <= {ladder[0]} THEN {ladder[0]} {tiers} END AS tier FROM (
    SELECT *, max(is_hub) OVER w AS any_hub, min(km) OVER w AS closest FROM (
      SELECT request_id, code, any_value(name) AS name, any_value(num_trains) AS trains, min(km) AS km, any_value(lat) AS lat, any_value(lng) AS lng, max(is_hub) AS is_hub FROM (
        (SELECT t.request_id, s.*, {km} AS km, 0 AS is_hub FROM v_trip t, v_stations s WHERE s.num_trains > 0 AND {km} <= {ladder[-1]}
         QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY km, code) <= 6)
        UNION ALL (SELECT t.request_id, s.*, {km}, 1 FROM v_trip t, v_stations s WHERE s.num_trains >= {HUB_MIN} AND {km} <= 500
         QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY {km}, code) <= 6)) GROUP BY 1, 2) WINDOW w AS (PARTITION BY request_id)))
WHERE is_hub = 1 OR km <= tier
"""


VIEWS["v_o_heads"] = heads_sql("o_lat", "o_lng", [200.0, 400.0, 600.0])
VIEWS["v_d_heads"] = heads_sql("d_lat", "d_lng", [60.0, 150.0])
VIEWS["v_rides"] = """
SELECT b.train_number AS train, b.station_code AS board, b.seq AS b_seq, coalesce(b.dep_min, b.arr_min) AS dep, b.day AS b_day, b.fine AS b_fine,
  a.station_code AS alight, a.seq AS a_seq, coalesce(a.arr_min, a.dep_min) AS arr, a.day AS a_day, a.fine AS a_fine,
  CAST((a.day - b.day) * 1440 + coalesce(a.arr_min, a.dep_min) - coalesce(b.dep_min, b.arr_min) AS INTEGER) AS minutes, t.days, t.months
FROM v_guarded b JOIN v_guarded a ON a.train_number = b.train_number AND a.seq > b.seq LEFT JOIN v_trains t ON t.number = b.train_number
WHERE (a.day - b.day) * 1440 + coalesce(a.arr_min, a.dep_min) - coalesce(b.dep_min, b.arr_min) > 0
"""
VIEWS["v_direct"] = """
SELECT t.request_id, r.train, r.board, r.b_seq, r.dep, r.b_day, r.alight, r.a_seq, r.arr, r.a_day, r.minutes, r.months, o.km AS b_km, d.km AS a_km
FROM v_trip t JOIN v_o_heads o ON o.request_id = t.request_id JOIN v_d_heads d ON d.request_id = t.request_id
JOIN v_rides r ON r.board = o.code AND r.alight = d.code
WHERE b_fine AND a_fine AND (t.day3 IS NULL OR r.days IS NULL OR list_contains(r.days, t.day3))
"""
VIEWS["v_hubs"] = f"SELECT code AS hub, num_trains AS hub_trains FROM v_stations WHERE num_trains >= {HUB_MIN + 10}"
VIEWS["v_first_legs"] = """
SELECT x.*, h.hub_trains FROM (
  SELECT t.request_id, r.alight AS hub, r.train AS t1, r.board, r.b_seq AS b1_seq, r.a_seq AS a1_seq, r.dep AS dep1, r.arr AS arr1, r.a_day AS arr1_day, r.minutes AS it1
  FROM v_trip t JOIN v_o_heads o ON o.request_id = t.request_id JOIN v_rides r ON r.board = o.code
  WHERE b_fine AND (t.day3 IS NULL OR r.days IS NULL OR list_contains(r.days, t.day3)) AND r.alight IN (SELECT hub FROM v_hubs)
  QUALIFY row_number() OVER (PARTITION BY t.request_id, r.alight ORDER BY r.minutes, r.train, r.board, r.b_seq, r.a_seq) = 1) x
JOIN v_hubs h USING (hub)
WHERE NOT EXISTS (SELECT 1 FROM v_o_heads o WHERE o.request_id = x.request_id AND o.code = x.hub)
  AND NOT EXISTS (SELECT 1 FROM v_d_heads d WHERE d.request_id = x.request_id AND d.code = x.hub)
QUALIFY row_number() OVER (PARTITION BY x.request_id ORDER BY h.hub_trains DESC, hub) <= 5
"""
VIEWS["v_met"] = """
SELECT request_id, hub, hub_trains, t1, board, b1_seq, a1_seq, dep1, arr1, arr1_day, it1, t2, b2_seq, a2_seq, alight, dep2, arr2, arr2_day, it2, wait, it1 + wait + it2 AS cost FROM (
  SELECT f.*, r.train AS t2, r.b_seq AS b2_seq, r.a_seq AS a2_seq, r.alight, r.dep AS dep2, r.arr AS arr2, r.a_day AS arr2_day, r.minutes AS it2,
    CAST(((r.dep - f.arr1) % 1440 + 1440) % 1440 AS INTEGER) AS wait, CASE WHEN s.p50 IS NULL THEN 30 ELSE CAST(greatest(30, least(90, round_even(s.p50, 0))) AS INTEGER) END AS min_buf
  FROM v_first_legs f JOIN v_trip t ON t.request_id = f.request_id JOIN v_d_heads d ON d.request_id = f.request_id
  JOIN v_rides r ON r.board = f.hub AND r.alight = d.code LEFT JOIN v_delay_stats s ON lpad(s.train_no, 7, '0') = f.t1
  WHERE a_fine AND r.train <> f.t1 AND (t.day3 IS NULL OR r.days IS NULL OR list_contains(r.days, t.day3)))
WHERE wait >= min_buf AND wait <= 360
QUALIFY row_number() OVER (PARTITION BY request_id, hub, t2, b2_seq ORDER BY a2_seq) = 1
"""
VIEWS["v_changes"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY cost, hub, alight, t1, t2) AS INTEGER) AS position FROM (
  SELECT * FROM v_met QUALIFY row_number() OVER (PARTITION BY request_id, board, hub, alight ORDER BY cost, t2, b2_seq, a2_seq) = 1)
QUALIFY position <= 8
"""


class Trips:
    """Requests with their points, railheads and the guarded timetable."""

    def __init__(self, net):
        self.net = net
        stops = net.stops()
        self.trains = net.trains()
        self.stations, self.stops = cut_lineages(
            timetable.with_train_counts(net.stations_raw(), stops), timetable.stop_detour(stops, net.stations_raw())
        )
        spot = net.places().select("id", "lat", "lng")
        o = spot.select(F.col("id").alias("request_id"), F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"))
        d = spot.select(F.col("id").alias("to_id"), F.col("lat").alias("d_lat"), F.col("lng").alias("d_lng"))
        total = net.table("customer").agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(1).alias("one"))
        rows = dated(net.requests(), F.lit("2025-01-01").cast("date")).withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
        rows = rows.withColumn("to_id", (F.col("request_id") * 7 + 3) % F.col("total")).drop("one", "total")
        self.requests = rows.join(o, "request_id").join(d, "to_id").drop("to_id")

    def heads(self, side: str):
        ladder = [200.0, 400.0, 600.0] if side == "o" else [60.0, 150.0]
        points = self.requests.select("request_id", F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lng").alias("lng"))
        heads = places.nearest_railheads(points, self.stations, ladder, hub_min=HUB_MIN)
        return cut_lineage(heads.drop("lat", "lng", "tier_km"))

    def p50(self):
        from wayframe.operators.delays import delay_stats

        stats = delay_stats(self.net.observations())
        return stats.select(F.lpad("train_no", 7, "0").alias("train_no"), "p50")


@query("SELECT request_id, code, round(km, 3) AS km, trains FROM v_o_heads")
def origin_railheads(net):
    return Trips(net).heads("o").select("request_id", "code", F.round("km", 3).alias("km"), "trains")


@query("SELECT request_id, train, board, b_seq, dep, b_day, alight, a_seq, arr, a_day, minutes FROM v_direct")
def direct_journeys(net):
    t = Trips(net)
    return journeys.direct(t.requests, t.heads("o"), t.heads("d"), t.stops, t.trains, guard_km=GUARD)


@query("SELECT request_id, train, board, b_seq, alight, a_seq, minutes FROM v_direct", name="direct_journeys_long_trains")
def direct_long(net):
    """The same journeys with every train cut into spans of two stops, as a very long one is into spans of many."""
    t = Trips(net)
    out = journeys.direct(t.requests, t.heads("o"), t.heads("d"), t.stops, t.trains, guard_km=GUARD, span=2)
    return out.select("request_id", "train", "board", "b_seq", "alight", "a_seq", "minutes")


@query("""
SELECT request_id, train, board, alight, b_seq, a_seq, minutes, round(b_km + a_km, 3) AS access_km FROM v_direct
QUALIFY row_number() OVER (PARTITION BY request_id, train ORDER BY b_km + a_km, minutes, board, alight, b_seq, a_seq) = 1
""")
def best_ride_per_train(net):
    t = Trips(net)
    o, d = t.heads("o"), t.heads("d")
    rides = journeys.direct(t.requests, o, d, t.stops, t.trains, guard_km=GUARD)
    b = o.select("request_id", F.col("code").alias("board"), F.col("km").alias("b_km"))
    a = d.select("request_id", F.col("code").alias("alight"), F.col("km").alias("a_km"))
    joined = rides.join(b, ["request_id", "board"]).join(a, ["request_id", "alight"])
    out = journeys.best_per_train(joined, F.col("b_km") + F.col("a_km"))
    return out.select("request_id", "train", "board", "alight", "b_seq", "a_seq", "minutes", F.round("access_km", 3).alias("access_km"))


@query("SELECT request_id, board, count(*) AS directs FROM v_direct GROUP BY 1, 2")
def directs_per_board(net):
    t = Trips(net)
    rides = journeys.direct(t.requests, t.heads("o"), t.heads("d"), t.stops, t.trains, guard_km=GUARD)
    return rides.groupBy("request_id", "board").agg(F.count(F.lit(1)).alias("directs"))


@query("SELECT request_id, hub, hub_trains, t1, board, b1_seq, a1_seq, dep1, arr1, arr1_day, it1 FROM v_first_legs")
def first_legs_to_hubs(net):
    t = Trips(net)
    hubs = t.stations.filter(F.col("num_trains") >= HUB_MIN + 10).select("code", "num_trains")
    return journeys.best_first_legs(t.requests, t.heads("o"), t.heads("d"), t.stops, t.trains, hubs, 5, GUARD)


@query("SELECT request_id, position, hub, board, alight, t1, t2, dep1, arr1, dep2, arr2, it1, it2, wait, cost FROM v_changes")
def one_change_journeys(net):
    t = Trips(net)
    out = journeys.one_change(
        t.requests, t.heads("o"), t.heads("d"), t.stops, t.trains, t.stations, t.p50(), HUB_MIN + 10, 5, guard_km=GUARD
    )
    return out.select("request_id", "position", "hub", "board", "alight", "t1", "t2", "dep1", "arr1", "dep2", "arr2", "it1", "it2", "wait", "cost")


@query("""
SELECT number, request_id, d.day3 IS NULL OR days IS NULL OR list_contains(days, d.day3) AS on_day,
  months IS NULL OR coalesce(list_contains(months, d.month), false) AS in_season
FROM v_trains JOIN v_requests d ON d.request_id = CAST(number AS BIGINT) % (SELECT count(*) FROM customer)
""")
def calendar_gates(net):
    total = net.table("customer").agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(1).alias("one"))
    trains = net.trains().withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    trains = trains.withColumn("request_id", F.col("number").cast("bigint") % F.col("total"))
    when = dated(net.requests(), F.lit("2025-01-01").cast("date")).select("request_id", "day3", "month")
    return trains.join(when, "request_id").select(
        "number", "request_id", journeys.runs_on(F.col("days"), F.col("day3")).alias("on_day"),
        journeys.runs_in_month(F.col("months"), F.col("month")).alias("in_season"),
    )


CUM = "SELECT train_number, station_code, arg_max(cum_km, seq) AS cum_km FROM v_stops GROUP BY 1, 2"


@query(f"""
SELECT train, board, alight, minutes, round(coalesce(nullif(abs(a.cum_km - b.cum_km), 0.0),
  {hav('s1.lat', 's1.lng', 's2.lat', 's2.lng')} * 1.25, minutes / 60 * 50), 3) AS rail_km
FROM (SELECT DISTINCT train, board, alight, minutes FROM v_rides) r
LEFT JOIN ({CUM}) b ON b.train_number = r.train AND b.station_code = r.board LEFT JOIN ({CUM}) a ON a.train_number = r.train AND a.station_code = r.alight
LEFT JOIN (SELECT * FROM v_stations_raw) s1 ON s1.code = r.board LEFT JOIN v_stations_raw s2 ON s2.code = r.alight
""")
def rail_distances(net):
    stops, s = net.stops(), net.stations_raw()
    codes = s.select("code")
    rides = cut_lineage(journeys.ride_pairs(stops, codes, codes, False, False).select("train", "board", "alight", "minutes").distinct())
    out = journeys.leg_km(rides, journeys.station_distances(stops), s, "train", "board", "alight", "minutes")
    return out.select("train", "board", "alight", "minutes", F.round("rail_km", 3).alias("rail_km"))


@query("""
SELECT train, b_seq, string_agg(name, '|' ORDER BY pos) AS names, CAST(count(*) AS INTEGER) AS points,
  CAST(sum(CASE WHEN prev IS NULL OR prev <> code THEN 1 ELSE 0 END) AS INTEGER) AS drawn FROM (
  SELECT f.train_number AS train, f.seq AS b_seq, s.seq AS pos, s.station_code AS code, x.name, lag(s.station_code) OVER (PARTITION BY f.train_number, f.seq ORDER BY s.seq) AS prev
  FROM v_stops f JOIN v_stops s ON s.train_number = f.train_number AND s.seq BETWEEN f.seq AND f.seq + 2 JOIN v_stations_raw x ON x.code = s.station_code) GROUP BY 1, 2
HAVING count(*) >= 2
""")
def leg_paths(net):
    stops = net.stops()
    legs = stops.select(F.col("train_number").alias("train"), F.col("seq").alias("b_seq"), (F.col("seq") + 2).alias("a_seq"))
    keys = ["train", "b_seq"]
    out = journeys.leg_paths(journeys.leg_points(legs, stops, keys), net.stations_raw(), keys)
    return out.filter(F.col("stops").isNotNull()).select(
        "train", "b_seq", F.array_join("stops", "|").alias("names"), F.size("stops").alias("points"),
        F.coalesce(F.size("coords"), F.lit(1)).alias("drawn"),
    )


@query("""
SELECT route_id, train, board, alight, b_seq, a_seq, minutes FROM (
  SELECT DISTINCT b.train_number || '-' || b.station_code || '-' || a.station_code AS route_id FROM v_stops b JOIN v_stops a ON a.train_number = b.train_number AND a.seq = b.seq + 1) i
JOIN v_rides r ON i.route_id = r.train || '-' || r.board || '-' || r.alight
QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY b_seq, a_seq) = 1
""")
def rebuilt_direct_routes(net):
    stops = net.stops()
    following = stops.select("train_number", (F.col("seq") - 1).alias("seq"), F.col("station_code").alias("alight"))
    ids = stops.join(following, ["train_number", "seq"]).select(
        F.concat_ws("-", "train_number", "station_code", "alight").alias("route_id")
    )
    numbers = ids.select(F.concat_ws("-", F.split_part("route_id", F.lit("-"), F.lit(1)), F.lit("S1"), F.lit("17")).alias("route_id"))
    out = journeys.rebuild_direct(ids.unionByName(numbers), stops)
    return out.select("route_id", "train", "board", "alight", "b_seq", "a_seq", "minutes")
