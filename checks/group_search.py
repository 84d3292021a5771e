"""The whole trip search, the batch jobs, the delay model and the streams."""

from pyspark.sql import functions as F

from wayframe import fixed
from wayframe.operators import delays, fares, journeys, model, timetable
from wayframe.operators import ranking
from wayframe.plans import jobs
from wayframe.plans.search import Settings, Tables, TripSearch
from wayframe.session import cut_lineage, cut_lineages, scratch_folder
from wayframe.sources.files import calendar_table

from .catalog import query
from .group_journeys import CUM, GUARD, HUB_MIN, heads_sql
from .group_scores import TIER
from .group_routes import ROAD_FARE, ROAD_MIN
from .views import VIEWS, hav, rnd

AS_OF = "2025-01-01"

VIEWS["v_strip"] = """
SELECT r.*, o.name AS o_name, o.lat AS o_lat, o.lng AS o_lng, d.name AS d_name, d.lat AS d_lat, d.lng AS d_lng,
  CASE WHEN r.day IS NOT NULL THEN CAST(date_diff('day', DATE '2025-01-01', r.day) AS INTEGER) END AS days_out
FROM v_requests r JOIN v_geocoded o ON o.place = r.from_place JOIN v_geocoded d ON d.place = r.to_place
"""
VIEWS["v_so_heads"] = heads_sql("o_lat", "o_lng", [200.0, 400.0, 600.0]).replace("v_trip", "v_strip")
VIEWS["v_sd_heads"] = heads_sql("d_lat", "d_lng", [60.0, 150.0]).replace("v_trip", "v_strip")


def on_search(sql: str) -> str:
    for old, new in (("v_trip", "v_strip"), ("v_o_heads", "v_so_heads"), ("v_d_heads", "v_sd_heads"), ("v_first_legs", "v_sfirst"), ("v_met", "v_smet")):
        sql = sql.replace(old, new)
    return sql


VIEWS["v_sdirect"] = on_search(VIEWS["v_direct"])
VIEWS["v_sfirst"] = on_search(VIEWS["v_first_legs"])
VIEWS["v_smet"] = on_search(VIEWS["v_met"])
VIEWS["v_schanges"] = on_search(VIEWS["v_changes"])
USEFUL = f"""({hav('a.lat', 'a.lng', 't.d_lat', 't.d_lng')} < {hav('b.lat', 'b.lng', 't.d_lat', 't.d_lng')} - 5
  AND {hav('a.lat', 'a.lng', 't.o_lat', 't.o_lng')} > {hav('b.lat', 'b.lng', 't.o_lat', 't.o_lng')} - 5)"""


def in_season(months: str) -> str:
    return f"({months} IS NULL OR coalesce(list_contains({months}, t.month), false))"


VIEWS["v_sdir"] = f"""
SELECT x.* FROM v_sdirect x JOIN v_strip t USING (request_id) JOIN v_stations a ON a.code = x.alight JOIN v_stations b ON b.code = x.board
WHERE {USEFUL} AND {in_season('x.months')}
QUALIFY row_number() OVER (PARTITION BY x.request_id, x.train ORDER BY b_km + a_km, minutes, board, alight, b_seq, a_seq) = 1
"""
VIEWS["v_schg"] = f"""
SELECT x.*, o.km AS b_km, d.km AS a_km FROM v_schanges x JOIN v_strip t USING (request_id)
JOIN v_so_heads o ON o.request_id = x.request_id AND o.code = x.board JOIN v_sd_heads d ON d.request_id = x.request_id AND d.code = x.alight
JOIN v_stations a ON a.code = x.alight JOIN v_stations b ON b.code = x.board JOIN v_trains m1 ON m1.number = x.t1 JOIN v_trains m2 ON m2.number = x.t2
WHERE {USEFUL} AND {in_season('m1.months')} AND {in_season('m2.months')}
  AND x.request_id NOT IN (SELECT request_id FROM v_sdir GROUP BY 1 HAVING count(*) >= 3)
"""
VIEWS["v_sroutes"] = """
SELECT request_id, train || '-' || board || '-' || alight AS route_key, train || '-' || board || '-' || alight AS shown_id, board, alight, b_km, a_km,
  0 AS transfers, NULL AS wait, NULL AS change_at, NULL AS hub_trains FROM v_sdir
UNION ALL SELECT request_id, t1 || '-' || hub || '-' || t2 || '>' || alight || '#' || CAST(b2_seq AS VARCHAR), t1 || '-' || hub || '-' || t2, board, alight, b_km, a_km,
  1, wait, hub, hub_trains FROM v_schg
"""
VIEWS["v_slegs"] = """
SELECT request_id, train || '-' || board || '-' || alight AS route_key, 1 AS leg_no, train, board AS start, alight AS stop, dep, arr, minutes, a_seq - b_seq - 1 AS halts FROM v_sdir
UNION ALL SELECT request_id, t1 || '-' || hub || '-' || t2 || '>' || alight || '#' || CAST(b2_seq AS VARCHAR), 1, t1, board, hub, dep1, arr1, it1, a1_seq - b1_seq - 1 FROM v_schg
UNION ALL SELECT request_id, t1 || '-' || hub || '-' || t2 || '>' || alight || '#' || CAST(b2_seq AS VARCHAR), 2, t2, hub, alight, dep2, arr2, it2, a2_seq - b2_seq - 1 FROM v_schg
"""
VIEWS["v_skm"] = f"""
SELECT l.*, t.name AS train_name, {TIER.format(name='t.name', no='l.train')} AS tier,
  coalesce(nullif(abs(a.cum_km - b.cum_km), 0.0), {hav('s1.lat', 's1.lng', 's2.lat', 's2.lng')} * 1.25, l.minutes / 60 * 50) AS km,
  CASE WHEN t.kind IN ('RAJDHANI', 'SHATABDI') AND len(kept) > 0 THEN kept ELSE t.classes END AS offered
FROM v_slegs l JOIN (SELECT *, list_filter(classes, lambda c: CASE kind WHEN 'SHATABDI' THEN c IN ('CC', 'EC', '2S', 'EA', 'EV') ELSE c IN ('1A', '2A', '3A', '3E', 'EA') END) AS kept
                     FROM v_trains) t ON t.number = l.train
LEFT JOIN ({CUM}) b ON b.train_number = l.train AND b.station_code = l.start LEFT JOIN ({CUM}) a ON a.train_number = l.train AND a.station_code = l.stop
LEFT JOIN v_stations_raw s1 ON s1.code = l.start LEFT JOIN v_stations_raw s2 ON s2.code = l.stop
"""
VIEWS["v_sprofile"] = f"""
SELECT *, CASE WHEN measured THEN {rnd('on_time_pct')} ELSE {rnd('100 * (1 - exp(-30 / greatest(6.0, avg_mins)))')} END AS on_time FROM (
  SELECT k.*, s.train_no IS NOT NULL AS measured, s.on_time_pct, s.p90, CASE WHEN s.train_no IS NOT NULL THEN {rnd('s.avg_delay')}
    ELSE {rnd("CASE tier WHEN 'premium' THEN 10 WHEN 'superfast' THEN 22 WHEN 'express' THEN 33 ELSE 48 END + 8.0 * km / 1000 + 0.35 * greatest(0, halts)")} END AS avg_mins
  FROM v_skm k LEFT JOIN v_delay_stats s ON lpad(s.train_no, 7, '0') = k.train)
"""
VIEWS["v_sscore"] = "SELECT request_id, CAST(score AS INTEGER) AS score FROM (SELECT t.request_id, coalesce(max(d.score), 0) AS score FROM v_strip t LEFT JOIN (SELECT DISTINCT day, score FROM v_demand) d ON d.day = t.day GROUP BY 1)"
VIEWS["v_spoints"] = "SELECT class_code, km, round_even(fare, 0) AS f, lead(km) OVER w AS x1, lead(round_even(fare, 0)) OVER w AS f1 FROM v_curve_points WINDOW w AS (PARTITION BY class_code ORDER BY km)"
VIEWS["v_sends"] = "SELECT class_code, min(km) AS k0, max(km) AS k1, min(f) AS f0, max(f) AS f9 FROM v_spoints GROUP BY 1"
VIEWS["v_sfares"] = """
SELECT request_id, route_key, leg_no, min(CAST(greatest(60, round_even(CASE WHEN real IS NOT NULL THEN real * CASE WHEN tier = 'premium' THEN 1.12 ELSE 1.0 END * mult
    ELSE (km * CASE c WHEN 'SL' THEN 0.58 WHEN '3A' THEN 1.48 WHEN '2A' THEN 2.10 WHEN '1A' THEN 3.57 WHEN 'CC' THEN 1.58 ELSE 0.45 END
      + CASE c WHEN '2S' THEN 15 WHEN 'SL' THEN 20 WHEN '3A' THEN 40 WHEN 'CC' THEN 40 WHEN '2A' THEN 50 ELSE 60 END
      + CASE WHEN tier IN ('premium', 'superfast') THEN CASE c WHEN '2S' THEN 15 WHEN 'SL' THEN 30 WHEN '1A' THEN 75 ELSE 45 END ELSE 0 END)
      * CASE WHEN c IN ('1A', '2A', '3A', 'CC') THEN 1.05 ELSE 1.0 END * mult END, 0)) AS INTEGER)) AS fare FROM (
  SELECT x.*, CASE WHEN e.class_code IS NULL THEN NULL WHEN x.km <= k0 THEN f0 WHEN x.km >= k1 THEN greatest(f9, round_even(rate * x.km + base, 0))
      ELSE round_even(p.f + (x.km - p.km) / (p.x1 - p.km) * (p.f1 - p.f), 0) END AS real
  FROM (SELECT l.request_id, l.route_key, l.leg_no, l.tier, l.km, CASE WHEN l.tier = 'premium' THEN round_even(least(1.4, 1 + 0.4 * s.score / 100), 3) ELSE 1.0 END AS mult,
          unnest(CASE WHEN len(list_intersect(offered, ['2S', 'SL', 'CC', '3A', '2A', '1A'])) = 0 THEN ['SL'] ELSE list_intersect(offered, ['2S', 'SL', 'CC', '3A', '2A', '1A']) END) AS c
        FROM v_skm l JOIN v_sscore s USING (request_id)) x
  LEFT JOIN v_sends e ON e.class_code = c LEFT JOIN v_fits f ON f.class_code = c LEFT JOIN v_spoints p ON p.class_code = c AND x.km >= p.km AND x.km < p.x1)
GROUP BY 1, 2, 3
"""
EASE = "list_max(list_transform(classes, lambda c: CASE c WHEN '2S' THEN 84 WHEN 'SL' THEN 74 WHEN 'CC' THEN 72 WHEN '3A' THEN 66 WHEN '2A' THEN 58 WHEN '1A' THEN 54 ELSE 68 END))"
VIEWS["v_srail0"] = f"""
SELECT r.*, t.pref, t.from_place, t.to_place, t.days_out, t.month, b_km * 1.3 AS first_km, a_km * 1.3 AS last_km, p1.train AS first_train, p1.dep AS dep_min,
  p1.minutes + coalesce(p2.minutes, 0) AS rail_minutes, f1.fare + coalesce(f2.fare, 0) AS rail_fare, least(p1.on_time, p2.on_time) AS on_time,
  CASE WHEN transfers = 1 THEN CAST(greatest(35, least(98, round_even(100 * (1 - exp(-wait / greatest(6.0, p1.avg_mins))), 0))) AS INTEGER) END AS safety,
  CASE WHEN p1.tier = 'premium' OR p2.tier = 'premium' THEN 'premium' WHEN p1.tier = 'superfast' OR p2.tier = 'superfast' THEN 'superfast'
       WHEN p1.tier = 'express' OR p2.tier = 'express' THEN 'express' ELSE 'passenger' END AS tier, list_distinct(p1.offered || coalesce(p2.offered, [])) AS classes
FROM v_sroutes r JOIN v_strip t USING (request_id) JOIN v_sprofile p1 ON p1.request_id = r.request_id AND p1.route_key = r.route_key AND p1.leg_no = 1
JOIN v_sfares f1 ON f1.request_id = r.request_id AND f1.route_key = r.route_key AND f1.leg_no = 1
LEFT JOIN v_sprofile p2 ON p2.request_id = r.request_id AND p2.route_key = r.route_key AND p2.leg_no = 2
LEFT JOIN v_sfares f2 ON f2.request_id = r.request_id AND f2.route_key = r.route_key AND f2.leg_no = 2
"""
VIEWS["v_srail1"] = f"""
SELECT *, CAST(greatest(20, least(96, round_even({EASE} + CASE tier WHEN 'premium' THEN -12 WHEN 'superfast' THEN -4 WHEN 'express' THEN 0 ELSE 8 END
    + CASE WHEN days_out IS NULL THEN 8.0 ELSE least(16.0, greatest(-6.0, days_out * 0.5)) END + CASE WHEN coalesce(month IN (5, 6, 10, 11, 12), false) THEN -12 ELSE 0 END, 0))) AS INTEGER) AS confirmation_pct
FROM v_srail0
"""
VIEWS["v_sall"] = f"""
SELECT request_id, route_key AS route_id, shown_id, pref, CASE WHEN transfers = 1 OR first_km > 20 THEN 'cross-origin' ELSE 'direct' END AS route_type,
  CAST(rail_minutes + coalesce(wait, 0) + CASE WHEN first_km > 2 THEN {ROAD_MIN.format(km='first_km')} ELSE 0 END + CASE WHEN last_km > 2 THEN {ROAD_MIN.format(km='last_km')} ELSE 0 END AS INTEGER) AS minutes,
  CAST(rail_fare + CASE WHEN first_km > 2 THEN {ROAD_FARE.format(km='first_km')} ELSE 0 END + CASE WHEN last_km > 2 THEN {ROAD_FARE.format(km='last_km')} ELSE 0 END AS INTEGER) AS fare,
  CAST(greatest(25, least(97, round_even(CASE WHEN transfers = 0 THEN 0.5 * confirmation_pct + 0.3 * on_time + 0.2 * greatest(30.0, 100 - first_km / 6)
     ELSE 0.38 * confirmation_pct + 0.3 * coalesce(safety, 60) + 0.2 * on_time + 0.12 * greatest(30.0, 100 - first_km / 6) END, 0))) AS INTEGER) AS reliability,
  transfers, CASE WHEN transfers = 1 THEN change_at WHEN first_km > 20 THEN board END AS hub, first_train, dep_min, false AS road_only, on_time, safety, confirmation_pct FROM v_srail1
UNION ALL SELECT request_id, 'road-' || left(lower(from_place), 24) || '-' || left(lower(to_place), 24), 'road-' || left(lower(from_place), 24) || '-' || left(lower(to_place), 24), pref, 'direct',
  CAST(greatest(15, {ROAD_MIN.format(km='km')}) AS INTEGER), {ROAD_FARE.format(km='km')}, 68, 0, NULL, NULL, NULL, true, NULL, NULL, NULL
FROM (SELECT *, {hav('o_lat', 'o_lng', 'd_lat', 'd_lng')} * 1.3 AS km FROM v_strip) WHERE (km <= 500 OR request_id NOT IN (SELECT request_id FROM v_sroutes))
  AND request_id IN (SELECT request_id FROM v_so_heads) AND request_id IN (SELECT request_id FROM v_sd_heads)
"""
VIEWS["v_skeys"] = VIEWS["v_keys"].replace("v_routes", "v_sall")
VIEWS["v_soverflow"] = VIEWS["v_overflow"].replace("v_keys", "v_skeys")
VIEWS["v_sshown"] = VIEWS["v_capped"].replace("v_overflow", "v_soverflow").replace("<= 6", "<= 15").replace("<= 7", "<= 16")


def search_tables(net):
    """What a deployment keeps as tables, built here from the supplied ones."""
    stops = net.stops()
    stats = delays.delay_stats(net.observations()).withColumn("train_no", F.lpad("train_no", 7, "0"))
    quotes = net.quotes()
    stations, guarded, measured, distances, knots, fits = cut_lineages(
        timetable.with_train_counts(net.stations_raw(), stops), timetable.stop_detour(stops, net.stations_raw()), stats,
        journeys.station_distances(stops), fares.stored_knots(fares.fit_isotonic(quotes)), fares.fit_linear(quotes),
    )
    return Tables(
        cities=net.places(), stations=stations, stops=guarded, trains=net.trains(), delays=measured, distances=distances,
        knots=knots, fits=fits, calendar=calendar_table(net.spark),
    )


def settings():
    return Settings(
        hub_min=HUB_MIN + 10, head_hub_min=HUB_MIN, top_hubs=5, near_named_km=150.0, guard_km=GUARD, state_of=F.col("state"),
    )


def searched(net, forest=None):
    return TripSearch(net.requests(), search_tables(net), F.lit(AS_OF).cast("date"), settings(), forest)


@query("""
SELECT r.request_id, r.position, r.shown_id AS route_id, r.route_type, r.transfers, r.minutes, r.fare, r.reliability, r.on_time, r.confirmation_pct, r.safety, r.hub,
  CASE WHEN NOT r.road_only THEN b.route_id END AS plan_b_route
FROM v_sshown r LEFT JOIN LATERAL (SELECT a.route_id FROM v_sshown a WHERE a.request_id = r.request_id AND NOT a.road_only AND a.dep_min > r.dep_min
  ORDER BY a.dep_min, a.position LIMIT 1) b ON true
""", name="trip_search")
def search(net):
    out = searched(net).routes
    return out.select(
        "request_id", "position", F.col("shown_id").alias("route_id"), "route_type", "transfers", "minutes", "fare", "reliability", "on_time",
        "confirmation_pct", "safety", "hub", "plan_b_route",
    )


@query("""
SELECT request_id, 'place_not_found' AS reason FROM v_requests WHERE request_id % 11 = 0 OR request_id NOT IN (SELECT request_id FROM v_strip)
UNION ALL SELECT request_id, 'no_railhead' FROM v_strip WHERE request_id % 11 <> 0
  AND (request_id NOT IN (SELECT request_id FROM v_so_heads) OR request_id NOT IN (SELECT request_id FROM v_snear_heads))
""")
def unplaced_requests(net):
    """Requests that name an unknown place, and requests without a railhead near their destination."""
    place = F.when(F.col("request_id") % 11 == 0, F.concat(F.lit("QZX"), F.col("request_id").cast("string"))).otherwise(F.col("from_place"))
    requests = net.requests().withColumn("from_place", place)
    near = settings()
    near.dest_ladder = [20.0, 40.0]
    return TripSearch(requests, search_tables(net), F.lit(AS_OF).cast("date"), near).unanswered


@query("""
SELECT train_number || '-' || station_code || '-' || alight AS route_id, train_number AS first_train, name || '' AS board_name, minutes,
  CAST(1 AS INTEGER) AS n_legs, 'direct' AS route_type
FROM (SELECT *, row_number() OVER (PARTITION BY train_number, station_code, alight ORDER BY seq) AS nth FROM (
        SELECT s.*, n.station_code AS alight, (n.day - s.day) * 1440 + coalesce(n.arr_min, n.dep_min) - coalesce(s.dep_min, s.arr_min) AS minutes
        FROM v_stops s JOIN v_stops n ON n.train_number = s.train_number AND n.seq = s.seq + 1 WHERE s.seq = 1)) JOIN v_stations_raw ON code = station_code
WHERE minutes > 0 AND nth = 1
""")
def rebuilt_routes(net):
    """Whole routes from their ids: the first hop of each train."""
    from wayframe.plans.search import rebuilt_routes as rebuild

    stops = net.stops()
    second = stops.filter("seq = 2").select("train_number", F.col("station_code").alias("alight"))
    ids = stops.filter("seq = 1").join(second, "train_number").select(F.concat_ws("-", "train_number", "station_code", "alight").alias("route_id"))
    out = rebuild(ids, search_tables(net), guard_km=1e9)
    return out.select(F.col("shown_id").alias("route_id"), "first_train", "board_name", "minutes", F.size("legs").alias("n_legs"), "route_type")


VIEWS["v_snear_heads"] = heads_sql("d_lat", "d_lng", [20.0, 40.0]).replace("v_trip", "v_strip")
VIEWS["v_sreason"] = """
SELECT s.request_id, s.transfers = 0 AND s.route_type = 'direct' AS is_direct, s.hub, t.d_name AS to_name,
  (SELECT count(*) FROM v_sshown x WHERE x.request_id = s.request_id AND x.transfers = 0 AND x.route_type = 'direct') AS n
FROM v_sshown s JOIN v_strip t USING (request_id) WHERE s.position = 1
"""


@query("""
SELECT request_id, CASE WHEN is_direct THEN 'direct' ELSE 'cross-origin' END AS mode, CAST(CASE WHEN NOT is_direct THEN greatest(5, least(90, n * 18)) END AS INTEGER) AS direct_confirmability,
  CASE WHEN NOT is_direct THEN CASE WHEN n > 0 THEN CAST(n AS VARCHAR) || ' local through option(s)' ELSE 'no through train from here' END END AS direct_note FROM v_sreason
""")
def search_reasoning(net):
    return searched(net).reasoning.select("request_id", "mode", "direct_confirmability", "direct_note")


@query("""
SELECT t.request_id, CASE WHEN d.score >= 60 THEN 'high' ELSE 'moderate' END AS level, split_part(d.drivers, '|', 1) AS label, d.drivers
FROM v_strip t JOIN (SELECT DISTINCT day, score, drivers FROM v_demand) d ON d.day = t.day WHERE d.score >= 35
""")
def search_advisories(net):
    out = searched(net).advisory
    return out.select("request_id", "advisory.level", "advisory.label", F.array_join("demand_drivers", "|").alias("drivers"))


# Reasoning over ready-made routes: the railheads are the nations' stand-ins h0 to h9.
VIEWS["v_rheads"] = """
SELECT c_custkey AS request_id, 'H' || CAST(i AS VARCHAR) AS code, 'Hub ' || CAST(i AS VARCHAR) AS name, CAST(60 + (c_custkey * 7 + i * 13) % 300 AS INTEGER) AS trains,
  CAST((c_custkey + i * 17) % 90 AS DOUBLE) AS km, CAST(CASE WHEN (c_custkey + i) % 3 = 0 THEN (c_custkey + i) % 5 ELSE 0 END AS INTEGER) AS directs FROM customer, range(10) r(i)
"""


@query("""
WITH top AS (SELECT * FROM v_ranked WHERE position = 1), nd AS (SELECT request_id, count(*) FILTER (transfers = 0 AND route_type = 'direct') AS n FROM v_ranked GROUP BY 1),
h AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY directs DESC, trains DESC, code) AS rk, least(92, 30 + trains // 6 + 9 * directs) AS pct FROM v_rheads),
x AS (SELECT t.request_id, t.hub, t.transfers = 0 AND t.route_type = 'direct' AS is_direct, n, 'Hub 3' AS board FROM top t JOIN nd USING (request_id)),
l AS (SELECT x.request_id, string_agg(CASE WHEN is_direct THEN h.name || '=' || CAST(CAST(round_even(h.km, 0) AS INTEGER) AS VARCHAR) || ' km away'
    ELSE h.name || '=' || CASE WHEN directs > 0 THEN CAST(directs AS VARCHAR) || ' through train(s)' ELSE 'no through train' END || CASE WHEN h.code = hub THEN '*' ELSE '' END END, '|' ORDER BY rk) AS hubs,
    bool_or(h.code = hub) AS seen FROM x JOIN h ON h.request_id = x.request_id
  WHERE CASE WHEN is_direct THEN rk <= 2 AND h.name <> board ELSE rk <= 3 OR (rk = 4 AND h.code = hub) END GROUP BY 1),
w AS (SELECT x.request_id, max(CASE WHEN h.code = hub THEN directs ELSE 0 END) AS wd, bool_or(directs > 0 AND coalesce(h.code <> hub, true)) AS others FROM x JOIN h ON h.request_id = x.request_id GROUP BY 1)
SELECT x.request_id, CASE WHEN is_direct THEN 'direct' ELSE 'cross-origin' END AS mode,
  coalesce(hubs, '') || CASE WHEN NOT is_direct AND hub IS NOT NULL AND NOT coalesce(seen, false) THEN '|Hub ' || substr(hub, 2) || '=best onward connections*' ELSE '' END AS hubs,
  CASE WHEN is_direct THEN 'Direct wins — ' || CAST(n AS VARCHAR) || ' through-train option(s) from Hub 3, no detour or change of train needed.'
    WHEN wd > 0 AND NOT others THEN 'Via Hub ' || substr(hub, 2) || ' wins — the only nearby railhead with a through train to X: one road hop, then no change of train.'
    WHEN wd > 0 THEN 'Via Hub ' || substr(hub, 2) || ' wins — ' || CAST(wd AS VARCHAR) || ' through train(s) to X and the best door-to-door time scanned.'
    ELSE 'Via Hub ' || substr(hub, 2) || ' wins — no railhead here has a through train; Hub ' || substr(hub, 2) || ' offers the safest one-change link.' END AS conclusion
FROM x LEFT JOIN l USING (request_id) JOIN w USING (request_id)
""")
def route_reasoning(net):
    out = reasoned(net)
    row = F.transform("hubs", lambda h: F.concat(h["name"], F.lit("="), h["note"], F.when(h["winner"], "*").otherwise("")))
    return out.select("request_id", "mode", F.array_join(row, "|").alias("hubs"), "conclusion")


def reasoned(net):
    ranked = ranking.rank_routes(net.routes())
    hub_name = F.concat(F.lit("Hub "), F.substring("hub", 2, 9))
    routes = ranked.withColumn("hub_name", hub_name).withColumn("board_name", F.lit("Hub 3")).withColumn("board_trains", F.lit(100)).withColumn("to_name", F.lit("X"))
    c = F.col("request_id")
    ten = net.table("customer").select(F.col("c_custkey").alias("request_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    heads = ten.select(
        "request_id", F.concat(F.lit("H"), F.col("i").cast("string")).alias("code"), F.concat(F.lit("Hub "), F.col("i").cast("string")).alias("name"),
        (60 + (c * 7 + F.col("i") * 13) % 300).cast("int").alias("trains"), ((c + F.col("i") * 17) % 90).cast("double").alias("km"),
        F.when((c + F.col("i")) % 3 == 0, (c + F.col("i")) % 5).otherwise(0).cast("int").alias("n"),
    )
    directs = heads.filter(F.col("n") > 0).select("request_id", "code", F.col("n").alias("directs"))
    return ranking.reasoning(routes, heads.drop("n"), directs)


@query("""
SELECT t.request_id, CAST(2 + CASE WHEN t.transfers = 0 AND t.route_type = 'direct' THEN b ELSE 3 + e END AS INTEGER) AS items,
  CASE WHEN t.transfers = 0 AND t.route_type = 'direct' THEN 'directWin' ELSE 'directFail' END AS first_kind
FROM (SELECT * FROM v_ranked WHERE position = 1) t JOIN (
  SELECT h.request_id, count(*) FILTER (rk <= 2 AND name <> 'Hub 3') AS b, CASE WHEN any_value(t.hub) IS NULL OR bool_or(rk <= 3 AND h.code = t.hub) THEN 0 ELSE 1 END AS e
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY directs DESC, trains DESC, code) AS rk FROM v_rheads) h
  JOIN (SELECT * FROM v_ranked WHERE position = 1) t USING (request_id) GROUP BY 1) USING (request_id)
""")
def reasoning_lists(net):
    out = ranking.reasoning_items(reasoned(net).withColumn("from_name", F.lit("A")).withColumn("to_name", F.lit("X")))
    return out.select("request_id", F.size("items").alias("items"), F.element_at("items", 1)["kind"].alias("first_kind"))


# --- delay model -----------------------------------------------------------------------------------

FEATURES_SQL = """
SELECT o.train_no, o.obs_date, o.station_no, s.avg_delay AS baseline, CAST(CASE CAST(o.train_no AS INTEGER) % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 2 END AS DOUBLE) AS tier_code,
  p.cum_km AS dist_km, round(CASE WHEN total > 0 THEN p.cum_km / total ELSE 0.0 END, 6) AS frac_route, CAST(coalesce(p.arr_min // 60, -1) AS DOUBLE) AS sched_hour, CAST(p.day - 1 AS DOUBLE) AS day_offset,
  CAST(isodow(o.obs_date) - 1 AS DOUBLE) AS dow, CAST(month(o.obs_date) AS DOUBLE) AS month, CAST(o.delay_min AS DOUBLE) AS delay
FROM v_obs o JOIN v_delay_stats s USING (train_no)
JOIN (SELECT *, max(cum_km) OVER (PARTITION BY train_no) AS total FROM (
  SELECT coalesce(nullif(ltrim(train_number, '0'), ''), train_number) AS train_no, seq AS station_no, cum_km, arr_min, day FROM v_stops)) p
  ON p.train_no = o.train_no AND p.station_no = o.station_no WHERE o.delay_min IS NOT NULL
"""


def features(net):
    obs = net.observations()
    stops = timetable.normalised_numbers(net.stops(), "train_number").select(
        F.col("train_number").alias("train_no"), F.col("seq").alias("station_no"), "cum_km", "arr_min", "day"
    )
    stats = cut_lineage(delays.delay_stats(obs))  # read for the averages and the tiers
    names = {0: "premium", 1: "superfast", 2: "express"}
    k = F.col("train_no").cast("int") % 4
    tiers = stats.filter(k < 3).select("train_no", F.element_at(F.array(*[F.lit(names[i]) for i in range(3)]), k + 1).alias("tier"))
    return model.build_features(obs, stops, stats, tiers)


@query(FEATURES_SQL)
def model_features(net):
    return features(net).withColumn("frac_route", F.round("frac_route", 6))


@query(f"""
SELECT * FROM ({FEATURES_SQL}) QUALIFY row_number() OVER (PARTITION BY train_no ORDER BY md5(concat_ws('|', train_no, CAST(obs_date AS VARCHAR), CAST(station_no AS VARCHAR), CAST(CAST(delay AS INTEGER) AS VARCHAR), '42')),
  train_no, obs_date, station_no, delay) <= 20
""")
def sampled_features(net):
    rows = features(net).withColumn("frac_route", F.round("frac_route", 6)).withColumn("delay_key", F.col("delay").cast("int"))
    out = model.sample_per_key(rows, "train_no", ["train_no", "obs_date", "station_no", "delay_key"], cap=20)
    return out.drop("delay_key")


def trained(net):
    rows = features(net).withColumn("delay_key", F.col("delay").cast("int"))
    return jobs.train_delay_model(
        rows, "2025-01-01T00:00:00", ["train_no", "obs_date", "station_no", "delay_key"], trees=8, depth=4, min_leaf=20
    )


@query()
def quantile_forest_scores(net):
    return trained(net).scored.select("train_no", "obs_date", "station_no", "delay", "avg_delay", "p50", "p90")


@query()
def quantile_forest_errors(net):
    return trained(net).errors


@query()
def quantile_forest_coverage(net):
    return trained(net).coverage


# Reports on given predictions: the curve of a row is its train's own quantiles.
VIEWS["v_scored"] = f"""
SELECT f.*, q.avg_delay, q.q FROM ({FEATURES_SQL}) f JOIN (
  SELECT train_no, avg(delay) AS avg_delay, list_transform(quantile_disc(delay, [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]), lambda x: CAST(x AS DOUBLE)) AS q FROM ({FEATURES_SQL}) GROUP BY 1) q USING (train_no)
"""


def given_scores(net):
    rows = cut_lineage(features(net))  # read for the curves and for the rows they are given to
    hist = rows.groupBy("train_no", "delay").agg(F.count(F.lit(1)).alias("n"))
    scored = hist.select(F.col("train_no").alias("tree"), F.lit(0).alias("leaf"), "delay", "n")
    from pyspark.sql import Window as W

    over = W.partitionBy("tree")
    upto = F.sum("n").over(over.orderBy("delay").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = scored.withColumn("total", F.sum("n").over(over)).withColumn("upto", upto)
    at = [F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("delay"))) for q in fixed.QUANTILE_LEVELS]
    mean = F.sum(F.col("delay") * F.col("n")) / F.max("total")
    curve = ranked.groupBy(F.col("tree").alias("train_no")).agg(F.array(*at).alias("curve"), mean.alias("avg_delay"))
    out = rows.join(curve, "train_no")
    return out.withColumn("p50", F.element_at("curve", 3)).withColumn("p90", F.element_at("curve", 5))


@query("SELECT [0.1, 0.25, 0.5, 0.75, 0.9, 0.99][i]::DOUBLE AS level, round(avg(CASE WHEN delay <= q[i] THEN 1.0 ELSE 0.0 END), 6) AS covered FROM v_scored, range(1, 7) r(i) GROUP BY i")
def coverage_report(net):
    return model.coverage_report(given_scores(net))


@query("""
SELECT n, m AS mae_model, b AS mae_baseline, round(100 * (b - m) / b, 4) AS gain_pct FROM (
  SELECT count(*) AS n, round(avg(abs(avg_delay - delay)), 6) AS m, round(avg(abs(baseline - delay)), 6) AS b FROM v_scored)
""")
def error_report(net):
    return model.error_report(given_scores(net))


@query("""
SELECT tier, NULL::VARCHAR AS day_bucket, count(*) AS n, round(avg(abs(q[3] - delay)), 6) AS p50_mae, round(avg(CASE WHEN delay <= q[5] THEN 1.0 ELSE 0.0 END), 6) AS p90_coverage
FROM (SELECT *, ['premium', 'superfast', 'express', 'passenger'][CAST(tier_code AS INTEGER) + 1] AS tier FROM v_scored) GROUP BY 1 HAVING count(*) >= 200
UNION ALL SELECT NULL, CASE WHEN day_offset <= 0 THEN '0' WHEN day_offset = 1 THEN '1' ELSE '2+' END AS b, count(*), round(avg(abs(q[3] - delay)), 6), round(avg(CASE WHEN delay <= q[5] THEN 1.0 ELSE 0.0 END), 6)
FROM v_scored GROUP BY b HAVING count(*) >= 200
""")
def stratified_report(net):
    return model.stratified_report(given_scores(net))


# --- streams over the events files ---------------------------------------------------------------


def run_stream(df, name: str):
    """Run a stream over all files to its end and give the rows it wrote."""
    spark = df.sparkSession
    folder = scratch_folder(spark, "wayframe-stream")
    running = (
        df.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).outputMode("append").start()
    )
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def event_stream(net):
    schema = net.table("events").schema
    return net.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(net.folder)


@query("SELECT event_id, user_id, ts FROM (SELECT user_id, event_type, CAST(ts AS DATE) AS d, min(event_id) AS event_id, min(ts) AS ts FROM events GROUP BY 1, 2, 3)")
def stream_latest_batches(net):
    """First event per user, type and day through the batch writer and the current table."""
    from wayframe.streaming.feeds import current_table, merge_latest

    folder = scratch_folder(net.spark, "wayframe-upserts")
    keys, order = ["user_id", "event_type", "d"], ["back"]
    rows = event_stream(net).select("event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("d"), (-F.col("event_id")).alias("back"))
    running = (
        rows.writeStream.foreachBatch(merge_latest(f"{folder}/table", keys, order)).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return current_table(net.spark, f"{folder}/table").select("event_id", "user_id", "ts")


CLEAN = """
v AS (SELECT lpad(CAST(user_id AS VARCHAR), 7, '0') AS train_raw, CAST(ts AS DATE) AS d, CAST(trunc(value - 20) AS INTEGER) AS delay FROM events),
clean AS (SELECT coalesce(nullif(ltrim(train_raw, '0'), ''), train_raw) AS train_no, d, delay FROM v WHERE delay BETWEEN -120 AND 1440)
"""


def run_to_the_end(net, stream, feed, closing):
    """A stream over the whole feed, closed by one late row."""
    from wayframe.streaming.feeds import finished

    return finished(stream, feed, closing, scratch_folder(net.spark, "wayframe-stream"))


def last_time(net):
    return net.table("events").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))


def closed_delays(net, stream):
    """The delay feed ends with a row three days after its last one."""
    end = last_time(net).select(F.lit("0").alias("train_no"), (F.col("last") + F.expr("INTERVAL 3 DAYS")).alias("obs_ts"), F.lit(1).alias("station_no"), F.lit("0").alias("delay"))
    return run_to_the_end(net, stream, delay_feed(net), end)


def delay_feed(net):
    return event_stream(net).select(
        F.lpad(F.col("user_id").cast("string"), 7, "0").alias("train_no"), F.col("ts").cast("timestamp").alias("obs_ts"),
        (F.col("event_id") % 5 + 1).cast("int").alias("station_no"), (F.col("value") - 20).cast("string").alias("delay"),
    )


@query(f"""
WITH {CLEAN} SELECT train_no, CAST(d AS VARCHAR) AS window_day, count(*) AS n, CAST(sum(delay) AS BIGINT) AS sum_delay, count(*) FILTER (delay <= {fixed.ON_TIME_MINUTES}) AS on_time_n
FROM clean GROUP BY 1, 2
""")
def stream_delay_windows(net):
    """Tumbling delay sums per train, of all windows of the feed."""
    from wayframe.streaming.feeds import delay_stream

    out = closed_delays(net, delay_stream)
    return out.select("train_no", F.to_date("window_start").cast("string").alias("window_day"), "n", "sum_delay", "on_time_n")


@query(f"WITH {CLEAN} SELECT train_no, delay AS delay_min, CAST(d AS VARCHAR) AS window_day, count(*) AS n FROM clean GROUP BY ALL")
def stream_delay_histogram(net):
    """Counts per day, train and delay, from which percentiles of any span follow."""
    from wayframe.streaming.feeds import histogram_stream

    out = closed_delays(net, histogram_stream)
    return out.select("train_no", "delay_min", F.to_date("window_start").cast("string").alias("window_day"), "n")


# a train's percentiles: its sketches hold all its values up to 200 of them, and above that the ranks within 1.65 %
@query(f"""
WITH {CLEAN}, e AS (SELECT train_no, delay, count(*) OVER (PARTITION BY train_no) AS n, row_number() OVER (PARTITION BY train_no ORDER BY delay) AS nth,
  count(*) OVER (PARTITION BY train_no ORDER BY delay) AS upto FROM clean)
SELECT train_no, any_value(n) AS n, round_even(avg(delay), 1) AS avg_delay, round_even(100.0 * count(*) FILTER (delay <= {fixed.ON_TIME_MINUTES}) / any_value(n), 1) AS on_time_pct, true AS p50_near, true AS p80_near, true AS p90_near
FROM e GROUP BY train_no
""")
def stream_delay_percentiles(net):
    """Mean and share on time per train of all windows' sums, and whether the merged sketches' percentiles have ranks within 1.65 % of the asked ones."""
    from wayframe.streaming.feeds import sketch_percentiles, sketch_stream

    found = sketch_percentiles(closed_delays(net, sketch_stream), ["train_no"])
    exact = delays.clean_observations(net.table("events").select(
        F.lpad(F.col("user_id").cast("string"), 7, "0").alias("train_no"), F.to_date("ts").alias("obs_date"), F.lit(1).alias("station_no"), (F.col("value") - 20).cast("string").alias("delay")))
    met = exact.where("delay_min IS NOT NULL").select("train_no", "delay_min").join(found, "train_no")
    near = []
    for name, q in (("p50", 0.5), ("p80", 0.8), ("p90", 0.9)):
        # ranks below and up to the value must enclose the asked one, but for the sketch's error
        below, upto = F.count_if(F.col("delay_min") < F.col(name)) / F.first("n"), F.count_if(F.col("delay_min") <= F.col(name)) / F.first("n")
        near.append(((below <= q + 0.0165) & (upto >= q - 0.0165)).alias(f"{name}_near"))
    return met.groupBy("train_no").agg(F.first("n").alias("n"), F.first("avg_delay").alias("avg_delay"), F.first("on_time_pct").alias("on_time_pct"), *near)


@query("SELECT train_no, CAST(min(ts) AS DATE) AS obs_date, CAST(event_id_mod AS INTEGER) AS station_no FROM (SELECT lpad(CAST(user_id AS VARCHAR), 7, '0') AS train_no, ts, event_id % 5 + 1 AS event_id_mod FROM events) GROUP BY train_no, CAST(ts AS DATE), event_id_mod")
def stream_deduped_snapshots(net):
    from wayframe.streaming.feeds import dedupe_snapshots

    e = event_stream(net)
    rows = e.select(
        F.lpad(F.col("user_id").cast("string"), 7, "0").alias("train_no"), F.to_date("ts").alias("obs_date"),
        (F.col("event_id") % 5 + 1).cast("int").alias("station_no"), F.col("ts").cast("timestamp").alias("seen_at"),
    )
    return run_stream(dedupe_snapshots(rows), "snapshots").select("train_no", "obs_date", "station_no")


@query("""
SELECT event_id, key, hits, hits > 4 AS flagged FROM (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS key, (SELECT CAST(count(*) AS INTEGER) FROM events b WHERE b.user_id = a.user_id AND epoch_us(b.ts) > epoch_us(a.ts) - 86400000000
      AND (epoch_us(b.ts) < epoch_us(a.ts) OR (epoch_us(b.ts) = epoch_us(a.ts) AND b.event_id <= a.event_id))) AS hits FROM events a)
""")
def stream_sliding_limits(net):
    """All hits of the feed with the number in their trailing day."""
    from wayframe.streaming.feeds import sliding_limit_stream

    rows = event_stream(net).select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    end = last_time(net).select(F.lit("the end").alias("key"), F.lit(0).cast("bigint").alias("event_id"), (F.col("last") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    out = run_to_the_end(net, lambda feed: sliding_limit_stream(feed, 4, 86400), rows, end)
    return out.where("key <> 'the end'").select("event_id", "key", "hits", "flagged")


# the lists of reasoning_lists in full
@query("""
WITH top AS (SELECT * FROM v_ranked WHERE position = 1), nd AS (SELECT request_id, count(*) FILTER (transfers = 0 AND route_type = 'direct') AS n FROM v_ranked GROUP BY 1),
h AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY directs DESC, trains DESC, code) AS rk, least(92, 30 + trains // 6 + 9 * directs) AS pct FROM v_rheads),
x AS (SELECT t.request_id, t.hub, t.transfers = 0 AND t.route_type = 'direct' AS is_direct, n FROM top t JOIN nd USING (request_id)),
shown AS (
  SELECT x.request_id, is_direct, rk, h.name, CASE WHEN is_direct THEN 'muted' WHEN h.code = hub THEN 'winner' ELSE 'muted' END AS kind, h.code = hub AS is_hub,
    CASE WHEN is_direct THEN CAST(CAST(round_even(h.km, 0) AS INTEGER) AS VARCHAR) || ' km away' ELSE CAST(h.trains AS VARCHAR) || '/day · ' || CAST(pct AS VARCHAR) || '%' END AS sub
  FROM x JOIN h ON h.request_id = x.request_id WHERE CASE WHEN is_direct THEN rk <= 2 AND h.name <> 'Hub 3' ELSE rk <= 3 OR (rk = 4 AND h.code = hub) END),
listed AS (
  SELECT request_id, rk, kind, name, sub FROM shown
  UNION ALL SELECT request_id, 9, 'winner', 'Hub ' || substr(hub, 2), '100/day · 70%' FROM x WHERE NOT is_direct AND hub IS NOT NULL AND request_id NOT IN (SELECT request_id FROM shown WHERE is_hub)),
sizes AS (SELECT x.*, coalesce(k, 0) AS k FROM x LEFT JOIN (SELECT request_id, count(*) AS k FROM listed GROUP BY 1) USING (request_id)),
board AS (SELECT request_id, any_value(directs) AS directs FROM h WHERE name = 'Hub 3' AND directs > 0 GROUP BY 1),
items AS (
  SELECT request_id, 0 AS pos, CASE WHEN is_direct THEN 'directWin' ELSE 'directFail' END AS kind, 'Direct A → X' AS title,
    CASE WHEN is_direct THEN CAST(coalesce(directs, n) AS VARCHAR) || ' daily direct trains' ELSE CAST({conf} AS VARCHAR) || '% confirmable · ' || CASE WHEN n > 0 THEN CAST(n AS VARCHAR) || ' local through option(s)' ELSE 'no through train from here' END END AS sub
  FROM sizes LEFT JOIN board USING (request_id)
  UNION ALL SELECT request_id, 1, 'scan', CASE WHEN is_direct THEN 'Also checked ' ELSE 'Scanned ' END || CAST(k AS VARCHAR) || ' nearby hub' || CASE WHEN k > 1 THEN 's' ELSE '' END, NULL FROM sizes WHERE NOT is_direct OR k > 0
  UNION ALL SELECT request_id, 1 + rk, kind, name, sub FROM listed)
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY pos) AS INTEGER) AS place, kind, title, sub FROM items
""".replace("{conf}", "greatest(5, least(90, n * 18))"))
def reasoning_texts(net):
    """Every entry of the reasoning of every request, in its order."""
    out = ranking.reasoning_items(reasoned(net).withColumn("from_name", F.lit("A")).withColumn("to_name", F.lit("X")))
    return out.select("request_id", F.posexplode("items").alias("at", "i")).select(
        "request_id", (F.col("at") + 1).alias("place"), "i.kind", "i.title", "i.sub")
