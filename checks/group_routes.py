"""Queries on scored routes: ranking, filters, tags, plan B, legs, explanations."""

from pyspark.sql import functions as F

from wayframe import fixed
from wayframe.operators import ranking
from wayframe.plans import routes as build

from .catalog import query
from .views import VIEWS, clock


@query("SELECT request_id, route_id, position FROM v_ranked")
def ranked_routes(net):
    return ranking.rank_routes(net.routes()).select("request_id", "route_id", "position")


@query("""
SELECT request_id, route_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE pref WHEN 'cheapest' THEN fare WHEN 'fastest' THEN minutes ELSE -reliability END, route_id) AS INTEGER) AS position FROM v_routes
""")
def routes_by_reliability(net):
    return ranking.simple_rank(net.routes()).select("request_id", "route_id", "position")


VIEWS["v_overflow"] = """
SELECT k.*, CASE WHEN transfers = 0 OR x.route_id IS NOT NULL THEN 0 ELSE 1 END AS overflow FROM v_keys k LEFT JOIN (
  SELECT request_id, route_id AS route_id FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, h ORDER BY k1, k2, k3, k4, route_id) AS in_hub FROM (
      SELECT *, coalesce(hub, '_x') AS h FROM v_keys WHERE transfers > 0 QUALIFY row_number() OVER (PARTITION BY request_id, h, first_train ORDER BY k1, k2, k3, k4, route_id) = 1))
  WHERE in_hub <= 2) x ON x.request_id = k.request_id AND x.route_id = k.route_id
"""


@query("SELECT request_id, route_id, overflow, CAST(row_number() OVER (PARTITION BY request_id ORDER BY overflow, k1, k2, k3, k4, route_id) AS INTEGER) AS position FROM v_overflow")
def diversified_routes(net):
    return ranking.diversify(net.routes()).select("request_id", "route_id", "overflow", "position")


VIEWS["v_capped"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY k1, k2, k3, k4, route_id) AS INTEGER) AS position FROM (
  SELECT * FROM v_overflow WHERE road_only UNION ALL
  SELECT * FROM (SELECT * FROM v_overflow WHERE NOT road_only QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY overflow, k1, k2, k3, k4, route_id) <= 6))
QUALIFY position <= 7
"""


@query("SELECT request_id, route_id, position FROM v_capped")
def capped_routes(net):
    return ranking.cap_routes(net.routes(), rail=6, total=7).select("request_id", "route_id", "position")


@query("""
SELECT r.request_id, r.route_id, CASE WHEN NOT r.road_only THEN b.route_id END AS plan_b_route, CASE WHEN NOT r.road_only THEN b.dep_min END AS plan_b_dep
FROM v_ranked r LEFT JOIN LATERAL (SELECT a.route_id, a.dep_min FROM v_ranked a WHERE a.request_id = r.request_id AND NOT a.road_only AND a.dep_min > r.dep_min
  ORDER BY a.dep_min, a.position LIMIT 1) b ON true
""")
def plan_b_routes(net):
    out = ranking.plan_b(ranking.rank_routes(net.routes()))
    return out.select("request_id", "route_id", "plan_b_route", "plan_b_dep")


@query(f"""
SELECT route_id, 'Miss it? Next train: T1 departing ' || {clock('dep_min')} || ' — ₹' || CAST(fare AS VARCHAR) || ', ' || CAST(minutes // 60 AS VARCHAR) || 'h '
  || CAST(minutes % 60 AS VARCHAR) || 'min door to door.' AS plan_b FROM v_routes WHERE dep_min IS NOT NULL
""")
def plan_b_texts(net):
    text = ranking.plan_b_text(F.lit("T1"), F.col("dep_min"), F.col("fare"), F.col("minutes"))
    return net.routes().filter(F.col("dep_min").isNotNull()).select("route_id", text.alias("plan_b"))


@query("""
SELECT request_id, route_id, CASE WHEN c = 1 AND f = 1 THEN 'Cheapest & fastest' WHEN c = 1 THEN 'Cheapest' WHEN f = 1 THEN 'Fastest' END AS tag FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY fare, position) AS c, row_number() OVER (PARTITION BY request_id ORDER BY minutes, position) AS f FROM v_ranked)
""")
def best_tags(net):
    return ranking.tag_best(ranking.rank_routes(net.routes())).select("request_id", "route_id", "tag")


@query("""
SELECT request_id, hub, count(*) AS routes, arg_min(route_id, position) AS best_route, arg_min(first_mile_minutes, position) AS first_mile_minutes,
  arg_min(first_mile_fare, position) AS first_mile_fare FROM v_ranked WHERE route_type = 'cross-origin' AND hub IS NOT NULL GROUP BY 1, 2
""")
def hub_choices(net):
    return ranking.hub_choices(ranking.rank_routes(net.routes()))


@query("""
SELECT request_id, d AS direct_route, coalesce(c, first_other) AS alt_route, coalesce(c IS NULL AND first_other IS NOT NULL, false) AS all_direct FROM (
  SELECT r.request_id, any_value(x.d) AS d, any_value(x.c) AS c, arg_min(r.route_id, r.position) FILTER (x.d IS NULL OR r.route_id <> x.d) AS first_other FROM v_ranked r JOIN (
    SELECT request_id, arg_min(route_id, position) FILTER (route_type = 'direct') AS d, arg_min(route_id, position) FILTER (route_type <> 'direct') AS c FROM v_ranked GROUP BY 1) x USING (request_id)
  GROUP BY r.request_id)
""")
def compared_routes(net):
    return ranking.compare_best(ranking.rank_routes(net.routes()))


VIEWS["v_legged"] = f"""
SELECT *, CASE WHEN dep_min IS NOT NULL THEN {clock('dep_min')} END AS depart, CASE WHEN arr_min IS NOT NULL THEN {clock('arr_min')} END AS arrive FROM v_routes
"""


def legged(net):
    """Routes with legs: access by road, one or two trains, a change between."""
    r = net.routes()
    name = F.concat(F.lit("Train "), F.col("route_id").cast("string"))
    half = F.floor(F.col("minutes") / 2).cast("int")
    change = F.col("transfers") == 1
    first = build.train_leg(F.col("first_train"), name, F.lit("B"), F.when(change, F.lit("H")).otherwise("A"), F.col("dep_min"),
                            F.when(~change, F.col("arr_min")), F.when(change, half).otherwise(F.col("minutes")), F.col("fare"))
    second = build.train_leg(F.lit("T9"), name, F.lit("H"), F.lit("A"), F.lit(600), F.col("arr_min"), F.col("minutes") - half, F.lit(100))
    link = build.change_leg(F.lit("H"), F.lit(700), F.lit(45), F.lit(80))
    rail = F.when(change, F.array(first, link, second)).otherwise(F.array(first))
    legs = build.with_access(rail, F.col("first_km"), F.col("last_km"), F.lit("From"), F.lit("To"), F.lit("B"), F.lit("A"))
    return r.withColumn("legs", legs).withColumn("wait", F.when(change, 45))


@query("""
SELECT request_id, route_id FROM v_legged WHERE coalesce(ac_available, fare >= 600) AND transfers <= 0
  AND NOT coalesce(left(arrive, 2)::INTEGER >= 23 OR left(arrive, 2)::INTEGER < 5, false) AND (classes IS NULL OR list_contains(classes, 'SL'))
  AND (depart IS NULL OR left(depart, 2)::INTEGER BETWEEN 4 AND 9 OR left(depart, 2)::INTEGER BETWEEN 17 AND 21)
""")
def filtered_routes(net):
    out = ranking.filter_routes(legged(net), True, True, True, "SL", ["early-morning", "evening"])
    return out.select("request_id", "route_id")


@query("SELECT request_id, route_id FROM v_legged WHERE NOT coalesce(left(arrive, 2)::INTEGER >= 23 OR left(arrive, 2)::INTEGER < 5, false)")
def no_late_arrivals(net):
    return ranking.filter_routes(legged(net), avoid_late=True).select("request_id", "route_id")


ROAD_MIN = "CAST(round_even({km} / 40 * 60, 0) AS INTEGER)"
ROAD_FARE = "CAST(greatest(20, round_even({km} * 3, 0)) AS INTEGER)"


@query(f"""
SELECT route_id, CAST(CASE WHEN first_km > 2 THEN 2 ELSE 0 END + CASE WHEN last_km > 2 THEN 2 ELSE 0 END + CASE transfers WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS n_legs,
  CAST(minutes + CASE WHEN first_km > 2 THEN {ROAD_MIN.format(km='first_km')} ELSE 0 END + CASE WHEN last_km > 2 THEN {ROAD_MIN.format(km='last_km')} ELSE 0 END + CASE transfers WHEN 1 THEN 45 ELSE 0 END AS INTEGER) AS minutes,
  CAST(fare + CASE WHEN first_km > 2 THEN {ROAD_FARE.format(km='first_km')} ELSE 0 END + CASE WHEN last_km > 2 THEN {ROAD_FARE.format(km='last_km')} ELSE 0 END + CASE transfers WHEN 1 THEN 100 ELSE 0 END AS INTEGER) AS fare,
  CASE WHEN transfers = 1 THEN coalesce(depart, '10:00') ELSE depart END AS depart, CASE WHEN transfers = 1 AND minutes - minutes // 2 > minutes // 2 THEN 'T9' ELSE first_train END || ' Train ' || CAST(route_id AS VARCHAR) AS main_train,
  CASE WHEN first_km > 2 THEN '~' || CAST(CAST(round_even(first_km, 0) AS INTEGER) AS VARCHAR) || ' km road to B' END AS first_note FROM v_legged
""")
def assembled_legs(net):
    r = legged(net)
    notes = F.filter("legs", lambda l: l["note"].endswith(" B"))
    return r.select(
        "route_id", F.size("legs").alias("n_legs"), build.total_minutes(F.col("legs"), F.col("wait")).alias("minutes"),
        build.total_fare(F.col("legs")).alias("fare"), build.first_train_clock(F.col("legs")).alias("depart"),
        build.longest_train(F.col("legs"))["name"].alias("main_train"), F.try_element_at(notes, F.lit(1))["note"].alias("first_note"),
    )


@query("""
SELECT route_id, CASE WHEN transfers = 0 THEN 'Confirmation (est.)=' || CAST(reliability AS VARCHAR) || '*50|On-time record=' || CAST(minutes % 101 AS VARCHAR) || '*30|First-mile access=' || acc || '*20'
  ELSE 'Confirmation (est.)=' || CAST(reliability AS VARCHAR) || '*38|Connection safety (est.)=' || CAST(CASE WHEN route_id % 5 = 0 THEN 60 ELSE 35 + route_id % 60 END AS VARCHAR) || '*30|On-time record='
    || CAST(minutes % 101 AS VARCHAR) || '*20|First-mile access=' || acc || '*12' END AS parts, 100 AS weights
FROM (SELECT *, CAST(CAST(round_even(greatest(30.0, 100 - first_km / 6), 0) AS INTEGER) AS VARCHAR) AS acc FROM v_routes)
""")
def reliability_parts(net):
    k = F.col("route_id")
    safety = F.when(k % 5 != 0, (35 + k % 60).cast("int"))
    parts = build.breakdown(F.col("transfers"), F.col("reliability"), F.col("minutes") % 101, F.lit("measured"), safety, F.col("first_km"))
    text = F.transform("p", lambda x: F.concat(x["label"], F.lit("="), x["value"].cast("string"), F.lit("*"), x["weight"].cast("string")))
    return net.routes().withColumn("p", parts).select(
        "route_id", F.array_join(text, "|").alias("parts"), F.aggregate("p", F.lit(0), lambda a, x: a + x["weight"]).alias("weights")
    )


@query("""
SELECT route_id, concat_ws('|', CASE WHEN route_id % 3 <> 0 THEN 'Confirmation odds=' || CAST(reliability AS VARCHAR) END,
  'On-time reliability=' || CAST(CAST(floor((reliability + minutes % 101) / 2 + 0.5) AS INTEGER) AS VARCHAR),
  CASE WHEN transfers = 1 THEN 'Connection safety=' || CAST(fare % 100 AS VARCHAR) END) AS parts FROM v_routes
""")
def mean_parts(net):
    none = F.lit(None).cast("int")

    def leg(mode, on_time, safety):
        return F.struct(F.lit(mode).alias("mode"), on_time.alias("on_time"), safety.alias("safety"))

    link = F.when(F.col("transfers") == 1, F.col("fare") % 100)
    legs = F.array(leg("train", F.col("reliability"), none), leg("connection", none, link), leg("train", F.col("minutes") % 101, none))
    parts = build.mean_breakdown(legs, F.when(F.col("route_id") % 3 != 0, F.col("reliability")))
    text = F.transform("p", lambda x: F.concat(x["label"], F.lit("="), x["value"].cast("string")))
    return net.routes().withColumn("p", parts).select("route_id", F.array_join(text, "|").alias("parts"))


@query("""
SELECT route_id, CASE WHEN transfers = 1 THEN 'No through train — but H (' || CAST(fare AS VARCHAR) || ' trains/day) links the two sides with a ' || CAST(minutes AS VARCHAR) || '-min connection (~60% safe, est.).'
  ELSE CASE WHEN first_km > 20 THEN 'B (' || CAST(CAST(round_even(first_km, 0) AS INTEGER) AS VARCHAR) || ' km away) is a far better-connected railhead with ' || CAST(fare AS VARCHAR) || ' trains/day — boarding there beats the limited local options.'
    ELSE 'Direct train from B (' || CAST(fare AS VARCHAR) || ' trains/day serve this station) — no change of train.' END || ' ~' || CAST(reliability AS VARCHAR) || '% on-time (est.), ~70% seat-confirm (est.).' END AS why,
  CASE WHEN transfers = 1 THEN 'If the first train is late, H runs ' || CAST(fare AS VARCHAR) || ' trains/day, so a missed connection isn''t a dead end — you can re-book onward there.'
    WHEN route_id % 4 = 0 THEN '9 in 10 runs of this train reach within ~' || CAST(minutes AS VARCHAR) || ' min of schedule (measured) — keep that buffer for any onward connection.'
    WHEN reliability < 55 THEN 'Seats look tight (~' || CAST(reliability AS VARCHAR) || '% confirm, est.) — have a road fallback or nearby-date option ready.' END AS plan_b FROM v_routes
""")
def route_explanations(net):
    none = F.lit(None).cast("int")
    change = F.col("transfers") == 1
    direct = build.why_direct(F.lit("B"), F.col("first_km"), F.col("fare"), F.col("first_km") > 20, F.col("reliability"), F.lit("modelled"), F.lit(70))
    why = F.when(change, build.why_change(F.lit("H"), F.col("fare"), F.col("minutes"), none)).otherwise(direct)
    p90 = F.when(F.col("route_id") % 4 == 0, F.col("minutes").cast("double"))
    own = build.own_plan_b(F.col("transfers"), p90, F.lit("measured"), F.col("reliability"), none, F.lit("H"), F.col("fare"))
    return net.routes().select("route_id", why.alias("why"), own.alias("plan_b"))


@query("""
SELECT route_id, CASE route_id % 4 WHEN 0 THEN '~' || CAST(minutes AS VARCHAR) || ' min late (typical) · ' || ot WHEN 1 THEN '~' || CAST(fare AS VARCHAR) || ' min late (avg) · ' || ot
    WHEN 2 THEN '~' || CAST(fare AS VARCHAR) || ' min late (est.) · ' || ot ELSE '~' || CAST(fare AS VARCHAR) || ' min late (avg) · ' || ot END AS line,
  CASE route_id % 4 WHEN 0 THEN 'Typical delay for your travel date — from a model trained on a year of real arrivals. On a bad day, expect up to ~' || CAST(minutes * 2 AS VARCHAR) || ' min. Based on 1,500 past arrivals. Model trained through 3 Jan 2025.'
    WHEN 2 THEN 'No historical record for this train yet — a rough estimate from its class, distance and number of stops.'
    ELSE 'Average from a full year of this train''s real arrivals. Based on 1,500 past arrivals.' END AS detail,
  CASE WHEN route_id % 3 = 0 THEN 'Multi-day journey — harder to predict, build in extra buffer.' END AS warning
FROM (SELECT *, CAST(reliability AS VARCHAR) || '% on-time' AS ot FROM v_routes)
""")
def delay_texts(net):
    k = F.col("route_id")
    source = F.when(k % 4 == 0, "predicted").when(k % 4 == 1, "measured").when(k % 4 == 2, "modelled").otherwise("seed")
    line = build.delay_line(source, F.col("minutes"), F.col("fare"), F.col("reliability"))
    detail = build.delay_detail(source, F.col("minutes") * 2, F.lit(1500), F.lit("high"), F.lit("2025-01-03"))
    return net.routes().select("route_id", line.alias("line"), detail.alias("detail"), build.delay_warning(k % 3 == 0).alias("warning"))


@query("""
SELECT corridor, known_hours, round(m / 60, 6) AS engine_hours, round((m / 60 - known_hours) / known_hours * 100, 6) AS deviation_pct,
  CASE WHEN m IS NULL THEN 'NO ROUTE' WHEN abs(round((m / 60 - known_hours) / known_hours * 100, 6)) <= 30 THEN 'OK' ELSE 'SUSPICIOUS' END AS verdict
FROM (SELECT c_custkey AS corridor, CAST(1 + c_custkey % 9 AS DOUBLE) AS known_hours FROM customer) LEFT JOIN (SELECT request_id, min(minutes) AS m FROM v_routes GROUP BY 1) ON request_id = corridor
""")
def corridor_benchmark(net):
    known = net.table("customer").select(F.col("c_custkey").alias("corridor"), (1.0 + F.col("c_custkey") % 9).alias("known_hours"))
    rows, _ = ranking.corridor_benchmark(net.routes().withColumnRenamed("request_id", "corridor"), known)
    return rows


@query("""
SELECT count(d) AS compared, round(avg(abs(d)), 6) AS mean_abs_pct, round(max(abs(d)), 6) AS worst_pct FROM (
  SELECT round((m / 60 - h) / h * 100, 6) AS d FROM (SELECT c_custkey AS corridor, CAST(1 + c_custkey % 9 AS DOUBLE) AS h FROM customer)
  LEFT JOIN (SELECT request_id, min(minutes) AS m FROM v_routes GROUP BY 1) ON request_id = corridor)
""")
def benchmark_summary(net):
    known = net.table("customer").select(F.col("c_custkey").alias("corridor"), (1.0 + F.col("c_custkey") % 9).alias("known_hours"))
    return ranking.corridor_benchmark(net.routes().withColumnRenamed("request_id", "corridor"), known)[1]


KNOWN = ", ".join(f"({i}, '{a}', '{b}', {h})" for i, (a, b, h) in enumerate(fixed.CORRIDOR_HOURS))


@query(f"""
SELECT corridor, from_name, to_name, CAST(known_hours AS DOUBLE) AS known_hours, m / 60 AS engine_hours, round((m / 60 - known_hours) / known_hours * 100, 6) AS deviation_pct
FROM (VALUES {KNOWN}) k(corridor, from_name, to_name, known_hours) LEFT JOIN (SELECT request_id % 10 AS c, CAST(min(minutes) AS DOUBLE) AS m FROM v_routes GROUP BY 1) ON c = corridor
""".replace("m / 60 AS engine_hours", "round(m / 60, 6) AS engine_hours"))
def known_corridors(net):
    """The fastest routes of ten groups of requests against the known hours of ten corridors."""
    rows = [(i, a, b, h) for i, (a, b, h) in enumerate(fixed.CORRIDOR_HOURS)]
    known = net.spark.createDataFrame(rows, "corridor int, from_name string, to_name string, known_hours double")
    routes = net.routes().withColumn("corridor", (F.col("request_id") % 10).cast("int"))
    found, _ = ranking.corridor_benchmark(routes, known.drop("from_name", "to_name"))
    return found.drop("verdict").join(known.select("corridor", "from_name", "to_name"), "corridor")


# --- map shapes ------------------------------------------------------------------------------------

VIEWS["v_path"] = """
SELECT train_number AS train, seq, station_code AS code, name, lng, lat FROM v_stops JOIN v_stations_raw ON station_code = code
"""


def drawn(net):
    """One route per train: a road leg to its first stop, the ride with its path, a change, a road leg on."""
    place = net.stations_raw().select(F.col("code").alias("station_code"), "name", "lng", "lat")
    rows = net.stops().join(place, "station_code")
    spot = F.struct("lng", "lat")
    path = F.array_sort(F.collect_list(F.struct("seq", "name", spot.alias("spot"))))
    t = rows.groupBy(F.col("train_number").alias("train")).agg(path.alias("p"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    none = F.lit(None).cast(build.SPOT)
    spots = F.transform("p", lambda x: x["spot"])

    def leg(mode, a, b, a_spot, b_spot, line):
        return F.struct(
            F.lit(mode).alias("mode"), a.alias("from_name"), b.alias("to_name"), a_spot.cast(build.SPOT).alias("from_spot"),
            b_spot.cast(build.SPOT).alias("to_spot"), line.cast(f"array<{build.SPOT}>").alias("path"),
        )

    no_path = F.lit(None).cast(f"array<{build.SPOT}>")
    start = F.struct((first["spot"]["lng"] - 1.0).alias("lng"), first["spot"]["lat"].alias("lat"))
    legs = F.array(
        leg("cab", F.lit("From"), first["name"], start, first["spot"], no_path),
        leg("connection", F.lit("x"), F.lit("y"), none, none, no_path),
        leg("train", first["name"], last["name"], first["spot"], last["spot"], spots),
        leg("cab", last["name"], F.lit("To"), last["spot"], none, no_path),
    )
    return t.select("train", legs.alias("legs"))


@query("""
SELECT train, CAST(2 + CASE WHEN f.lng = l.lng AND f.lat = l.lat THEN 0 ELSE 1 END AS INTEGER) AS stops, round(f.lng - 1.0, 6) AS first_lng,
  CAST(1 + drawn AS INTEGER) AS points, CAST(1 + CASE WHEN n >= 2 THEN 1 ELSE 0 END AS INTEGER) AS segments, round(CASE WHEN n >= 2 THEN m.lng END, 6) AS mid_lng
FROM (SELECT train, max(seq) AS n, sum(CASE WHEN plng IS NULL OR plng <> lng OR plat <> lat THEN 1 ELSE 0 END) AS drawn FROM (
        SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat FROM v_path WINDOW w AS (PARTITION BY train ORDER BY seq)) GROUP BY 1) t
JOIN v_path f USING (train) JOIN v_path l USING (train) JOIN v_path m USING (train)
WHERE f.seq = 1 AND l.seq = n AND m.seq = n // 2 + 1
""")
def map_shapes(net):
    r = drawn(net)
    mids = build.segment_midpoints(F.col("legs"))
    # the ride of a one-stop train has no length
    return r.withColumn("s", build.stop_points(F.col("legs"))).withColumn("l", build.line_points(F.col("legs"))).withColumn("m", mids).select(
        "train", F.size("s").alias("stops"), F.round(F.element_at("s", 1)["spot"]["lng"], 6).alias("first_lng"), F.size("l").alias("points"),
        F.size("m").alias("segments"),
        F.round(F.try_element_at(F.filter("m", lambda x: x["mode"] == "train"), F.lit(1))["mid"]["lng"], 6).alias("mid_lng"),
    )


@query("""
WITH legs AS (SELECT train, seq, lng AS x0, lat AS y0, lead(lng) OVER w AS x1, lead(lat) OVER w AS y1 FROM v_path WINDOW w AS (PARTITION BY train ORDER BY seq)),
len AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS d FROM legs WHERE x1 IS NOT NULL),
run AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY train ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(d) OVER (PARTITION BY train) AS total FROM len)
SELECT train, round(x0 + (CASE WHEN d = 0 THEN 0 ELSE (0.4 * total - before) / d END) * (x1 - x0), 4) AS lng, round(y0 + (CASE WHEN d = 0 THEN 0 ELSE (0.4 * total - before) / d END) * (y1 - y0), 4) AS lat
FROM run WHERE 0.4 * total <= before + d QUALIFY row_number() OVER (PARTITION BY train ORDER BY seq) = 1
""")
def points_along_paths(net):
    from wayframe.operators.journeys import point_along

    place = net.stations_raw().select(F.col("code").alias("station_code"), "lng", "lat")
    path = net.stops().join(place, "station_code").select(F.col("train_number").alias("train"), "seq", "lng", "lat")
    return point_along(path, ["train"], "seq", 0.4).select("train", F.round("lng", 4).alias("lng"), F.round("lat", 4).alias("lat"))


@query("""
SELECT route_id, CAST(CASE WHEN route_id % 2 = 0 THEN 18 ELSE 30 END + minutes + 5 AS INTEGER) AS minutes,
  CAST(CASE WHEN route_id % 2 = 0 THEN 36 ELSE 84 END + fare AS INTEGER) AS fare, CASE WHEN route_id % 2 = 0 THEN '~12 km road to B' ELSE '~28 km road to B' END AS note
FROM v_routes
""")
def measured_roads(net):
    k = F.col("route_id")
    spot = build.spot(F.lit(70.0) + k / 1000.0, F.lit(10.0))
    end = build.spot(F.lit(70.5) + k / 1000.0, F.lit(10.0))
    cab = build.cab_leg(F.lit("From"), F.lit("B"), F.lit(28.0), spot, end).withField("minutes", F.lit(30))
    train = build.train_leg(F.lit("T"), F.lit("x"), F.lit("B"), F.lit("A"), F.lit(600), F.lit(700), F.col("minutes"), F.col("fare"))
    legs = F.array(cab, build.road_note(F.lit(28.0), F.lit("B")), train)
    rows = net.routes().select(
        "route_id", legs.alias("legs"), F.lit(5).alias("wait"), (F.col("minutes") + 35).alias("minutes"), (F.col("fare") + 84).alias("fare"),
        F.lit("").alias("why"), F.lit(False).alias("road_only"),
    )
    roads = net.routes().filter(k % 2 == 0).select(
        F.lit(10.0).alias("from_lat"), (F.lit(70.0) + k / 1000.0).alias("from_lng"), F.lit(10.0).alias("to_lat"),
        (F.lit(70.5) + k / 1000.0).alias("to_lng"), F.lit(12.0).alias("km"), F.lit(18.2).alias("mins"),
    )
    out = build.upgrade_road_legs(build.upgrade_road_legs(rows, roads), roads)
    return out.select("route_id", "minutes", "fare", F.get("legs", F.lit(1))["note"].alias("note"))


