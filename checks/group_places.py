"""Queries for geography: nearest railheads, geocoding, suggestions, repair."""

from pyspark.sql import functions as F

from wayframe import fixed
from wayframe.functions import geo
from wayframe.operators import repair, stations as places

from .catalog import query
from .views import VIEWS, hav

VIEWS["v_near"] = f"""
SELECT p.id, s.code, s.num_trains, {hav('p.lat', 'p.lng', 's.lat', 's.lng')} AS km FROM v_places p, v_stations s WHERE s.num_trains > 0
"""


@query("SELECT id, code, round(km, 3) AS km FROM v_near WHERE km <= 250")
def stations_within(net):
    points = net.places().select("id", "lat", "lng")
    out = places.within_km(points, net.stations().select("code", "lat", "lng"), 250.0)
    return out.select(F.col("p_id").alias("id"), "code", F.round("km", 3).alias("km"))


@query("""
WITH near AS (SELECT id, code, km FROM v_near WHERE km <= 600 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, code) <= 6),
hub AS (SELECT id, code, km FROM v_near WHERE num_trains >= 610 AND km <= 300 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, code) <= 6),
tier AS (SELECT n.id, CASE WHEN max(CASE WHEN h.id IS NOT NULL THEN 1 ELSE 0 END) = 1 OR min(n.km) <= 100 THEN 100.0 WHEN min(n.km) <= 200 THEN 200.0 ELSE 600.0 END AS t
         FROM near n LEFT JOIN hub h ON n.id = h.id GROUP BY n.id)
SELECT u.id, code, round(min(km), 3) AS km, CAST(min(t) AS DOUBLE) AS tier_km FROM (
  SELECT n.id, code, km, 0 AS h FROM near n UNION ALL SELECT id, code, km, 1 FROM hub) u JOIN tier ON u.id = tier.id
WHERE h = 1 OR km <= t GROUP BY u.id, code
""")
def nearest_railheads(net):
    points = net.places().select("id", "lat", "lng")
    out = places.nearest_railheads(points, net.stations(), [100.0, 200.0, 600.0], hub_min=610, hub_km=300.0)
    return out.select("id", "code", F.round("km", 3).alias("km"), "tier_km")


VIEWS["v_geocoded"] = f"""
SELECT place, arg_min(name, o) AS name, arg_min(lat, o) AS lat, arg_min(lng, o) AS lng, 'city' AS source FROM (
  SELECT *, (CASE WHEN EXISTS (SELECT 1 FROM v_stations s WHERE s.num_trains > 0 AND contains(upper(s.name), upper(bare))
       AND {hav('c.lat', 'c.lng', 's.lat', 's.lng')} <= 150) THEN 0 ELSE 1 END) * 100 + pop_rank AS o
  FROM (SELECT *, max(fits) OVER (PARTITION BY place) AS any_fit FROM (
    SELECT t.place, t.bare, k.*, CASE WHEN hint IS NOT NULL AND starts_with(lower(k.state), hint) THEN 1 ELSE 0 END AS fits
    FROM (SELECT DISTINCT place, split_part(place, ', ', 1) AS bare, nullif(lower(split_part(place, ', ', 2)), '') AS hint FROM (
            SELECT from_place AS place FROM v_requests UNION ALL SELECT to_place || ', NATION_' || CAST(request_id % 25 AS VARCHAR) FROM v_requests
            UNION ALL SELECT 'CITY_' || CAST(request_id % 400 AS VARCHAR) || ' j' FROM v_requests)) t
    JOIN (SELECT *, row_number() OVER (PARTITION BY name ORDER BY population DESC, id) AS pop_rank FROM v_places) k
      ON lower(k.name) = lower(t.bare) AND pop_rank <= 5)) c WHERE any_fit = 0 OR fits = 1)
GROUP BY place
"""


@query("""
SELECT place, name, round(lat, 6) AS lat, round(lng, 6) AS lng, source FROM v_geocoded UNION ALL
SELECT p.place, arg_min(name, o), round(arg_min(lat, o), 6), round(arg_min(lng, o), 6), 'station' FROM (
  SELECT DISTINCT 'CITY_' || CAST(request_id % 400 AS VARCHAR) || ' j' AS place FROM v_requests) p
JOIN (SELECT *, (-num_trains, code) AS o FROM v_stations WHERE num_trains > 0) s ON contains(lower(s.name), lower(p.place))
GROUP BY p.place
""")
def geocoded_places(net):
    r = net.requests()
    texts = r.select(F.col("from_place").alias("place")).unionByName(
        r.select(F.concat("to_place", F.lit(", NATION_"), (F.col("request_id") % 25).cast("string")).alias("place"))
    ).unionByName(
        r.select(F.concat(F.lit("CITY_"), (F.col("request_id") % 400).cast("string"), F.lit(" j")).alias("place"))
    )
    out = places.geocode(texts, net.places(), net.stations(), F.col("state"), near_km=150.0)
    return out.select("place", "name", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "source")


QUERIES_SQL = "SELECT DISTINCT lower(left('CITY_' || CAST(c_custkey % 400 AS VARCHAR), CAST(4 + c_custkey % 4 AS BIGINT))) AS query FROM customer"


def typed(net):
    k = F.col("c_custkey")
    text = F.left(F.concat(F.lit("CITY_"), (k % 400).cast("string")), (4 + k % 4).cast("int"))
    return net.table("customer").select(text.alias("query"))


@query(f"""
SELECT query, CAST(position AS INTEGER) AS position, name FROM (
  SELECT query, name, row_number() OVER (PARTITION BY query ORDER BY c, n, code) AS position FROM (
    SELECT query, s.name, s.code, CASE WHEN starts_with(lower(s.name), query) THEN 0 ELSE 1 END AS c, -s.num_trains AS n
    FROM ({QUERIES_SQL}) JOIN v_stations s ON contains(lower(s.name), query) AND s.num_trains > 0
    QUALIFY row_number() OVER (PARTITION BY query, lower(s.name) ORDER BY c, n, code) = 1)) WHERE position <= 5
""")
def station_suggestions(net):
    return places.station_suggestions(typed(net), net.stations())


@query(f"""
SELECT query, arg_min(code, o) AS code, arg_min(name, o) AS name FROM (
  SELECT query, s.code, s.name, (CASE WHEN lower(s.name) = query THEN 0 WHEN starts_with(lower(s.name), query) THEN 1 ELSE 2 END, -s.num_trains, s.code) AS o
  FROM (SELECT query FROM ({QUERIES_SQL}) UNION SELECT lower(name) FROM v_stations UNION SELECT '_' || CAST(c_custkey % 400 AS VARCHAR) FROM customer)
  JOIN v_stations s ON contains(lower(s.name), query) AND s.num_trains > 0) GROUP BY query
""")
def station_geocode(net):
    k = F.col("c_custkey")
    asked = typed(net).unionByName(net.stations_raw().select(F.col("name").alias("query"))).unionByName(
        net.table("customer").select(F.concat(F.lit("_"), (k % 400).cast("string")).alias("query"))
    )
    return places.station_geocode(asked, net.stations()).select("query", "code", "name")


GRAMS = """
list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))
"""


@query(f"""
WITH q AS (SELECT query, {GRAMS.format(c='query')} AS g FROM ({QUERIES_SQL})),
names AS (SELECT low, {GRAMS.format(c='low')} AS g FROM (SELECT DISTINCT lower(name) AS low FROM v_places)),
sim AS (SELECT query, low, shared / (a + b - shared) AS s FROM (SELECT query, low, len(list_intersect(q.g, names.g)) AS shared, len(q.g) AS a, len(names.g) AS b FROM q, names)
        WHERE shared / (a + b - shared) > 0.45),
s1 AS (SELECT query, 1 AS stage, row_number() OVER (PARTITION BY query ORDER BY population DESC, id) AS r, name, state FROM q JOIN v_places ON starts_with(lower(name), query) QUALIFY r <= 10),
s2 AS (SELECT query, 2 AS stage, row_number() OVER (PARTITION BY query ORDER BY s DESC, population DESC, id) AS r, name, state FROM sim JOIN v_places ON lower(name) = low QUALIFY r <= 6),
s3 AS (SELECT query, 3 AS stage, row_number() OVER (PARTITION BY query ORDER BY num_trains DESC, code) AS r, name, state FROM q JOIN v_stations ON starts_with(lower(name), query) AND num_trains > 0 QUALIFY r <= 6),
a AS (SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) QUALIFY row_number() OVER (PARTITION BY query, lower(name), state ORDER BY stage, r) = 1),
n AS (SELECT *, count(*) FILTER (stage = 1) OVER w AS n1, count(*) FILTER (stage <= 2) OVER w AS n2 FROM a WINDOW w AS (PARTITION BY query))
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY stage, r) AS INTEGER) AS position, name, state FROM n
WHERE stage = 1 OR (stage = 2 AND n1 < 8) OR (stage = 3 AND n1 < 8 AND n2 < 8) QUALIFY position <= 8
""")
def place_suggestions(net):
    return places.suggest_places(typed(net), net.places(), net.stations())


@query(f"""
SELECT p.name, round(p.lat, 6) AS lat, round(p.lng, 6) AS lng FROM (SELECT DISTINCT name, lat, lng FROM v_places) p WHERE EXISTS (
  SELECT 1 FROM v_stations s WHERE s.num_trains > 0 AND contains(s.name, p.name) AND {hav('p.lat', 'p.lng', 's.lat', 's.lng')} <= 300)
""")
def places_with_named_station(net):
    tokens = net.places().select(F.col("name").alias("token"), "lat", "lng")
    out = places.has_named_station(tokens, net.stations(), 300.0)
    return out.select(F.col("token").alias("name"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("""
SELECT p.id, p.name, round(coalesce(a.lat, b.lat), 6) AS lat FROM (SELECT id, name || CASE id % 2 WHEN 0 THEN ' (KSR)' ELSE '' END AS name FROM v_places) p
LEFT JOIN (SELECT name, min(lat) AS lat FROM v_places GROUP BY name) a ON a.name = p.name
LEFT JOIN (SELECT name, min(lat) AS lat FROM v_places GROUP BY name) b ON b.name = replace(p.name, ' (KSR)', '')
""")
def coordinates_by_name(net):
    from wayframe.operators.stations import coordinates_by_name as find

    known = net.places().groupBy("name").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    asked = net.places().select("id", F.when(F.col("id") % 2 == 0, F.concat("name", F.lit(" (KSR)"))).otherwise(F.col("name")).alias("name"))
    return find(asked, known).select("id", "name", F.round("lat", 6).alias("lat"))


@query(f"""
SELECT p.id, s.code, {hav('b.lat', 'b.lng', 'p.lat', 'p.lng')} > {hav('s.lat', 's.lng', 'p.lat', 'p.lng')} + 5
  AND {hav('s.lat', 's.lng', 'o.lat', 'o.lng')} > {hav('b.lat', 'b.lng', 'o.lat', 'o.lng')} - 5 AS useful
FROM v_places p JOIN v_stations s ON s.code = 'S' || CAST(p.id % 50 AS VARCHAR) JOIN v_stations b ON b.code = 'S' || CAST((p.id + 7) % 50 AS VARCHAR)
JOIN v_places o ON o.id = (p.id * 3 + 1) % 1500
""")
def useful_rides(net):
    from wayframe.operators.journeys import useful

    k = F.col("id")
    p = net.places().select(
        "id", F.col("lat").alias("d_lat"), F.col("lng").alias("d_lng"), F.concat(F.lit("S"), (k % 50).cast("string")).alias("code"),
        F.concat(F.lit("S"), ((k + 7) % 50).cast("string")).alias("board"), ((k * 3 + 1) % 1500).alias("oid"),
    )
    s = net.stations_raw()
    a = s.select("code", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"))
    b = s.select(F.col("code").alias("board"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))
    o = net.places().select(F.col("id").alias("oid"), F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"))
    rows = p.join(a, "code").join(b, "board").join(o, "oid")
    cols = [F.col(c) for c in ("b_lat", "b_lng", "a_lat", "a_lng", "o_lat", "o_lng", "d_lat", "d_lng")]
    return rows.select("id", "code", useful(*cols).alias("useful"))


# --- repair ----------------------------------------------------------------------------------------
# Every 25th station has a twin of the same name five degrees north, and the timetable names the twin.

VIEWS["v_bad_stations"] = """
SELECT code, name, lat, lng FROM v_stations_raw UNION ALL
SELECT 'B' || code, name, lat + 5.0, lng FROM v_stations_raw WHERE CAST(substr(code, 2) AS BIGINT) % 25 = 7
"""
VIEWS["v_bad_stops"] = """
SELECT train_number, seq, CASE WHEN CAST(substr(station_code, 2) AS BIGINT) % 25 = 7 THEN 'B' || station_code ELSE station_code END AS station_code FROM v_stops
"""
VIEWS["v_mids"] = """
SELECT code, (plat + nlat) / 2 AS lat, (plng + nlng) / 2 AS lng, slat, slng FROM (
  SELECT station_code AS code, b.lat AS slat, b.lng AS slng, lag(b.lat) OVER w AS plat, lag(b.lng) OVER w AS plng, lead(b.lat) OVER w AS nlat, lead(b.lng) OVER w AS nlng
  FROM v_bad_stops JOIN v_bad_stations b ON station_code = b.code WINDOW w AS (PARTITION BY train_number ORDER BY seq)) WHERE plat IS NOT NULL AND nlat IS NOT NULL
"""
VIEWS["v_flagged"] = f"""
SELECT code, exp_lat, exp_lng, CAST(round_even(off, 0) AS INTEGER) AS off_km, far AS far_share, trains FROM (
  SELECT code, exp_lat, exp_lng, {hav('slat', 'slng', 'exp_lat', 'exp_lng')} AS off, far, trains FROM (
    SELECT code, list_sort(list(lat))[count(*) // 2 + 1] AS exp_lat, list_sort(list(lng))[count(*) // 2 + 1] AS exp_lng, min(slat) AS slat, min(slng) AS slng,
      avg(CASE WHEN {hav('slat', 'slng', 'lat', 'lng')} > 300 THEN 1.0 ELSE 0.0 END) AS far, count(*) AS trains FROM v_mids GROUP BY code HAVING count(*) >= 3))
WHERE off > 300 AND far >= 0.6
"""
VIEWS["v_remap"] = f"""
SELECT bad_code, good_code, good_name, trains, off_km, round_even(km, 1) AS match_km FROM (
  SELECT f.code AS bad_code, g.code AS good_code, g.name AS good_name, trains, off_km, {hav('exp_lat', 'exp_lng', 'g.lat', 'g.lng')} AS km
  FROM v_flagged f JOIN v_bad_stations s ON s.code = f.code JOIN v_bad_stations g ON g.code <> f.code AND g.name = s.name)
WHERE km <= 1500 QUALIFY row_number() OVER (PARTITION BY bad_code ORDER BY km, good_code) = 1
"""


def bad_network(net):
    raw = net.stations_raw().select("code", "name", "lat", "lng")
    odd = F.substring("code", 2, 20).cast("bigint") % 25 == 7
    twins = raw.filter(odd).select(F.concat(F.lit("B"), "code").alias("code"), "name", (F.col("lat") + 5.0).alias("lat"), "lng")
    odd_stop = F.substring("station_code", 2, 20).cast("bigint") % 25 == 7
    stops = net.stops().withColumn("station_code", F.when(odd_stop, F.concat(F.lit("B"), "station_code")).otherwise(F.col("station_code")))
    return stops, raw.unionByName(twins)


def flagged(net):
    stops, stations = bad_network(net)
    return repair.mislocated(stops, stations, outlier_km=300.0)


@query("SELECT code, round(lat, 6) AS lat, round(lng, 6) AS lng FROM v_mids")
def neighbour_midpoints(net):
    stops, stations = bad_network(net)
    return repair.neighbour_midpoints(stops, stations).select("code", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("SELECT code, round(exp_lat, 6) AS exp_lat, round(exp_lng, 6) AS exp_lng, off_km, round(far_share, 6) AS far_share, trains FROM v_flagged")
def mislocated_stations(net):
    return flagged(net).select(
        "code", F.round("exp_lat", 6).alias("exp_lat"), F.round("exp_lng", 6).alias("exp_lng"), "off_km", F.round("far_share", 6).alias("far_share"), "trains"
    )


@query("SELECT bad_code, good_code, good_name, trains, off_km, match_km FROM v_remap")
def station_remaps(net):
    _, stations = bad_network(net)
    out = repair.propose_remap(flagged(net), stations, max_km=1500.0)
    return out.select("bad_code", "good_code", "good_name", "trains", "off_km", "match_km")


@query("SELECT code, trains FROM v_flagged WHERE code NOT IN (SELECT bad_code FROM v_remap)")
def unfixed_stations(net):
    _, stations = bad_network(net)
    bad = flagged(net)
    return repair.unfixed(bad, repair.propose_remap(bad, stations, max_km=1500.0)).select("code", "trains")


@query("""
WITH moved AS (SELECT train_number, coalesce(good_code, station_code) AS station_code FROM v_bad_stops LEFT JOIN v_remap ON station_code = bad_code)
SELECT b.code, CAST(coalesce(n, 0) AS INTEGER) AS num_trains FROM v_bad_stations b
LEFT JOIN (SELECT station_code, count(DISTINCT train_number) AS n FROM moved GROUP BY 1) c ON c.station_code = b.code
""")
def repaired_counts(net):
    stops, stations = bad_network(net)
    remap = repair.propose_remap(flagged(net), stations, max_km=1500.0)
    _, counted = repair.apply_remap(stops, stations, remap)
    return counted.select("code", "num_trains")


@query("""
SELECT id, CAST(floor(lat / 0.5) AS INTEGER) AS cell_lat, CAST(floor(lng / 0.5) AS INTEGER) AS cell_lng FROM v_places
""")
def grid_cells(net):
    return net.places().select("id", geo.cell(F.col("lat"), 0.5).alias("cell_lat"), geo.cell(F.col("lng"), 0.5).alias("cell_lng"))


# cities with the codes of their states, which the library's own table turns into names
CODES = sorted(fixed.STATE_BY_ADMIN)
_CODE_LIST, _STATE_LIST = ("[" + ", ".join("'{}'".format(x.replace("'", "''")) for x in xs) + "]" for xs in (CODES, [fixed.STATE_BY_ADMIN[c] for c in CODES]))
VIEWS["v_aplaces"] = f"SELECT * REPLACE ({_STATE_LIST}[CAST(id % {len(CODES)} + 1 AS INTEGER)] AS state) FROM v_places"
VIEWS["v_ageocoded"] = VIEWS["v_geocoded"].replace("v_places", "v_aplaces").replace(
    "to_place || ', NATION_' || CAST(request_id % 25 AS VARCHAR)", f"to_place || ', ' || {_STATE_LIST}[CAST(request_id % {len(CODES)} + 1 AS INTEGER)]")


@query("SELECT place, name, round(lat, 6) AS lat, round(lng, 6) AS lng, source FROM v_ageocoded WHERE place NOT LIKE '% j'")
def places_by_admin_code(net):
    """Places held to the state whose code their city has."""
    def at(values, k):
        return F.element_at(F.array(*map(F.lit, values)), (k % len(CODES) + 1).cast("int"))

    r = net.requests()
    states = [fixed.STATE_BY_ADMIN[c] for c in CODES]
    texts = r.select(F.col("from_place").alias("place")).unionByName(r.select(F.concat("to_place", F.lit(", "), at(states, F.col("request_id"))).alias("place")))
    cities = net.places().drop("state").withColumn("admin1", at(CODES, F.col("id")))
    out = places.geocode(texts, cities, net.stations(), near_km=150.0)
    return out.select("place", "name", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "source")
