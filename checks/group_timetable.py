"""Queries for scans, name matching and the timetable build."""

from pyspark.sql import functions as F

from wayframe import fixed
from wayframe.functions import text
from wayframe.operators import naming, timetable
from wayframe.sources import files, sinks

from .catalog import query
from .views import clock, hav

# --- scans ----------------------------------------------------------------------------------------


@query("""
SELECT coalesce(nullif(ltrim(train_raw, '0'), ''), train_raw) AS train_no, CAST(obs_date AS VARCHAR) AS obs_date, station_no,
  CASE WHEN trunc(delay) BETWEEN -120 AND 1440 THEN CAST(trunc(delay) AS INTEGER) END AS delay_min
FROM v_obs_raw WHERE event_id % 10 <> 0
""")
def delay_dump_scan(net):
    from wayframe.operators.delays import clean_observations

    rows = net.observations_raw()
    name = F.when(F.col("event_id") % 10 == 0, "A,B").otherwise("A")
    delay = F.when((F.col("delay") == "") & (F.col("event_id") % 2 == 0), "None").otherwise(F.col("delay"))
    line = F.concat_ws(",", F.col("obs_date").cast("string"), F.col("station_no").cast("string"), name, delay, "train_no")
    return clean_observations(files.parse_delay_lines(rows.select(line.alias("value"))))


@query(f"""
SELECT train_number, CAST(seq - 1 AS INTEGER) AS pos, name AS raw_name, {clock('arr_min')} AS arrival, {clock('dep_min')} AS departure, arr_min, dep_min
FROM v_stops JOIN v_stations_raw ON station_code = code
""")
def blob_stops(net):
    return files.explode_stop_blob(net.blob())


@query(f"""
SELECT train_number, CAST(seq - 1 AS INTEGER) AS pos, station_code AS code, 'Stop ' || station_code AS raw_name, {clock('arr_min')} AS arrival,
  {clock('dep_min')} AS departure, day, cum_km FROM v_stops WHERE train_number IN (SELECT train_number FROM v_stops WHERE seq = 2)
  AND CAST(train_number AS BIGINT) % 19 <> 0
""")
def list_stops(net):
    q = F.lit("'")

    def pair(key, value):
        return F.concat(q, F.lit(key), F.lit("': "), value)

    def quoted(c):
        return F.when(c.isNull(), F.lit("None")).otherwise(F.concat(q, c, q))

    entry = F.concat(
        F.lit("{"), F.concat_ws(
            ", ", pair("stationCode", quoted(F.lower("station_code"))), pair("stationName", quoted(F.concat(F.lit("Stop "), "station_code"))),
            pair("arrivalTime", quoted(text.minutes_clock(F.col("arr_min")))), pair("departureTime", quoted(text.minutes_clock(F.col("dep_min")))),
            pair("dayCount", quoted(F.col("day").cast("string"))), pair("distance", quoted(F.col("cum_km").cast("string"))),
        ), F.lit("}"),
    )
    rows = net.stops().select("train_number", "seq", entry.alias("e")).groupBy("train_number").agg(
        F.array_sort(F.collect_list(F.struct("seq", "e"))).alias("l")
    )
    cell = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["e"]), ", "), F.lit("]"))
    broken = F.col("train_number").cast("bigint") % 19 == 0
    cells = rows.select(
        F.concat(F.lit(" "), "train_number").alias("trainNumber"), F.when(broken, F.lit("[{'stationCode': ")).otherwise(cell).alias("stationList")
    )
    return files.explode_stop_list(cells)


@query("""
SELECT coalesce(nullif(ltrim(train_number, '0'), ''), train_number) AS train_number, seq AS station_no, station_code, cum_km, day FROM v_stops
""")
def coded_schedule_rows(net):
    from wayframe.functions.text import minutes_clock

    s = net.stops()
    number = F.when(F.col("seq") % 3 == 0, "x").otherwise(F.col("seq").cast("string"))
    rows = s.select(
        F.col("train_number").alias("train_no"), number.alias("station_no"), F.lower("station_code").alias("station_name"),
        F.col("cum_km").cast("string").alias("distance_from_origin"), F.col("day").cast("string").alias("arrival_day"),
        minutes_clock(F.col("arr_min")).alias("arrival_time"), minutes_clock(F.col("dep_min")).alias("departure_time"),
        F.col("seq").alias("line_no"),
    )
    return files.coded_schedule(rows).select("train_number", "station_no", "station_code", "cum_km", "day")


@query("""
SELECT c.id, c.name, r.route_id, r.fare FROM (SELECT n_nationkey AS id, n_name AS name FROM nation) c
LEFT JOIN (SELECT o_orderkey AS route_id, CAST(c_nationkey AS INTEGER) AS corridor, CAST(round_even(o_totalprice / 100, 0) AS INTEGER) AS fare
           FROM orders JOIN customer ON o_custkey = c_custkey) r ON r.corridor = c.id
""")
def corridor_with_routes(net):
    from wayframe.plans.corridors import corridor_routes

    corridors = net.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    home = net.table("customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("corridor"))
    routes = net.routes().join(home, "request_id").select("corridor", "route_id", "fare")
    return corridor_routes(corridors, routes)


@query("""
SELECT c_custkey, (SELECT min(n_nationkey) FROM nation t WHERE contains(lower(t.n_name), f) AND contains(lower('to ' || t.n_name), g)) AS corridor
FROM (SELECT c_custkey, 'ation_' || CAST(c_custkey % 30 AS VARCHAR) AS f, 'nation_' || CAST(c_custkey % 3 AS VARCHAR) AS g FROM customer)
""")
def corridor_match(net):
    from wayframe.plans.corridors import match_corridors

    corridors = net.table("nation").select(
        F.col("n_nationkey").alias("corridor"), F.col("n_name").alias("from_name"), F.concat(F.lit("to "), "n_name").alias("to_name")
    )
    k = F.col("c_custkey")
    asked = net.table("customer").select(
        "c_custkey", F.concat(F.lit("ATION_"), (k % 30).cast("string")).alias("from_query"),
        F.concat(F.lit("Nation_"), (k % 3).cast("string")).alias("to_query"),
    )
    return match_corridors(asked, corridors, "c_custkey")


# --- names ----------------------------------------------------------------------------------------

REFS = """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'RL ' || p_name WHEN 2 THEN p_name || ' JN'
  WHEN 3 THEN 'new(' || upper(p_name) WHEN 4 THEN left(p_name, 8)
  WHEN 5 THEN CASE WHEN p_partkey % 4 = 1 THEN 'halt ' || CAST(p_partkey % 40 AS VARCHAR) ELSE replace(p_name, ' ', '') || 'terminal.' END END AS raw FROM part
"""
NORM = "trim(regexp_replace(regexp_replace(upper({c}), '[^A-Z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
DICT = f"SELECT {NORM.format(c='p_name')} AS name, 'P' || CAST(min(p_partkey) AS VARCHAR) AS code FROM part GROUP BY 1"


def refs(net):
    k, n = F.col("p_partkey"), F.col("p_name")
    raw = (
        F.when(k % 6 == 0, n).when(k % 6 == 1, F.concat(F.lit("RL "), n)).when(k % 6 == 2, F.concat(n, F.lit(" JN")))
        .when(k % 6 == 3, F.concat(F.lit("new("), F.upper(n))).when(k % 6 == 4, F.left(n, F.lit(8)))
        .when(k % 4 == 1, F.concat(F.lit("halt "), (k % 40).cast("string")))
        .otherwise(F.concat(F.replace(n, F.lit(" "), F.lit("")), F.lit("terminal.")))
    )
    return net.table("part").select("p_partkey", raw.alias("raw_name"))


def dictionary(net):
    part = net.table("part")
    first = part.select(F.col("p_name").alias("name"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_partkey").alias("pos"))
    second = part.select(F.upper("p_name").alias("name"), F.lit("ZZ").alias("code"), F.lit(0).alias("pos"))
    return naming.name_dictionary([first, second])


MATCHED = f"""
dict AS ({DICT}), tight AS (SELECT replace(name, ' ', '') AS key, code FROM dict), ref AS (SELECT DISTINCT raw FROM ({REFS})),
b0 AS (SELECT raw, [{NORM.format(c='raw')}] || CASE WHEN contains(raw, '(') THEN list_transform(list_filter(string_split(raw, '('),
    lambda p: trim(p) <> ''), lambda p: {NORM.format(c='p')}) ELSE [] END AS l FROM ref),
b1 AS (SELECT raw, l || list_transform(list_filter(l, lambda b: starts_with(b, 'RL ')), lambda b: b[4:]) AS l FROM b0),
b2 AS (SELECT raw, unnest(l) AS b, generate_subscripts(l, 1) AS bi FROM b1),
v0 AS (SELECT raw, bi, [b] || CASE WHEN ends_with(b, ' JN') THEN [left(b, length(b) - 3), left(b, length(b) - 3) || ' JUNCTION']
    WHEN ends_with(b, ' JUNCTION') THEN [left(b, length(b) - 9), left(b, length(b) - 9) || ' JN'] ELSE [b || ' JN'] END AS l FROM b2),
v AS (SELECT raw, bi, unnest(l) AS t, generate_subscripts(l, 1) AS vi FROM v0),
keys AS (SELECT DISTINCT replace(t, ' ', '') AS q FROM v),
fz AS (SELECT q, min(code) AS code FROM (
    SELECT q, code FROM keys, tight WHERE length(q) >= 6 AND starts_with(key, q)
    UNION ALL SELECT q, arg_max(code, length(key)) FROM keys, tight WHERE length(key) >= 6 AND starts_with(q, key) GROUP BY q)
  GROUP BY q HAVING count(DISTINCT code) = 1),
hit AS (SELECT v.raw, bi, vi, coalesce(d.code, s.code, f.code) AS code, CASE WHEN d.code IS NOT NULL THEN 'exact'
    WHEN s.code IS NOT NULL THEN 'spaceless' WHEN f.code IS NOT NULL THEN 'prefix' END AS method
  FROM v LEFT JOIN dict d ON d.name = v.t LEFT JOIN tight s ON s.key = replace(v.t, ' ', '') LEFT JOIN fz f ON f.q = replace(v.t, ' ', '')),
best AS (SELECT raw, code, method FROM hit WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY raw ORDER BY bi, vi) = 1),
matched AS (SELECT p_partkey, r.raw AS raw_name, code, method FROM ({REFS}) r LEFT JOIN best USING (raw))
"""


@query(DICT)
def name_dictionary(net):
    return dictionary(net)


@query(f"WITH {MATCHED} SELECT p_partkey, raw_name, code, method FROM matched")
def station_matching(net):
    return naming.match_stations(refs(net), dictionary(net))


@query(f"""WITH {MATCHED} SELECT count(*) AS refs, count(*) FILTER (code IS NULL) AS unmatched,
  round(100.0 * count(*) FILTER (code IS NULL) / greatest(count(*), 1), 1) AS unmatched_pct FROM matched""")
def match_coverage(net):
    return timetable.match_report(naming.match_stations(refs(net), dictionary(net)))[0]


@query(f"""WITH {MATCHED} SELECT raw_name, count(*) AS n FROM matched WHERE code IS NULL GROUP BY 1 ORDER BY n DESC, raw_name LIMIT 10""")
def worst_unmatched_names(net):
    return timetable.match_report(naming.match_stations(refs(net), dictionary(net)))[1]


RENAMES = ", ".join(f"('{a}', '{b}')" for a, b in fixed.CODE_RENAMES.items())


@query(f"""
SELECT p_partkey, coalesce(r.b, s.code) AS code FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'PRYJ' WHEN 1 THEN 'DDU' ELSE 'NDLS' END AS code FROM part) s
LEFT JOIN (VALUES {RENAMES}) r(a, b) ON r.a = s.code
""")
def renamed_codes(net):
    k = F.col("p_partkey")
    code = F.when(k % 3 == 0, "PRYJ").when(k % 3 == 1, "DDU").otherwise("NDLS")
    return net.table("part").select("p_partkey", naming.fix_code(code).alias("code"))


@query("""
SELECT query, name, starts_with(lower(name), query) AS at_start, lower(name) = query AS whole
FROM (SELECT DISTINCT lower(left(p_name, CAST(2 + p_partkey % 5 AS BIGINT))) AS query FROM part), (SELECT DISTINCT p_name AS name FROM part)
WHERE contains(lower(name), query)
""")
def substring_search(net):
    part = net.table("part")
    q = part.select(F.lower(F.left("p_name", (2 + F.col("p_partkey") % 5).cast("int"))).alias("query"))
    return naming.substring_matches(q, part.select(F.col("p_name").alias("name")))


# --- timetable ------------------------------------------------------------------------------------


@query("""
SELECT train_number, station_code, old_seq, CAST(row_number() OVER (PARTITION BY train_number ORDER BY old_seq) AS INTEGER) AS seq
FROM (SELECT train_number, station_code, seq AS old_seq, count(*) OVER (PARTITION BY train_number) AS n FROM v_stops
      WHERE station_code NOT IN (SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 1000)) WHERE n >= 2
""")
def stop_numbering(net):
    unknown = net.table("supplier").filter(F.col("s_acctbal") < 1000).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("station_code"))
    rows = net.stops().select("train_number", "station_code", F.col("seq").alias("old_seq")).join(unknown, "station_code", "left_anti")
    return timetable.assign_seq(rows, "old_seq")


@query("""
SELECT train_number, seq, day FROM v_stops WHERE train_number IN (SELECT train_number FROM v_stops WHERE seq = 2)
""")
def day_rollover(net):
    rows = timetable.assign_seq(net.stops().drop("day").withColumnRenamed("seq", "pos"))
    return timetable.infer_day(rows).select("train_number", "seq", "day")


@query("""
SELECT number, CASE WHEN kind <> 'EXP' THEN 'fresh' ELSE 'older' END AS source FROM v_trains
""")
def gap_fill(net):
    fresh = net.trains().filter(F.col("kind") != "EXP").select("number", F.lit("fresh").alias("source"))
    trains = net.trains().select("number")
    return timetable.gap_fill(fresh, trains.withColumn("source", F.lit("older")))


@query("""
SELECT station_code, train_number, CAST(row_number() OVER (PARTITION BY train_number ORDER BY s) AS INTEGER) AS seq
FROM (SELECT st.station_code, st.train_number, st.seq AS s, count(*) OVER (PARTITION BY train_number) AS n FROM v_stops st
      WHERE CAST(substr(station_code, 2) AS BIGINT) % 13 <> 0 AND train_number NOT IN (SELECT number FROM v_trains WHERE kind = 'EXP')) WHERE n >= 2
""")
def placeable_new_trains(net):
    known = net.trains().filter(F.col("kind") == "EXP").select(F.col("number").alias("train_number"))
    new = net.stops().select("train_number", "station_code", "seq").join(known, "train_number", "left_anti")
    return timetable.placeable_stops(new, some_unplaced(net)).select("station_code", "train_number", "seq")


def some_unplaced(net):
    """Stations of which a few have no coordinates."""
    gone = F.substring("code", 2, 20).cast("bigint") % 13 == 0
    return net.stations_raw().withColumn("lat", F.when(~gone, F.col("lat"))).withColumn("lng", F.when(~gone, F.col("lng")))


@query("""
SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) AS low, max(id) AS high FROM (
  SELECT (SELECT max(l_orderkey) FROM lineitem) + row_number() OVER () AS id FROM v_stops)
""")
def appended_ids(net):
    rows = net.stops()
    existing = net.table("lineitem").select(F.col("l_orderkey").alias("id"))
    out = timetable.append_with_ids(existing, rows, ["train_number", "seq"])
    return out.agg(F.count("id").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"))


@query("SELECT code, name, state, lat, lng, num_trains FROM v_stations")
def station_train_counts(net):
    return net.stations().select("code", "name", "state", "lat", "lng", "num_trains")


@query("SELECT train_number, max(cum_km) AS total_km, arg_max(cum_km, seq) AS distance_km FROM v_stops GROUP BY 1")
def route_lengths(net):
    return timetable.route_lengths(net.stops())


@query("""
SELECT (SELECT count(DISTINCT train_number) FROM v_stops) AS trains, (SELECT count(*) FROM v_stops) AS stops,
  (SELECT count(*) FROM v_stations) AS stations, (SELECT count(*) FROM v_stations WHERE num_trains >= 600) AS hubs
""")
def network_stats(net):
    out = timetable.network_stats(net.stops(), net.stations(), 600)
    return out.select("trains", "stops", "stations", "hubs")


@query("""
SELECT 'stations' AS table_name, count(*) AS n FROM supplier UNION ALL SELECT 'trains', count(*) FROM orders
UNION ALL SELECT 'stops', count(*) FROM lineitem UNION ALL SELECT 'cities', count(*) FROM customer
""")
def table_counts(net):
    return timetable.table_counts({
        "stations": net.table("supplier"), "trains": net.table("orders"), "stops": net.table("lineitem"), "cities": net.table("customer"),
    })


DETOUR = f"""
SELECT train_number, seq, station_code, CASE WHEN lat IS NULL OR plat IS NULL OR nlat IS NULL THEN 0.0
  ELSE {hav('plat', 'plng', 'lat', 'lng')} + {hav('lat', 'lng', 'nlat', 'nlng')} - {hav('plat', 'plng', 'nlat', 'nlng')} END AS detour_km
FROM (SELECT *, last_value(lat IGNORE NULLS) OVER b AS plat, last_value(lng IGNORE NULLS) OVER b AS plng,
             first_value(lat IGNORE NULLS) OVER f AS nlat, first_value(lng IGNORE NULLS) OVER f AS nlng
      FROM (SELECT train_number, seq, station_code, CASE WHEN substr(station_code, 2)::BIGINT % 13 <> 0 THEN lat END AS lat,
                   CASE WHEN substr(station_code, 2)::BIGINT % 13 <> 0 THEN lng END AS lng
            FROM v_stops JOIN v_stations_raw ON station_code = code)
      WINDOW b AS (PARTITION BY train_number ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             f AS (PARTITION BY train_number ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
"""


@query(f"SELECT train_number, seq, station_code, round(detour_km, 3) + 0.0 AS detour_km FROM ({DETOUR})")
def stop_detours(net):
    out = timetable.stop_detour(net.stops(), some_unplaced(net))
    return out.select("train_number", "seq", "station_code", (F.round("detour_km", 3) + 0.0).alias("detour_km"))


@query(f"""
SELECT train_number, arg_min(station_code, seq) || ' ' || coalesce({clock('arg_min(coalesce(dep_min, arr_min, -1), seq)')
  .replace('(lpad', 'CASE WHEN arg_min(coalesce(dep_min, arr_min, -1), seq) >= 0 THEN (lpad', 1)} END, '--:--')
  || ' → ' || arg_max(station_code, seq) || ' (' || CAST(count(*) AS VARCHAR) || ' halts)' AS summary FROM v_stops GROUP BY 1
""")
def train_summaries(net):
    return timetable.describe_trains(net.stops())


@query("""
SELECT number, stratum, CAST(row_number() OVER (PARTITION BY stratum ORDER BY md5(number || '#42'), number) AS INTEGER) AS pick FROM (
  SELECT number, CASE WHEN length(number) = 5 AND left(number, 2) IN ('12', '22') THEN 'premium/SF'
    WHEN length(number) = 5 AND left(number, 1) = '1' THEN 'mail/express' WHEN length(number) = 5 AND left(number, 1) = '5' THEN 'passenger'
    WHEN NOT (length(number) = 5 AND left(number, 1) IN ('1', '2', '5')) THEN 'other' END AS stratum
  FROM (SELECT CAST(o_orderkey * 7 % 90000 AS VARCHAR) AS number FROM orders)) WHERE stratum IS NOT NULL QUALIFY pick <= 5
""")
def audit_samples(net):
    trains = net.table("orders").select((F.col("o_orderkey") * 7 % 90000).cast("string").alias("number"))
    return timetable.audit_sample(trains)


@query("""
SELECT train_number, CAST(count(*) AS INTEGER) AS stations, string_agg(station_code || '=' || CAST(CAST(cum_km AS BIGINT) AS VARCHAR), '|' ORDER BY station_code) AS listed
FROM (SELECT train_number, station_code, arg_max(cum_km, seq) AS cum_km FROM v_stops GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 2
""")
def distance_maps(net):
    from wayframe.operators.journeys import station_distances

    maps = sinks.distance_maps(station_distances(net.stops()))
    entries = F.transform(F.array_sort(F.map_entries("stations")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint").cast("string")))
    return maps.select("train_number", F.size("stations").alias("stations"), F.array_join(entries, "|").alias("listed"))


@query("""
SELECT a.train_number, a.station_code AS start, b.station_code AS stop, abs(b.cum_km - a.cum_km) AS km
FROM (SELECT train_number, min(seq) AS s0, max(seq) AS s1 FROM v_stops GROUP BY 1 HAVING count(DISTINCT station_code) >= 2) t
JOIN v_stops f ON f.train_number = t.train_number AND f.seq = s0 JOIN v_stops l ON l.train_number = t.train_number AND l.seq = s1
JOIN (SELECT train_number, station_code, arg_max(cum_km, seq) AS cum_km FROM v_stops GROUP BY 1, 2) a ON a.train_number = t.train_number AND a.station_code = f.station_code
JOIN (SELECT train_number, station_code, arg_max(cum_km, seq) AS cum_km FROM v_stops GROUP BY 1, 2) b ON b.train_number = t.train_number AND b.station_code = l.station_code
""")
def map_distances(net):
    """Whole length of each train, looked up in its distance map."""
    from wayframe.operators.journeys import station_distances

    stops = net.stops()
    maps = sinks.distance_maps(station_distances(stops))
    ends = stops.groupBy("train_number").agg(F.min_by("station_code", "seq").alias("start"), F.max_by("station_code", "seq").alias("stop"))
    found = ends.join(maps, "train_number")
    return found.select("train_number", "start", "stop", sinks.map_km("stations", F.col("start"), F.col("stop")).alias("km"))


ALIASES = ", ".join(f"({i}, '{n}', '{fixed.CODE_RENAMES.get(c, c)}')" for i, (n, c) in enumerate(fixed.STATION_ALIASES.items()))


@query(f"""
SELECT p_partkey, name || '(' || CAST(p_partkey AS VARCHAR) AS raw_name, code, 'alias' AS method
FROM part JOIN (VALUES {ALIASES}) a(i, name, code) ON p_partkey % {len(fixed.STATION_ALIASES)} = i
""")
def aliased_stations(net):
    """Names that only the alias table knows, each with a bracket that says nothing."""
    names = F.array(*[F.lit(n) for n in fixed.STATION_ALIASES])
    part = net.table("part")
    raw = F.concat(F.element_at(names, (F.col("p_partkey") % len(fixed.STATION_ALIASES) + 1).cast("int")), F.lit("("), F.col("p_partkey").cast("string"))
    return naming.match_stations(part.select("p_partkey", raw.alias("raw_name")), dictionary(net).filter(F.col("code") != "ZZ"))


@query("""
SELECT number, split_part(name, ' ', 1) AS label, CASE kind WHEN 'RAJDHANI' THEN '1A,2A,3A' WHEN 'PASSENGER' THEN '2S' ELSE 'SL,3A,2A' END AS classes
FROM (SELECT coalesce(nullif(ltrim(number, '0'), ''), number) AS number, name, kind FROM v_trains)
""")
def train_dimension(net):
    code = F.when(F.col("kind") == "RAJDHANI", "RAJ").when(F.col("kind") == "PASSENGER", "PASS-1")
    return net.trains().select(
        text.norm_train_no(F.col("number")).alias("number"), F.split_part("name", F.lit(" "), F.lit(1)).alias("label"),
        text.guess_classes(code).alias("classes"),
    )


@query("""
SELECT train_number, seq, station_code, t.name AS train_name FROM v_stops LEFT JOIN (SELECT * FROM v_trains WHERE kind <> 'EXP') t ON number = train_number
""")
def stops_with_train_names(net):
    names = net.trains().filter(F.col("kind") != "EXP").select("number", "name")
    out = timetable.with_train_names(net.stops(), names)
    return out.select("train_number", "seq", "station_code", "train_name")


@query("""
SELECT train_number, seq, station_code FROM v_stops WHERE train_number IN (SELECT number FROM v_trains WHERE kind = 'EXP')
""")
def stops_of_added_trains(net):
    """Stops that come with gap-filling trains."""
    added = net.trains().filter(F.col("kind") == "EXP")
    return timetable.stops_of(net.stops(), added).select("train_number", "seq", "station_code")
