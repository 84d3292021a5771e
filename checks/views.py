"""SQL text for DuckDB: the network views on the supplied tables, put in front of a query as needed."""

from __future__ import annotations

import re


def hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """Great-circle km between two points given as SQL expressions."""
    return (
        f"(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) "
        f"* cos(radians({lat2})) * pow(sin(radians(({lng2}) - ({lng1})) / 2), 2)))))"
    )


def clock(m: str) -> str:
    return f"(lpad(CAST(({m}) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({m}) % 60 AS VARCHAR), 2, '0'))"


def rnd(x: str) -> str:
    """Half-even whole number."""
    return f"CAST(round_even({x}, 0) AS INTEGER)"


DAYS = "['MON','TUE','WED','THU','FRI','SAT','SUN']"

VIEWS: dict[str, str] = {}

VIEWS["v_stops"] = """
SELECT lpad(CAST(l_orderkey AS VARCHAR), 7, '0') AS train_number, 'S' || CAST(l_suppkey AS VARCHAR) AS station_code,
       CAST(seq AS INTEGER) AS seq,
       CASE WHEN seq = 1 THEN NULL ELSE CAST(a % 1440 AS INTEGER) END AS arr_min,
       CASE WHEN seq = n THEN NULL ELSE CAST((a + 3) % 1440 AS INTEGER) END AS dep_min,
       CAST((CASE WHEN seq = n THEN a ELSE a + 3 END) // 1440 + 1 AS INTEGER) AS day, CAST(km AS DOUBLE) AS cum_km
FROM (SELECT *, (l_orderkey * 17) % 1430 + CAST(sum(CASE WHEN seq = 1 THEN 0 ELSE 33 + l_partkey % 180 END)
                 OVER (PARTITION BY l_orderkey ORDER BY seq) AS BIGINT) AS a,
             CAST(sum(CASE WHEN seq = 1 THEN 0 ELSE 20 + l_partkey % 150 END)
                 OVER (PARTITION BY l_orderkey ORDER BY seq) AS BIGINT) AS km
      FROM (SELECT l_orderkey, l_suppkey, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS n,
                   row_number() OVER (PARTITION BY l_orderkey
                     ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_shipdate) AS seq
            FROM lineitem))
"""
VIEWS["v_stations_raw"] = """
SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS code, 'CITY_' || CAST(s_suppkey % 400 AS VARCHAR) || ' JN' AS name,
       n_name AS state, CAST(8.0 + (s_suppkey * 37 % 280) / 10.0 AS DOUBLE) AS lat,
       CAST(68.0 + (s_suppkey * 53 % 290) / 10.0 AS DOUBLE) AS lng
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
VIEWS["v_counts"] = "SELECT station_code, count(DISTINCT train_number) AS num_trains FROM v_stops GROUP BY station_code"
VIEWS["v_stations"] = """
SELECT s.*, CAST(coalesce(num_trains, 0) AS INTEGER) AS num_trains
FROM v_stations_raw s LEFT JOIN v_counts c ON s.code = c.station_code
"""
VIEWS["v_trains"] = f"""
SELECT lpad(CAST(k AS VARCHAR), 7, '0') AS number, 'T' || CAST(k AS VARCHAR) || ' ' || kind AS name, kind,
       string_split(class_text, ',') AS classes, class_text,
       CASE WHEN k % 50 <> 0 THEN list_filter({DAYS}, lambda d, i: (mask >> (i - 1)) & 1 = 1) END AS days,
       CASE WHEN k % 20 = 0 THEN [CAST(month(o_orderdate) AS INTEGER)] END AS months, CAST(o_orderdate AS DATE) AS first_day
FROM (SELECT o_orderkey AS k, CAST(o_orderkey % 127 + 1 AS INTEGER) AS mask, o_orderdate,
             CASE left(o_orderpriority, 1) WHEN '1' THEN 'RAJDHANI' WHEN '2' THEN 'SHATABDI' WHEN '3' THEN 'SF EXP'
                  WHEN '4' THEN 'EXP' ELSE 'PASSENGER' END AS kind,
             CASE o_orderstatus WHEN 'P' THEN 'SL,3A,2A' WHEN 'F' THEN '1A,2A,3A,SL' ELSE 'CC,2S,EC' END AS class_text
      FROM orders)
"""
VIEWS["v_obs_raw"] = """
SELECT event_id, lpad(CAST(user_id AS VARCHAR), 7, '0') AS train_raw,
       DATE '2024-01-01' + CAST(event_id % 365 AS INTEGER) AS obs_date, CAST(event_id % 5 + 1 AS INTEGER) AS station_no,
       CASE WHEN event_type = 'error' THEN NULL ELSE value - 20 END AS delay
FROM events
"""
VIEWS["v_obs"] = """
SELECT coalesce(nullif(ltrim(train_raw, '0'), ''), train_raw) AS train_no, obs_date, station_no,
       CASE WHEN trunc(delay) BETWEEN -120 AND 1440 THEN CAST(trunc(delay) AS INTEGER) END AS delay_min, event_id
FROM v_obs_raw
"""
VIEWS["v_delay_stats"] = """
SELECT train_no, round_even(avg(delay_min), 1) AS avg_delay, CAST(quantile_disc(delay_min, 0.5) AS DOUBLE) AS p50,
       CAST(quantile_disc(delay_min, 0.8) AS DOUBLE) AS p80, CAST(quantile_disc(delay_min, 0.9) AS DOUBLE) AS p90,
       round_even(100.0 * sum(CASE WHEN delay_min <= 30 THEN 1 ELSE 0 END) / count(*), 1) AS on_time_pct, count(*) AS n_obs
FROM v_obs WHERE delay_min IS NOT NULL GROUP BY train_no HAVING count(*) >= 15
"""
VIEWS["v_quotes"] = """
SELECT CASE l_returnflag WHEN 'A' THEN 'SL' WHEN 'N' THEN '3A' ELSE '2A' END AS class_code,
       l_quantity * 40.0 AS km, l_extendedprice / 100.0 + 3.0 * l_quantity AS fare
FROM lineitem
"""
VIEWS["v_places"] = """
SELECT c_custkey AS id, 'CITY_' || CAST(c_custkey % 400 AS VARCHAR) AS name,
       'City_' || CAST(c_custkey % 400 AS VARCHAR) AS asciiname, n_name AS state,
       CAST(round_even(c_acctbal, 0) AS BIGINT) AS population,
       CAST(8.0 + (c_custkey * 41 % 280) / 10.0 AS DOUBLE) AS lat, CAST(68.0 + (c_custkey * 59 % 290) / 10.0 AS DOUBLE) AS lng
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
VIEWS["v_requests"] = f"""
SELECT request_id, from_place, to_place, pref, date, day, CAST(month(day) AS INTEGER) AS month,
       CAST(isodow(day) - 1 AS INTEGER) AS dow, {DAYS}[isodow(day)] AS day3
FROM (SELECT c_custkey AS request_id, 'CITY_' || CAST(c_custkey % 400 AS VARCHAR) AS from_place,
       'CITY_' || CAST((c_custkey * 7 + 3) % (SELECT count(*) FROM customer) % 400 AS VARCHAR) AS to_place,
       CASE c_custkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'cheapest' ELSE 'fastest' END AS pref,
       CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(DATE '2025-01-01' + CAST(c_custkey % 730 AS INTEGER) AS VARCHAR) END AS date,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE DATE '2025-01-01' + CAST(c_custkey % 730 AS INTEGER) END AS day
FROM customer)
"""
VIEWS["v_routes"] = """
SELECT o_custkey AS request_id, o_orderkey AS route_id, CAST(round_even(o_totalprice / 100, 0) AS INTEGER) AS fare,
       CAST(o_orderkey * 13 % 1440 AS INTEGER) AS minutes, CAST(25 + o_orderkey * 7 % 73 AS INTEGER) AS reliability,
       CAST(o_orderkey % 2 AS INTEGER) AS transfers,
       CASE WHEN o_orderkey % 2 = 1 OR o_orderkey % 3 = 0 THEN 'cross-origin' ELSE 'direct' END AS route_type,
       CASE WHEN o_orderkey % 2 = 1 OR o_orderkey % 3 = 0 THEN 'H' || CAST(o_orderkey % 10 AS VARCHAR) END AS hub,
       'T' || CAST((o_orderkey // 10) % 3 AS VARCHAR) AS first_train,
       CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey * 31 % 1440 AS INTEGER) END AS dep_min,
       CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey * 44 % 1440 AS INTEGER) END AS arr_min,
       o_orderkey % 17 = 0 AS road_only,
       CASE o_custkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'cheapest' ELSE 'fastest' END AS pref,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 5 < 3 END AS ac_available,
       CASE WHEN o_orderkey % 11 <> 0 THEN string_split(CASE o_orderstatus WHEN 'P' THEN 'SL,3A,2A' WHEN 'F' THEN '1A,2A,3A,SL'
            ELSE 'CC,2S,EC' END, ',') END AS classes,
       CAST(o_orderkey % 60 AS INTEGER) AS first_mile_minutes, CAST(20 + o_orderkey % 300 AS INTEGER) AS first_mile_fare,
       CAST(o_orderdate AS DATE) AS travel_day, CAST(o_orderkey % 400 / 4.0 AS DOUBLE) AS first_km,
       CAST(o_orderkey % 90 / 3.0 AS DOUBLE) AS last_km
FROM orders
"""
VIEWS["v_keys"] = """
SELECT *, CASE pref WHEN 'cheapest' THEN fare WHEN 'fastest' THEN minutes ELSE transfers END AS k1,
       CASE WHEN pref IN ('cheapest', 'fastest') THEN 0 ELSE -reliability END AS k2,
       CASE WHEN pref IN ('cheapest', 'fastest') THEN 0 WHEN route_type = 'cross-origin' THEN 1 ELSE 0 END AS k3,
       CASE WHEN pref IN ('cheapest', 'fastest') THEN 0 ELSE minutes END AS k4
FROM v_routes
"""
VIEWS["v_ranked"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY k1, k2, k3, k4, route_id) AS INTEGER) AS position FROM v_keys
"""
VIEWS["v_calendar"] = "SELECT CAST(d AS DATE) AS d, name, kind FROM (VALUES {calendar}) t(d, name, kind)"


def _calendar() -> str:
    from wayframe.fixed import DEMAND_CALENDAR

    return ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in DEMAND_CALENDAR)


VIEWS["v_calendar"] = VIEWS["v_calendar"].format(calendar=_calendar())


def with_views(sql: str) -> str:
    """The query with a WITH clause that holds every view it needs, each after those it reads."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    body = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if re.match(r"\s*WITH\s", sql):
        return "WITH " + body + ", " + re.sub(r"^\s*WITH\s", "", sql, count=1)
    return f"WITH {body} {sql}"
