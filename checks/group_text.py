"""Queries for names, clocks, lists and labels."""

from pyspark.sql import functions as F

from wayframe import fixed
from wayframe.functions import text

from .catalog import query
from .views import clock

# Part names dressed up the way raw station names come: brackets, prefixes, punctuation.
RAW_NAMES = """
SELECT p_partkey, p_name, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'RL ' || p_name WHEN 2 THEN p_name || ' JN'
  WHEN 3 THEN p_name || '(' || upper(p_name) ELSE '  ' || p_name || ' & co.-' || CAST(p_partkey AS VARCHAR) END AS raw FROM part
"""


def raw_names(net):
    k, n = F.col("p_partkey"), F.col("p_name")
    raw = (
        F.when(k % 5 == 0, n).when(k % 5 == 1, F.concat(F.lit("RL "), n)).when(k % 5 == 2, F.concat(n, F.lit(" JN")))
        .when(k % 5 == 3, F.concat(n, F.lit("("), F.upper(n)))
        .otherwise(F.concat(F.lit("  "), n, F.lit(" & co.-"), k.cast("string")))
    )
    return net.table("part").select("p_partkey", "p_name", raw.alias("raw"))


@query(f"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(raw), '[^A-Z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS norm,
  regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') AS alnum, left(regexp_replace(lower(raw), '[^a-z0-9]', '_', 'g'), 24) AS slug,
  trim(regexp_replace(raw || ' (KSR)', '\\s*\\([^)]*\\)\\s*$', '')) AS bare
FROM ({RAW_NAMES})
""")
def name_keys(net):
    raw = F.col("raw")
    return raw_names(net).select(
        "p_partkey", text.norm_name(raw).alias("norm"), text.alnum_key(raw).alias("alnum"), text.slug(raw).alias("slug"),
        text.strip_parens(F.concat(raw, F.lit(" (KSR)"))).alias("bare"),
    )


@query("""
SELECT event_id, coalesce(nullif(ltrim(trim(raw), '0'), ''), trim(raw)) AS train_no FROM (
  SELECT event_id, ' ' || lpad(CAST(user_id % 50 AS VARCHAR), 5, '0') || ' ' AS raw FROM events)
""")
def train_numbers(net):
    raw = F.concat(F.lit(" "), F.lpad((F.col("user_id") % 50).cast("string"), 5, "0"), F.lit(" "))
    return net.table("events").select("event_id", text.norm_train_no(raw).alias("train_no"))


CLOCK_TEXT = """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN 'Source'
  ELSE CAST(o_orderkey % 27 AS VARCHAR) || ':' || lpad(CAST(o_orderkey % 63 AS VARCHAR), 2, '0') END AS raw FROM orders"""


def clock_text(net):
    k = F.col("o_orderkey")
    raw = F.when(k % 9 == 0, "").when(k % 9 == 1, "Source").otherwise(
        F.concat((k % 27).cast("string"), F.lit(":"), F.lpad((k % 63).cast("string"), 2, "0"))
    )
    return net.table("orders").select("o_orderkey", raw.alias("raw"))


@query(f"""
SELECT o_orderkey, CASE WHEN h <= 23 AND m <= 59 THEN lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') END AS clock,
  CASE WHEN h <= 23 AND m <= 59 THEN CAST(h * 60 + m AS INTEGER) END AS minutes, CAST(coalesce(h, -1) AS INTEGER) AS hour
FROM (SELECT o_orderkey, try_cast(regexp_extract(raw, '^(\\d+):(\\d\\d)$', 1) AS INTEGER) AS h,
             try_cast(regexp_extract(raw, '^(\\d+):(\\d\\d)$', 2) AS INTEGER) AS m FROM ({CLOCK_TEXT}))
""")
def clock_parsing(net):
    raw = F.col("raw")
    parsed = clock_text(net).withColumn("clock", text.parse_clock(raw))
    return parsed.select(
        "o_orderkey", "clock", text.clock_minutes(F.col("clock")).alias("minutes"), text.clock_hour(raw).alias("hour")
    )


@query(f"SELECT train_number, seq, {clock('arr_min')} AS arrival, {clock('dep_min')} AS departure FROM v_stops")
def clock_formatting(net):
    return net.stops().select(
        "train_number", "seq", text.minutes_clock(F.col("arr_min")).alias("arrival"),
        text.minutes_clock(F.col("dep_min")).alias("departure"),
    )


@query("""
SELECT event_id, hour(ts) >= 23 OR hour(ts) < 5 AS late, CASE WHEN hour(ts) BETWEEN 4 AND 9 THEN 'early-morning'
  WHEN hour(ts) BETWEEN 10 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 21 THEN 'evening' ELSE 'late-night' END AS bucket,
  hour(ts) BETWEEN 4 AND 9 OR hour(ts) BETWEEN 17 AND 21 AS chosen FROM events
""")
def departure_windows(net):
    at = F.date_format("ts", "HH:mm")
    return net.table("events").select(
        "event_id", text.is_late_night(at).alias("late"), text.departure_window(at).alias("bucket"),
        text.in_departure_windows(at, F.array(F.lit("early-morning"), F.lit("evening"))).alias("chosen"),
    )


@query("""
SELECT o_orderkey, array_to_string(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items,
  CASE split_part(o_orderpriority, '-', 1) WHEN '1' THEN '1A,2A,3A' WHEN '2' THEN 'CC,EC' WHEN '3' THEN '2S' ELSE 'SL,3A,2A' END AS guessed
FROM (SELECT *, CASE o_orderstatus WHEN 'P' THEN 'SL, 3A ,,2A' WHEN 'F' THEN '' ELSE ' CC,2S' END AS raw FROM orders)
""")
def class_lists(net):
    status = F.col("o_orderstatus")
    raw = F.when(status == "P", "SL, 3A ,,2A").when(status == "F", "").otherwise(" CC,2S")
    kind = F.left("o_orderpriority", F.lit(1))
    code = F.when(kind == "1", "raj-x").when(kind == "2", "SHT").when(kind == "3", "PASS-2").otherwise(F.lit(None))
    return net.table("orders").select(
        "o_orderkey", F.array_join(text.csv_items(raw), "|").alias("items"), text.guess_classes(code).alias("guessed")
    )


@query("""
SELECT number, array_to_string(days, ',') AS codes, CASE WHEN len(days) = 7 THEN 'Daily' ELSE array_to_string(
    list_transform(days, lambda d: upper(d[1]) || lower(d[2:])), ', ') END AS label,
  CASE WHEN months IS NOT NULL THEN 'Seasonal · runs in ' || ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][months[1]] END AS season
FROM v_trains
""")
def running_day_labels(net):
    flags = [F.when(F.array_contains("days", d), "Y").otherwise("N") for d in fixed.WEEKDAYS]
    codes = F.when(F.col("days").isNotNull(), text.weekday_codes(flags))
    return net.trains().select(
        "number", codes.alias("codes"), text.days_label(F.col("days_of_week")).alias("label"),
        text.season_label(F.col("months")).alias("season"),
    )


@query("""
SELECT o_orderkey, array_to_string(list_sort(list_distinct([CAST(month(o_orderdate) AS INTEGER), CAST(1 + o_orderkey % 12 AS INTEGER)])), ',') AS months
FROM orders
""")
def month_lists(net):
    raw = F.concat(F.month("o_orderdate").cast("string"), F.lit(", ,"), (1 + F.col("o_orderkey") % 12).cast("string"))
    months = text.month_numbers(raw)
    return net.table("orders").select("o_orderkey", F.array_join(months.cast("array<string>"), ",").alias("months"))


@query("""
SELECT id, CASE WHEN id % 4 = 0 THEN 'mumbai' WHEN id % 4 = 1 THEN 'kolkata' ELSE name END AS spelled, name AS bare,
  CASE WHEN id % 3 = 0 THEN NULL ELSE lower(state) END AS hint FROM v_places
""")
def place_parsing(net):
    k = F.col("id")
    typed = F.when(k % 4 == 0, " Bombay ").when(k % 4 == 1, "CALCUTTA").otherwise(F.col("name"))
    full = F.when(k % 3 == 0, F.concat("name", F.lit(","))).otherwise(F.concat("name", F.lit(" , "), "state"))
    return net.places().select(
        "id", text.place_alias(typed).alias("spelled"), text.place_name(full).alias("bare"), text.place_hint(full).alias("hint")
    )


@query("""
SELECT o_orderkey, CAST(m // 60 AS VARCHAR) || 'h ' || CAST(m % 60 AS VARCHAR) || 'min' AS duration,
  '₹' || CASE WHEN length(f) <= 3 THEN f WHEN length(f) <= 5 THEN left(f, length(f) - 3) || ',' || right(f, 3)
    ELSE left(f, length(f) - 5) || ',' || substr(f, length(f) - 4, 2) || ',' || right(f, 3) END AS fare,
  ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(o_orderdate)] || ', ' || CAST(day(o_orderdate) AS VARCHAR) || ' ' ||
    ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(o_orderdate)] AS label
FROM (SELECT *, o_orderkey * 13 % 3000 AS m, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS f FROM orders)
""")
def display_formats(net):
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("")
    return net.table("orders").select(
        "o_orderkey", text.format_duration(F.col("o_orderkey") * 13 % 3000).alias("duration"),
        text.format_inr(F.col("o_totalprice").cast("bigint")).alias("fare"),
        text.day_month_label(day, F.col("o_orderdate")).alias("label"),
    )


@query("""
SELECT o_orderkey, CASE WHEN bad THEN NULL ELSE CAST(isodow(o_orderdate) - 1 AS INTEGER) END AS dow,
  CASE WHEN bad THEN NULL ELSE CAST(month(o_orderdate) AS INTEGER) END AS month,
  CASE WHEN bad THEN NULL ELSE CAST(date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) END AS days_out
FROM (SELECT *, o_orderkey % 6 = 0 AS bad FROM orders)
""")
def travel_dates(net):
    from wayframe.plans.search import dated

    k = F.col("o_orderkey")
    date = F.when(k % 12 == 0, "").when(k % 6 == 0, "1997-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = net.table("orders").select("o_orderkey", date.alias("date"))
    return dated(rows, F.lit("1998-01-01").cast("date")).select("o_orderkey", "dow", "month", "days_out")


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '10.0.0.' || CAST(user_id AS VARCHAR) ELSE '10.1.0.' || CAST(user_id AS VARCHAR) END AS client
FROM events
""")
def client_addresses(net):
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    header = F.when(k % 4 == 0, F.concat(F.lit(" 10.0.0."), u, F.lit(" , 172.16.0.1"))).when(k % 4 == 1, "")
    return net.table("events").select("event_id", text.first_hop(header, F.concat(F.lit("10.1.0."), u)).alias("client"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '~' || CAST(CAST(round_even(o_orderkey % 1000 / 4.0, 0) AS INTEGER) AS VARCHAR) || ' km road to X'
  ELSE 'Change at X · ~9 km away' END AS note FROM orders
""")
def road_notes(net):
    k = F.col("o_orderkey")
    note = F.when(k % 2 == 0, F.concat(F.lit("~"), k.cast("string"), F.lit(" km road to X"))).otherwise("Change at X · ~9 km away")
    return net.table("orders").select("o_orderkey", text.refresh_road_note(note, k % 1000 / 4.0).alias("note"))


GRAMS = """
list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))
"""


@query(f"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part),
g AS (SELECT name, {GRAMS.format(c='name')} AS grams FROM n),
p AS (SELECT a.name AS query, b.name AS name, len(list_intersect(a.grams, b.grams)) AS shared, len(a.grams) AS na, len(b.grams) AS nb
      FROM g a, g b)
SELECT query, name, round(shared / (na + nb - shared), 6) AS similarity FROM p WHERE shared / (na + nb - shared) > 0.45
""")
def trigram_similar_names(net):
    from wayframe.operators.naming import trigram_matches

    names = net.table("part").select(F.col("p_name").alias("name"))
    out = trigram_matches(names.withColumnRenamed("name", "query"), names)
    return out.select("query", "name", F.round("similarity", 6).alias("similarity"))


@query("""
SELECT p_partkey, CASE WHEN least(length(a), length(b)) < 5 THEN a = b ELSE starts_with(a, b) OR starts_with(b, a) END AS same FROM (
  SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS a, CASE p_partkey % 4 WHEN 0 THEN left(regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g'), 4)
    WHEN 1 THEN regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') || 'JN' WHEN 2 THEN left(regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g'), 6)
    ELSE 'X' || regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') END AS b FROM part)
""")
def same_station_names(net):
    k, n = F.col("p_partkey"), text.alnum_key(F.col("p_name"))
    other = F.when(k % 4 == 0, F.left(n, F.lit(4))).when(k % 4 == 1, F.concat(n, F.lit(" jn."))).when(
        k % 4 == 2, F.left(n, F.lit(6))
    ).otherwise(F.concat(F.lit("x"), n))
    return net.table("part").select("p_partkey", text.same_name(F.col("p_name"), other).alias("same"))
