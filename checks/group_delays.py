"""Queries for delay history, users' logs and limits."""

from pyspark.sql import functions as F

from wayframe import fixed
from wayframe.operators import delays, userlog

from .catalog import query


@query("SELECT * FROM v_delay_stats")
def delay_stats(net):
    return delays.delay_stats(net.observations())


@query("SELECT train_no, obs_date, station_no, delay_min FROM v_obs")
def clean_observations(net):
    return net.observations()


DAYS_SQL = """
days AS (SELECT train_no, array_to_string(list_transform(list_sort(list(dow)), lambda d: ['MON','TUE','WED','THU','FRI','SAT','SUN'][d + 1]), ',') AS days_of_week
  FROM (SELECT train_no, isodow(obs_date) - 1 AS dow, count(*) AS n, sum(count(*)) OVER (PARTITION BY train_no) AS total,
               max(count(*)) OVER (PARTITION BY train_no) AS peak FROM v_obs WHERE station_no = 1 GROUP BY 1, 2)
  WHERE total >= 8 AND n >= greatest(2, 0.5 * peak) GROUP BY train_no)
"""


def running(net):
    return delays.running_days(net.observations(), min_origin=8, share=0.5)


@query(f"WITH {DAYS_SQL} SELECT * FROM days")
def running_days(net):
    return running(net)


SEASON_SQL = """
season AS (SELECT train_no, array_to_string(list_transform(list_sort(list(DISTINCT month(obs_date))), lambda m: CAST(m AS VARCHAR)), ',') AS operating_months
  FROM v_obs WHERE station_no = 1 GROUP BY 1 HAVING count(DISTINCT obs_date) <= 30 AND count(DISTINCT month(obs_date)) <= 7)
"""


@query(f"WITH {SEASON_SQL} SELECT * FROM season")
def seasonal_months(net):
    return delays.seasonal_months(net.observations(), max_months=7)


STORED = "SELECT train_no AS number, CASE WHEN CAST(train_no AS INTEGER) % 2 = 0 THEN 'MON,TUE,WED,THU,FRI,SAT,SUN' ELSE 'MON,WED' END AS days_of_week FROM (SELECT DISTINCT train_no FROM v_obs)"


def stored_trains(net):
    even = F.col("train_no").cast("int") % 2 == 0
    return net.observations().select("train_no").distinct().select(
        F.col("train_no").alias("number"), F.when(even, ",".join(fixed.WEEKDAYS)).otherwise("MON,WED").alias("days_of_week")
    )


@query(f"""WITH {DAYS_SQL}, t AS ({STORED}) SELECT t.number, d.days_of_week,
  t.days_of_week LIKE '%SUN' AND length(d.days_of_week) < 27 AS wrongly_daily
FROM t JOIN days d ON t.number = d.train_no WHERE t.days_of_week <> d.days_of_week""")
def day_corrections(net):
    return delays.day_corrections(stored_trains(net), running(net))


@query(f"""WITH {DAYS_SQL}, {SEASON_SQL}, t AS ({STORED})
SELECT t.number, coalesce(d.days_of_week, t.days_of_week) AS days_of_week, s.operating_months
FROM t LEFT JOIN days d ON t.number = d.train_no LEFT JOIN season s ON t.number = s.train_no""")
def corrected_trains(net):
    trains = stored_trains(net)
    fixed_days = delays.apply_day_corrections(trains, delays.day_corrections(trains, running(net)))
    months = delays.seasonal_months(net.observations(), max_months=7)
    return delays.apply_operating_months(fixed_days, months).select("number", "days_of_week", "operating_months")


# --- logs ------------------------------------------------------------------------------------------

LOG = "SELECT event_id, ts, user_id, event_type, value FROM events"


def log(net):
    return net.table("events").select("event_id", "ts", "user_id", "event_type", "value")


LATEST = "latest AS (SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)"


@query(f"WITH {LATEST} SELECT * FROM latest")
def latest_per_key(net):
    return userlog.latest_per_key(log(net), ["user_id", "event_type"], ["ts", "event_id"])


@query(f"WITH {LATEST} SELECT * FROM latest WHERE NOT value < 10")
def saved_after_deletes(net):
    return userlog.current_rows(log(net), ["user_id", "event_type"], ["ts", "event_id"], F.col("value") < 10)


@query("SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS position FROM (" + LOG + ") QUALIFY position <= 8")
def newest_eight(net):
    return userlog.keep_newest(log(net), "user_id", ["ts", "event_id"])


@query("""
SELECT user_id, from_key, to_key, event_id, position FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS position FROM (
    SELECT event_id, ts, user_id, 'place ' || CAST(event_id % 6 AS VARCHAR) AS from_key, event_type AS to_key FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, from_key, to_key ORDER BY ts DESC, event_id DESC) = 1)) WHERE position <= 8
""")
def recent_searches(net):
    k = F.col("event_id")
    base = F.concat(F.lit(" Place "), (k % 6).cast("string"), F.lit(" "))
    searches = log(net).select(
        "event_id", "ts", "user_id", F.when(k % 2 == 0, F.upper(base)).otherwise(base).alias("from_place"),
        F.initcap("event_type").alias("to_place"),
    )
    return userlog.recent_searches(searches).select("user_id", "from_key", "to_key", "event_id", "position")


@query("""
SELECT event_id, user_id, hits, hits > 4 AS flagged, CASE WHEN hits > 4 THEN
  CAST(floor((oldest + 86400000000 - us) / 1000000.0) + 1 AS INTEGER) END AS retry_after FROM (
  SELECT event_id, user_id, us, (SELECT CAST(count(*) AS INTEGER) FROM events b WHERE b.user_id = a.user_id AND epoch_us(b.ts) > a.us - 86400000000
      AND (epoch_us(b.ts) < a.us OR (epoch_us(b.ts) = a.us AND b.event_id <= a.event_id))) AS hits,
    (SELECT min(epoch_us(b.ts)) FROM events b WHERE b.user_id = a.user_id AND epoch_us(b.ts) > a.us - 86400000000 AND epoch_us(b.ts) <= a.us) AS oldest
  FROM (SELECT *, epoch_us(ts) AS us FROM events) a)
""")
def sliding_limits(net):
    out = userlog.sliding_limit(log(net), "user_id", "ts", "event_id", 4, 86400)
    return out.select("event_id", "user_id", "hits", "flagged", "retry_after")


@query("""
SELECT c_custkey AS request_id, CASE WHEN c_custkey % 5 = 0 THEN 'pref' WHEN c_custkey % 7 = 0 THEN 'date' WHEN c_custkey % 11 = 0 THEN 'place' ELSE 'ok' END AS verdict FROM customer
""")
def request_validation(net):
    k = F.col("request_id")
    rows = net.requests().select(
        "request_id",
        F.when(k % 11 == 0, F.repeat("from_place", 30)).otherwise(F.col("from_place")).alias("from_place"), "to_place",
        F.when(k % 5 == 0, "best").otherwise(F.col("pref")).alias("pref"),
        F.when(k % 7 == 0, "2025/01/01").otherwise(F.col("date")).alias("date"),
    )
    good, bad = userlog.validate_requests(rows)
    return good.select("request_id", F.lit("ok").alias("verdict")).unionByName(
        bad.select("request_id", F.col("reject_reason").alias("verdict"))
    )


@query("""
SELECT route_id, fare, minutes, CAST(saved AS VARCHAR) AS saved_at FROM (SELECT *, travel_day AS saved FROM v_routes)
WHERE route_id % 13 <> 0 AND route_id % 17 <> 0
""")
def route_snapshots(net):
    k = F.col("route_id")
    routes = net.routes().withColumn("saved_at", F.col("travel_day").cast("string"))
    text_id = F.when(k % 13 == 0, "").otherwise(k.cast("string"))
    work = routes.withColumn("num", k).withColumn("text_id", text_id).drop("route_id").withColumnRenamed("text_id", "route_id")
    doc = F.struct(F.col("route_id").alias("id"), "fare", "minutes", F.when(F.col("num") % 17 == 0, F.repeat(F.lit("x"), 70000)).otherwise("").alias("pad"))
    saved = userlog.route_snapshots(work, doc)
    back = userlog.read_snapshots(saved, "struct<id:string,fare:int,minutes:int,saved_at:string>")
    return back.select(F.col("num").alias("route_id"), "route.fare", "route.minutes", "route.saved_at")
