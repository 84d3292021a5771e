"""Queries for tiers, delays, demand, fares and reliability."""

from pyspark.sql import functions as F

from wayframe.functions import score
from wayframe.operators import fares
from wayframe.plans.search import demand

from .catalog import query
from .views import VIEWS, rnd

TIER = """CASE WHEN regexp_matches(upper({name}), 'RAJDHANI|SHATABDI|VANDE|DURONTO|TEJAS|GATIMAAN|HUMSAFAR|GARIB RATH') THEN 'premium'
  WHEN left({no}, 2) IN ('12', '22', '20', '02') THEN 'superfast' WHEN left({no}, 1) = '5' THEN 'passenger' ELSE 'express' END"""
# train numbers of five digits, so that the number series matter
VIEWS["v_tiers"] = f"""
SELECT k, no, name, km, halts, tier, 10 + 12 * CAST(tier = 'superfast' AS INTEGER) + 23 * CAST(tier = 'express' AS INTEGER) + 38 * CAST(tier = 'passenger' AS INTEGER) AS base
FROM (SELECT *, {TIER.format(name='name', no='no')} AS tier FROM (SELECT o_orderkey AS k, lpad(CAST(o_orderkey * 7 % 60000 AS VARCHAR), 5, '0') AS no,
        CASE WHEN left(o_orderpriority, 1) = '1' THEN 'Tejas Rajdhani' WHEN left(o_orderpriority, 1) = '2' THEN 'Shatabdi exp' ELSE 'Mail' END AS name,
        CAST(o_orderkey % 2500 AS DOUBLE) AS km, CAST(o_orderkey % 40 AS INTEGER) AS halts FROM orders))
"""


def tiers(net):
    k = F.col("o_orderkey")
    kind = F.left("o_orderpriority", F.lit(1))
    rows = net.table("orders").select(
        k.alias("k"), F.lpad((k * 7 % 60000).cast("string"), 5, "0").alias("no"),
        F.when(kind == "1", "Tejas Rajdhani").when(kind == "2", "Shatabdi exp").otherwise("Mail").alias("name"),
        (k % 2500).cast("double").alias("km"), (k % 40).cast("int").alias("halts"), "o_orderstatus", "o_orderdate",
    )
    return rows.withColumn("tier", score.infer_tier(F.col("no"), F.col("name")))


@query(f"""
SELECT k, tier, round(base + 8.0 * km / 1000 + 0.35 * halts, 6) AS expected, round(1 - exp(-30 / greatest(6.0, base)), 6) AS within,
  CASE WHEN k % 1500 = 0 THEN 'none' WHEN k % 1500 >= 1000 THEN 'high' WHEN k % 1500 >= 100 THEN 'moderate' ELSE 'limited' END AS confidence,
  CAST(CASE tier WHEN 'premium' THEN 0 WHEN 'superfast' THEN 1 WHEN 'express' THEN 2 ELSE 3 END AS INTEGER) AS code FROM v_tiers
""")
def train_tiers(net):
    tier = F.col("tier")
    base = score.expected_delay(tier, F.lit(0.0), F.lit(0))
    return tiers(net).select(
        "k", "tier", F.round(score.expected_delay(tier, F.col("km"), F.col("halts")), 6).alias("expected"),
        F.round(score.share_within(F.lit(30), base), 6).alias("within"), score.confidence(F.col("k") % 1500).alias("confidence"),
        score.tier_code(tier).alias("code"),
    )


@query(f"""
SELECT k, avg_mins, CAST(round_even(CASE WHEN source = 'measured' THEN on_time_pct ELSE 100 * (1 - exp(-30 / greatest(6.0, avg_mins))) END, 0) AS INTEGER) AS on_time,
  source, p90, n_obs FROM (SELECT k, coalesce({rnd('s.avg_delay')}, {rnd('base + 8.0 * km / 1000 + 0.35 * halts')}) AS avg_mins, s.on_time_pct,
    CASE WHEN s.train_no IS NULL THEN 'modelled' ELSE 'measured' END AS source, s.p90, CAST(coalesce(s.n_obs, 0) AS INTEGER) AS n_obs
  FROM v_tiers LEFT JOIN v_delay_stats s ON s.train_no = CAST(k % 200 AS VARCHAR))
""")
def delay_profiles(net):
    from wayframe.operators.delays import delay_stats

    stats = delay_stats(net.observations()).withColumnRenamed("train_no", "key")
    rows = tiers(net).withColumn("key", (F.col("k") % 200).cast("string")).join(stats, "key", "left")
    p = score.delay_profile(
        F.col("tier"), F.col("km"), F.col("halts"), F.col("avg_delay"), F.col("on_time_pct"), F.col("p90"), F.col("n_obs"), F.lit(0)
    )
    return rows.withColumn("p", p).select(
        "k", F.col("p.avg_mins").alias("avg_mins"), F.col("p.on_time_pct").alias("on_time"), F.col("p.source").alias("source"),
        F.col("p.p90").alias("p90"), F.col("p.n_obs").alias("n_obs"),
    )


CURVE = "[a - 25.0, a - 10.0, a, a + 15.0 + b, a + 40.0 + b, a + 200.0]"
VIEWS["v_curves"] = f"SELECT k, {CURVE} AS q, x FROM (SELECT o_orderkey AS k, o_orderkey % 37 - 3.0 AS a, o_orderkey % 11 * 1.0 AS b, CAST(o_orderkey % 331 AS INTEGER) AS x FROM orders)"


def curves(net):
    k = F.col("o_orderkey")
    a, b = k % 37 - 3.0, (k % 11) * 1.0
    q = F.array(a - 25.0, a - 10.0, a, a + 15.0 + b, a + 40.0 + b, a + 200.0)
    return net.table("orders").select(k.alias("k"), q.alias("q"), (k % 331).cast("int").alias("x"))


@query("""
SELECT k, round_even(CASE WHEN p IS NULL THEN 0.97 ELSE greatest(0.02, least(0.99, p)) END, 3) AS share, round(mean, 6) AS mean,
  CASE WHEN x >= 30 THEN CAST(greatest(35, least(98, round_even(100 * round_even(CASE WHEN p IS NULL THEN 0.97 ELSE greatest(0.02, least(0.99, p)) END, 3), 0))) AS INTEGER) END AS safety
FROM (SELECT k, x, CASE WHEN x <= m[1] THEN l[1] WHEN x <= m[2] THEN l[1] + (CASE WHEN m[2] = m[1] THEN 0 ELSE (x - m[1]) / (m[2] - m[1]) END) * (l[2] - l[1])
    WHEN x <= m[3] THEN l[2] + (x - m[2]) / (m[3] - m[2]) * (l[3] - l[2]) WHEN x <= m[4] THEN l[3] + (x - m[3]) / (m[4] - m[3]) * (l[4] - l[3])
    WHEN x <= m[5] THEN l[4] + (x - m[4]) / (m[5] - m[4]) * (l[5] - l[4]) WHEN x <= m[6] THEN l[5] + (x - m[5]) / (m[6] - m[5]) * (l[6] - l[5])
    WHEN x <= m[7] THEN l[6] + (x - m[6]) / (m[7] - m[6]) * (l[7] - l[6]) END AS p,
    (0 + z[1]) / 2 * 0.1 + (z[1] + z[2]) / 2 * 0.15 + (z[2] + z[3]) / 2 * 0.25 + (z[3] + z[4]) / 2 * 0.25 + (z[4] + z[5]) / 2 * 0.15 + (z[5] + z[6]) / 2 * 0.09 + z[6] * 0.01 AS mean
  FROM (SELECT k, x, [least(q[1], 0.0)] || q AS m, list_transform([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99], lambda v: CAST(v AS DOUBLE)) AS l, list_transform(q, lambda v: greatest(v, 0.0)) AS z FROM v_curves))
""")
def quantile_curves(net):
    q, x = F.col("q"), F.col("x")
    return curves(net).select(
        "k", score.curve_cdf(q, x).alias("share"), F.round(score.curve_mean(q), 6).alias("mean"),
        score.connection_safety(x, F.lit(20.0), q).alias("safety"),
    )


@query("SELECT k, array_to_string(list_transform(list_sort([b, a, c]), lambda v: CAST(v AS VARCHAR)), ',') AS curve FROM (SELECT o_orderkey AS k, o_orderkey % 5 AS a, o_orderkey % 7 AS b, o_orderkey % 3 AS c FROM orders)")
def monotone_curves(net):
    k = F.col("o_orderkey")
    out = score.monotone(F.array(k % 7, k % 5, k % 3))
    return net.table("orders").select(k.alias("k"), F.array_join(out.cast("array<string>"), ",").alias("curve"))


@query(f"""
SELECT o_orderkey, CASE WHEN b >= 30 THEN CAST(greatest(35, least(98, round_even(100 * (1 - exp(-b / greatest(6.0, CAST(a AS DOUBLE)))), 0))) AS INTEGER) END AS safety,
  CAST(greatest(30, least(round_even(a, 0), 90)) AS INTEGER) AS min_buf, round(greatest(30.0, 100 - b / 6), 6) AS access
FROM (SELECT o_orderkey, CAST(o_orderkey % 400 AS INTEGER) AS b, o_orderkey % 250 / 2.0 AS a FROM orders)
""")
def connection_safety(net):
    k = F.col("o_orderkey")
    buffer, mean = (k % 400).cast("int"), k % 250 / 2.0
    return net.table("orders").select(
        "o_orderkey", score.connection_safety(buffer, mean).alias("safety"), score.min_buffer(mean).alias("min_buf"),
        F.round(score.access_score(buffer.cast("double")), 6).alias("access"),
    )


@query("""
SELECT route_id, CAST(greatest(25, least(97, round_even(CASE WHEN transfers = 0 THEN 0.5 * coalesce(c, 70) + 0.3 * t + 0.2 * access
  ELSE 0.38 * coalesce(c, 70) + 0.3 * coalesce(s, 60) + 0.2 * t + 0.12 * access END, 0))) AS INTEGER) AS reliability
FROM (SELECT route_id, transfers, greatest(30.0, 100 - first_km / 6) AS access, CASE WHEN route_id % 9 <> 0 THEN CAST(route_id * 3 % 97 AS INTEGER) END AS c,
        CASE WHEN route_id % 5 <> 0 THEN CAST(35 + route_id % 64 AS INTEGER) END AS s, CAST(route_id * 11 % 101 AS INTEGER) AS t FROM v_routes)
""")
def route_reliability(net):
    k = F.col("route_id")
    out = score.reliability(
        (k * 11 % 101).cast("int"), F.when(k % 5 != 0, (35 + k % 64).cast("int")), F.col("transfers"), F.col("first_km"),
        F.when(k % 9 != 0, (k * 3 % 97).cast("int")),
    )
    return net.routes().select("route_id", out.alias("reliability"))


@query("""
SELECT k, pct, CASE WHEN pct >= 78 THEN 'confirmed' WHEN pct >= 55 THEN 'rac' ELSE 'waitlisted' END AS state FROM (
  SELECT k, CAST(greatest(20, least(96, round_even(base + adj + lead + peak, 0))) AS INTEGER) AS pct FROM (
    SELECT t.k, CASE o_orderstatus WHEN 'P' THEN 74 WHEN 'F' THEN 68 ELSE 84 END AS base,
      CASE tier WHEN 'premium' THEN -12 WHEN 'superfast' THEN -4 WHEN 'express' THEN 0 ELSE 8 END AS adj,
      CASE WHEN t.k % 4 = 0 THEN 8.0 ELSE least(16.0, greatest(-6.0, (t.k % 60 - 20) * 0.5)) END AS lead,
      CASE WHEN t.k % 4 <> 0 AND month(o_orderdate) IN (5, 6, 10, 11, 12) THEN -12 ELSE 0 END AS peak
    FROM v_tiers t JOIN orders ON o_orderkey = t.k))
""")
def confirmation_odds(net):
    k, status = F.col("k"), F.col("o_orderstatus")
    classes = F.when(status == "P", F.array(F.lit("SL"), F.lit("2A"))).when(status == "F", F.array().cast("array<string>")).otherwise(
        F.array(F.lit("1A"), F.lit("2S"))
    )
    undated = k % 4 == 0
    c = score.confirmation(classes, F.col("tier"), F.when(~undated, k % 60 - 20), F.when(~undated, F.month("o_orderdate")))
    return tiers(net).withColumn("c", c).select("k", "c.pct", "c.state")


VIEWS["v_demand"] = """
SELECT id, day, CAST(CASE WHEN day IS NULL THEN 0 ELSE greatest(CASE kind WHEN 'festival' THEN 85 WHEN 'holiday' THEN 70 ELSE 0 END,
    CASE WHEN lw THEN 60 WHEN wd >= 5 THEN 35 ELSE 0 END, CASE WHEN month(day) IN (5, 6, 10, 11, 12) THEN 25 ELSE 0 END) END AS INTEGER) AS score,
  coalesce(CASE WHEN day IS NOT NULL THEN array_to_string(list_filter([CASE kind WHEN 'festival' THEN name || ' (festival)' WHEN 'holiday' THEN name END,
    CASE WHEN lw THEN 'long weekend' WHEN wd >= 5 THEN 'weekend' END,
    CASE WHEN kind IS NULL AND NOT lw AND wd < 5 AND month(day) IN (5, 6, 10, 11, 12) THEN 'peak travel season' END], lambda x: x IS NOT NULL), '|') END, '') AS drivers
FROM (SELECT *, near AND wd IN (4, 5, 6, 0) AND (kind IS NOT NULL OR wd >= 5) AS lw FROM (
  SELECT a.*, c.kind, c.name, isodow(a.day) - 1 AS wd, EXISTS (SELECT 1 FROM v_calendar n WHERE abs(date_diff('day', n.d, a.day)) <= 1) AS near FROM (
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 <> 0 THEN DATE '2025-01-01' + CAST(o_orderkey % 730 AS INTEGER) END AS day FROM orders) a
  LEFT JOIN v_calendar c ON c.d = a.day))
"""


def demanded(net):
    from wayframe.sources.files import calendar_table

    k = F.col("o_orderkey")
    day = F.when(k % 50 != 0, F.date_add(F.lit("2025-01-01").cast("date"), (k % 730).cast("int")))
    return demand(net.table("orders").select(k.alias("id"), day.alias("day")), calendar_table(net.spark))


@query("SELECT id, score, drivers FROM v_demand")
def demand_levels(net):
    return demanded(net).select("id", F.col("demand_score").alias("score"), F.array_join("demand_drivers", "|").alias("drivers"))


@query("""
SELECT id, CASE WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'moderate' END AS level, CASE WHEN score >= 35 THEN split_part(drivers, '|', 1) END AS label,
  CASE WHEN id % 2 = 0 THEN round_even(least(1.4, 1 + 0.4 * score / 100), 3) ELSE 1.0 END AS multiplier FROM v_demand
""")
def demand_advice(net):
    rows = demanded(net).withColumn("a", score.demand_advisory(F.col("demand_score"), F.col("demand_drivers")))
    tier = F.when(F.col("id") % 2 == 0, "premium").otherwise("express")
    return rows.select(
        "id", F.col("a.level").alias("level"), F.col("a.label").alias("label"), score.flexi_multiplier(tier, F.col("demand_score")).alias("multiplier")
    )


# --- fares -----------------------------------------------------------------------------------------


@query("SELECT class_code, round(km, 6) AS km, round(fare, 6) AS fare FROM v_quotes WHERE fare > 0 AND km > 0 AND km <= 1800")
def clean_quotes(net):
    out = fares.clean_quotes(net.quotes(), 1800.0)
    return out.select("class_code", F.round("km", 6).alias("km"), F.round("fare", 6).alias("fare"))


VIEWS["v_fits"] = "SELECT class_code, round_even(regr_slope(fare, km), 4) AS rate, round_even(regr_intercept(fare, km), 1) AS base FROM v_quotes GROUP BY 1 HAVING count(*) >= 30"
VIEWS["v_pooled"] = "SELECT class_code, km, count(*) AS w, sum(fare) AS s FROM v_quotes GROUP BY 1, 2"
# isotonic fit by its min-max formula: at each distance the largest lower end of the smallest mean
VIEWS["v_curve_points"] = """
SELECT class_code, km, max(low) AS fare FROM (
  SELECT t.class_code, t.km, i.km AS start, min(m.mean) AS low FROM v_pooled t JOIN v_pooled i ON i.class_code = t.class_code AND i.km <= t.km
  JOIN (SELECT a.class_code, a.km AS lo, b.km AS hi, sum(c.s) / sum(c.w) AS mean FROM v_pooled a JOIN v_pooled b ON a.class_code = b.class_code AND b.km >= a.km
        JOIN v_pooled c ON c.class_code = a.class_code AND c.km BETWEEN a.km AND b.km GROUP BY 1, 2, 3) m ON m.class_code = t.class_code AND m.lo = i.km AND m.hi >= t.km
  GROUP BY 1, 2, 3) GROUP BY 1, 2
"""


@query("SELECT * FROM v_fits")
def linear_fare_fits(net):
    return fares.fit_linear(net.quotes())


@query("SELECT class_code, count(*) AS n, round(median(fare / km), 6) AS median_rate FROM v_quotes GROUP BY 1")
def median_fare_rates(net):
    out = fares.median_rates(net.quotes())
    return out.select("class_code", "n", F.round("median_rate", 6).alias("median_rate"))


@query("SELECT class_code, km, round(fare, 4) AS fare FROM v_curve_points")
def isotonic_fare_curve(net):
    """Predictions of the fitted curve at every distance of the quotes."""
    from wayframe.operators.fares import curve_at

    quotes = net.quotes()
    out = curve_at(quotes.select("class_code", "km").distinct(), fares.fit_isotonic(quotes))
    return out.select("class_code", "km", F.round("curve_fare", 4).alias("fare"))


VIEWS["v_curve_lookup"] = """
SELECT k, class_code, km, CASE WHEN n IS NULL THEN NULL WHEN km <= k0 THEN f0 WHEN km >= k1 THEN greatest(f1, round_even(rate * km + base, 0))
   ELSE round_even(y0 + (km - x0) / (x1 - x0) * (y1 - y0), 0) END AS curve_fare
FROM (SELECT a.*, e.*, f.rate, f.base, s.x0, s.x1, s.y0, s.y1 FROM (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'SL' WHEN 1 THEN '3A' WHEN 2 THEN '2A' ELSE 'CC' END AS class_code,
        CAST(o_orderkey * 3 % 2600 AS DOUBLE) + 0.5 AS km FROM orders) a
  LEFT JOIN (SELECT class_code AS c, count(*) AS n, min(km) AS k0, max(km) AS k1, round_even(min(fare), 0) AS f0, round_even(max(fare), 0) AS f1 FROM v_curve_points GROUP BY 1) e ON e.c = a.class_code
  LEFT JOIN v_fits f ON f.class_code = a.class_code
  LEFT JOIN (SELECT class_code, km AS x0, round_even(fare, 0) AS y0, lead(km) OVER w AS x1, round_even(lead(fare) OVER w, 0) AS y1 FROM v_curve_points
             WINDOW w AS (PARTITION BY class_code ORDER BY km)) s ON s.class_code = a.class_code AND a.km >= s.x0 AND a.km < s.x1)
"""


def asked_fares(net):
    k = F.col("o_orderkey")
    code = F.when(k % 4 == 0, "SL").when(k % 4 == 1, "3A").when(k % 4 == 2, "2A").otherwise("CC")
    return net.table("orders").select(k.alias("k"), code.alias("class_code"), ((k * 3 % 2600).cast("double") + 0.5).alias("km"))


@query("SELECT * FROM v_curve_lookup")
def fare_lookup(net):
    quotes = net.quotes()
    knots = fares.stored_knots(fares.fit_isotonic(quotes))
    return fares.lookup_fare(asked_fares(net), knots, fares.fit_linear(quotes)).select("k", "class_code", "km", "curve_fare")


@query("""
SELECT k, class_code, tier, CAST(greatest(60, round_even(CASE WHEN curve_fare IS NOT NULL THEN curve_fare * CASE WHEN tier = 'premium' THEN 1.12 ELSE 1 END
    ELSE (km * 1.58 + 40 + CASE WHEN tier IN ('premium', 'superfast') THEN 45 ELSE 0 END) * 1.05 END * CASE WHEN tier = 'premium' THEN 1.2 ELSE 1.0 END, 0)) AS INTEGER) AS fare,
  CAST(greatest(20, round_even(km * 3, 0)) AS INTEGER) AS road_fare, CAST(round_even(km / 40 * 60, 0) AS INTEGER) AS road_minutes
FROM (SELECT *, CASE k % 3 WHEN 0 THEN 'premium' WHEN 1 THEN 'superfast' ELSE 'express' END AS tier FROM v_curve_lookup)
""")
def rail_and_road_fares(net):
    quotes = net.quotes()
    knots = fares.stored_knots(fares.fit_isotonic(quotes))
    rows = fares.lookup_fare(asked_fares(net), knots, fares.fit_linear(quotes))
    tier = F.when(F.col("k") % 3 == 0, "premium").when(F.col("k") % 3 == 1, "superfast").otherwise("express")
    rows = rows.withColumn("tier", tier)
    fare = score.rail_fare(F.col("curve_fare"), F.col("class_code"), F.col("km"), F.col("tier"), F.lit(1.2))
    return rows.select(
        "k", "class_code", "tier", fare.alias("fare"), score.road_fare(F.col("km")).alias("road_fare"), score.road_minutes(F.col("km")).alias("road_minutes")
    )


@query("""
WITH offers AS (SELECT o_orderkey AS k, CAST(o_orderkey * 3 % 2600 AS DOUBLE) + 0.5 AS km, CASE o_orderstatus WHEN 'P' THEN ['SL', '3A', '2A'] WHEN 'F' THEN ['2A', 'XX'] ELSE ['XX'] END AS l FROM orders),
rows AS (SELECT k, km, unnest(CASE WHEN l = ['XX'] THEN ['SL'] ELSE list_filter(l, lambda c: c <> 'XX') END) AS c FROM offers),
pts AS (SELECT class_code, km, round_even(fare, 0) AS f FROM v_curve_points),
seg AS (SELECT class_code, km AS x0, f AS y0, lead(km) OVER w AS x1, lead(f) OVER w AS y1 FROM pts WINDOW w AS (PARTITION BY class_code ORDER BY km)),
ends AS (SELECT class_code, min(km) AS k0, max(km) AS k1, min(f) AS f0, max(f) AS f1 FROM pts GROUP BY 1),
priced AS (SELECT r.k, r.c, CAST(greatest(60, CASE WHEN r.km <= k0 THEN f0 WHEN r.km >= k1 THEN greatest(f1, round_even(rate * r.km + base, 0))
    ELSE round_even(y0 + (r.km - x0) / (x1 - x0) * (y1 - y0), 0) END) AS INTEGER) AS fare, CASE r.c WHEN 'SL' THEN 2 WHEN '3A' THEN 4 ELSE 5 END AS pos
  FROM rows r JOIN ends e ON e.class_code = r.c JOIN v_fits f ON f.class_code = r.c LEFT JOIN seg s ON s.class_code = r.c AND r.km >= x0 AND r.km < x1)
SELECT k, min(fare) AS fare, string_agg(c || ':' || CAST(fare AS VARCHAR), ',' ORDER BY fare, pos) AS listed FROM priced GROUP BY k
""")
def fares_per_class(net):
    quotes = net.quotes()
    knots = fares.stored_knots(fares.fit_isotonic(quotes))
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    offered = F.when(status == "P", F.array(F.lit("SL"), F.lit("3A"), F.lit("2A"))).when(status == "F", F.array(F.lit("2A"), F.lit("XX"))).otherwise(F.array(F.lit("XX")))
    legs = net.table("orders").select(
        k.alias("k"), ((k * 3 % 2600).cast("double") + 0.5).alias("km"), F.lit("express").alias("tier"), F.lit(1.0).alias("multiplier"), offered.alias("offered")
    )
    out = fares.class_fares(legs, ["k"], knots, fares.fit_linear(quotes))
    listed = F.array_join(F.transform("class_fares", lambda c: F.concat(c["code"], F.lit(":"), c["fare"].cast("string"))), ",")
    return out.select("k", "fare", listed.alias("listed"))


@query(f"""
SELECT k, array_to_string(CASE WHEN kept = [] THEN l ELSE kept END, ',') AS offered FROM (
  SELECT k, l, CASE WHEN tier <> 'premium' THEN l WHEN contains(upper(name), 'SHATABDI') THEN list_filter(l, lambda c: c IN ('CC', 'EC', '2S', 'EA', 'EV'))
    WHEN contains(upper(name), 'TEJAS') THEN list_filter(l, lambda c: c IN ('CC', 'EC', '2S', 'EA', 'EV')) ELSE l END AS kept
  FROM (SELECT t.k, tier, name, CASE o_orderstatus WHEN 'P' THEN ['SL', '3A', 'CC'] WHEN 'F' THEN ['SL'] ELSE ['CC', '2A', 'EC'] END AS l FROM v_tiers t JOIN orders ON o_orderkey = k))
""")
def offered_classes(net):
    status = F.col("o_orderstatus")
    listed = F.when(status == "P", F.array(F.lit("SL"), F.lit("3A"), F.lit("CC"))).when(status == "F", F.array(F.lit("SL"))).otherwise(
        F.array(F.lit("CC"), F.lit("2A"), F.lit("EC"))
    )
    out = score.offered_classes(listed, F.col("tier"), F.col("name"))
    return tiers(net).select("k", F.array_join(out, ",").alias("offered"))


@query("""
SELECT number, array_to_string(list_filter(['2S', 'SL', 'CC', '3A', '2A', '1A'], lambda c: list_contains(u, c)) || list_sort(list_filter(u, lambda c: c NOT IN ('2S', 'SL', 'CC', '3A', '2A', '1A'))), ',') AS classes,
  list_has_any(u, ['1A', '2A', '3A', '3E', 'CC', 'EC', 'EA', 'EV']) AS ac FROM (
  SELECT number, list_distinct(classes || CASE WHEN kind = 'EXP' THEN ['GN', 'EC'] ELSE ['2S'] END) AS u FROM v_trains)
""")
def class_unions(net):
    other = F.when(F.col("kind") == "EXP", F.array(F.lit("GN"), F.lit("EC"))).otherwise(F.array(F.lit("2S")))
    every = score.classes_in_order(F.col("classes"), other)
    return net.trains().select("number", F.array_join(every, ",").alias("classes"), score.ac_available(every).alias("ac"))


@query("""
SELECT o_orderkey, CAST(s AS INTEGER) AS score, CASE WHEN s >= 65 THEN 'high' WHEN s >= 38 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN spike AND s >= 55 THEN 'Regional holiday rush expected' WHEN s >= 65 THEN 'Monsoon disruption likely' WHEN s >= 38 AND we THEN 'Weekend travel rush'
       WHEN s >= 38 THEN 'Some monsoon risk' ELSE 'Good time to travel' END AS label FROM (
  SELECT o_orderkey, we, h % 11 = 0 AS spike, greatest(4, least(96, CASE WHEN m IN (7, 8) THEN 60 WHEN m IN (6, 9) THEN 42 WHEN m IN (5, 10) THEN 28 ELSE 16 END
      + CASE WHEN we THEN 14 ELSE 0 END + h % 21 - 10 + CASE WHEN h % 11 = 0 THEN 22 ELSE 0 END)) AS s FROM (
    SELECT o_orderkey, month(d) AS m, isodow(d) >= 5 AS we,
      list_reduce(list_transform(string_split(strftime(d, '%Y-%m-%d'), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: (a * 31 + b) % 4294967296, CAST(0 AS BIGINT)) AS h
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)))
""")
def season_risk(net):
    return net.table("orders").withColumn("r", score.season_risk(F.to_date("o_orderdate"))).select("o_orderkey", "r.score", "r.level", "r.label")


@query("""
SELECT route_id, CASE WHEN reliability >= 85 THEN 'safe' WHEN reliability >= 60 THEN 'moderate' ELSE 'risky' END AS badge,
  CASE WHEN reliability >= 80 THEN 'safe' WHEN reliability >= 60 THEN 'moderate' ELSE 'risky' END AS bar,
  CASE WHEN reliability >= 70 THEN 'safe' WHEN reliability >= 40 THEN 'moderate' ELSE 'risky' END AS odds,
  CAST(least(92, 30 + fare // 6 + 9 * transfers) AS INTEGER) AS hub_score, CAST(greatest(5, least(90, 18 * (minutes % 7))) AS INTEGER) AS confirmability FROM v_routes
""")
def display_scores(net):
    from wayframe.operators.ranking import direct_confirmability, hub_score

    r = F.col("reliability")
    return net.routes().select(
        "route_id", score.tone(r, 85, 60).alias("badge"), score.tone(r, 80, 60).alias("bar"), score.tone(r, 70, 40).alias("odds"),
        hub_score(F.col("fare"), F.col("transfers")).alias("hub_score"), direct_confirmability(F.col("minutes") % 7).alias("confirmability"),
    )


@query("SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') AS INTEGER) AS age_days, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') > 180 AS stale FROM orders")
def model_ages(net):
    from wayframe.operators.model import model_age

    meta = net.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("trained_at"))
    return model_age(meta, F.lit("1998-06-01").cast("date")).select("o_orderkey", "age_days", "stale")


