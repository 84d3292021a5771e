import pytest
from pyspark.sql import functions as F

from wayframe.functions import score, text
from wayframe.plans import routes as build


def curve(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_curve_mean_of_skewed_symmetric_and_negative(one):
    got = one(
        skewed=score.curve_mean(curve(0, 10, 30, 60, 150, 500)),
        even=score.curve_mean(curve(20, 35, 50, 65, 80, 95)),
        negative=score.curve_mean(curve(-5, -1, 2, 10, 20, 40)),
    )
    assert got["skewed"] > 30 and 40 <= got["even"] <= 60 and got["negative"] >= 0


def test_curve_cdf_is_bounded_and_rising(spark):
    rows = spark.range(0, 600, 5).select(score.curve_cdf(curve(0, 10, 30, 60, 150, 500), F.col("id")).alias("p")).orderBy("id").collect()
    values = [r["p"] for r in rows]
    assert all(0.02 <= v <= 0.99 for v in values)
    assert values[:100] == sorted(values[:100])
    assert values[-1] == 0.97


def test_connection_safety(one):
    got = one(
        short=score.connection_safety(F.lit(20), F.lit(60.0)), tight=score.connection_safety(F.lit(35), F.lit(60.0)),
        long=score.connection_safety(F.lit(180), F.lit(60.0)),
        by_curve=score.connection_safety(F.lit(60), F.lit(5.0), curve(0, 10, 30, 60, 150, 500)),
    )
    assert got["short"] is None and 35 <= got["tight"] < got["long"] <= 98 and got["by_curve"] == 75


@pytest.mark.parametrize(
    "number,name,tier",
    [("12951", "Mumbai RAJDHANI", "premium"), ("12345", "X", "superfast"), ("54321", "X", "passenger"), ("19037", "X", "express"), ("02123", None, "superfast")],
)
def test_tiers(one, number, name, tier):
    assert one(t=score.infer_tier(F.lit(number), F.lit(name)))["t"] == tier


def profile(n, curve_col=None, offset=0):
    return score.delay_profile(
        F.lit("express"), F.lit(500.0), F.lit(5), F.lit(41.6), F.lit(55.4), F.lit(120.0), F.lit(n), F.lit(offset), curve_col
    )


def test_delay_profile_tiers(one):
    q = curve(0, 10, 30, 60, 150, 500)
    got = one(much=profile(31558), little=profile(3), predicted=profile(500, q), thin=profile(3, q), late=profile(31558, None, 2))
    assert (got["much"]["source"], got["much"]["avg_mins"], got["much"]["on_time_pct"]) == ("measured", 42, 55)
    assert (got["little"]["source"], got["little"]["n_obs"]) == ("modelled", 0)
    assert (got["predicted"]["source"], got["predicted"]["p50"], got["predicted"]["on_time_pct"]) == ("predicted", 30, 50)
    assert got["thin"]["source"] == "modelled" and got["late"]["multi_day"] and not got["much"]["multi_day"]


def test_min_buffer_covers_the_typical_delay(one):
    got = one(none=score.min_buffer(F.lit(None).cast("double")), mid=score.min_buffer(F.lit(47.5)), high=score.min_buffer(F.lit(200.0)), low=score.min_buffer(F.lit(3.0)))
    assert got == {"none": 30, "mid": 48, "high": 90, "low": 30}


def test_demand_order_and_flexi_fares(spark, one):
    from wayframe.plans.search import demand
    from wayframe.sources.files import calendar_table

    days = spark.createDataFrame([("2026-07-14",), ("2026-07-18",), ("2026-11-08",), (None,)], "d string").withColumn("day", F.to_date("d"))
    score_of = {r["d"]: r["demand_score"] for r in demand(days, calendar_table(spark)).collect()}
    assert score_of["2026-07-14"] == 0 < score_of["2026-07-18"] < score_of["2026-11-08"] and score_of[None] == 0
    got = one(
        plain=score.flexi_multiplier(F.lit("express"), F.lit(90)), calm=score.flexi_multiplier(F.lit("premium"), F.lit(0)),
        mid=score.flexi_multiplier(F.lit("premium"), F.lit(40)), top=score.flexi_multiplier(F.lit("premium"), F.lit(90)),
    )
    assert got["plain"] == got["calm"] == 1.0 < got["mid"] < got["top"] <= 1.4


def test_confidence_and_access(one):
    got = one(a=score.confidence(F.lit(0)), b=score.confidence(F.lit(50)), c=score.confidence(F.lit(500)), d=score.confidence(F.lit(5000)),
              near=score.access_score(F.lit(5.0)), far=score.access_score(F.lit(300.0)), none=score.access_score(F.lit(None).cast("double")))
    assert [got[k] for k in "abcd"] == ["none", "limited", "moderate", "high"]
    assert got["near"] > got["far"] and got["none"] == 100


def test_premium_class_lists(one):
    listed = F.array(*[F.lit(c) for c in ["SL", "3A", "2A", "1A", "CC", "EC"]])
    got = one(
        sitting=score.offered_classes(listed, F.lit("premium"), F.lit("AJMER SHATABDI")),
        sleeper=score.offered_classes(listed, F.lit("premium"), F.lit("TEJAS RAJ EXP")),
        vande=score.offered_classes(listed, F.lit("premium"), F.lit("VANDE BHARAT SL")),
        plain=score.offered_classes(listed, F.lit("express"), F.lit("MAIL")),
        never_empty=score.offered_classes(F.array(F.lit("GN")), F.lit("premium"), F.lit("RAJDHANI")),
    )
    assert got["sitting"] == ["CC", "EC"] and got["sleeper"] == got["vande"] == ["3A", "2A", "1A"]
    assert len(got["plain"]) == 6 and got["never_empty"] == ["GN"]


def test_weights_add_up(one):
    def weights(transfers):
        parts = build.breakdown(F.lit(transfers), F.lit(70), F.lit(50), F.lit("measured"), F.lit(None).cast("int"), F.lit(10.0))
        return F.aggregate(parts, F.lit(0), lambda a, p: a + p["weight"])

    assert one(d=weights(0), c=weights(1)) == {"d": 100, "c": 100}


def test_clock_and_number_text(one):
    got = one(
        ok=text.parse_clock(F.lit(" 7:05 ")), bad=text.parse_clock(F.lit("24:00")), word=text.parse_clock(F.lit("Source")),
        minutes=text.clock_minutes(F.lit("23:59:30")), none=text.clock_minutes(F.lit("None")), back=text.minutes_clock(F.lit(65)),
        number=text.norm_train_no(F.lit(" 00123 ")), zeros=text.norm_train_no(F.lit("000")), inr=text.format_inr(F.lit(1234567)),
        label=text.day_month_label(F.lit("2025-13-40"), F.lit(None).cast("timestamp")),
    )
    assert got == {"ok": "07:05", "bad": None, "word": None, "minutes": 1439, "none": None, "back": "01:05", "number": "123",
                   "zeros": "000", "inr": "₹12,34,567", "label": None}


def test_similarity_counts_word_grams(one):
    got = one(same=text.trigram_similarity(F.lit("Pune"), F.lit("pune")), near=text.trigram_similarity(F.lit("kanyakumari"), F.lit("kanniyakumari")))
    assert got["same"] == 1.0 and 0.45 < got["near"] < 1


def test_road_refinement_keeps_the_wait(spark):
    spot = lambda x: build.spot(F.lit(x), F.lit(20.0))
    cab = build.cab_leg(F.lit("Home"), F.lit("B"), F.lit(20.0), spot(70.0), spot(70.2)).withField("minutes", F.lit(30))
    ride = build.train_leg(F.lit("1"), F.lit("X"), F.lit("B"), F.lit("A"), F.lit(60), F.lit(660), F.lit(600), F.lit(300))
    routes = spark.range(1).select(
        F.lit("r").alias("route_id"), F.array(cab, build.road_note(F.lit(28.0), F.lit("B")), ride).alias("legs"), F.lit(None).cast("int").alias("wait"),
        F.lit(630).alias("minutes"), F.lit(360).alias("fare"), F.lit("").alias("why"), F.lit(False).alias("road_only"),
    )
    roads = spark.createDataFrame([(20.0, 70.0, 20.0, 70.2, 12.0, 18.0)], "from_lat double, from_lng double, to_lat double, to_lng double, km double, mins double")
    once = build.upgrade_road_legs(routes, roads)
    row, again = once.first(), build.upgrade_road_legs(once, roads).first()
    assert row["minutes"] == 618 and row["legs"][1]["note"].startswith("~12 km road to") and row == again


def test_routes_are_sent_once_per_cab_leg(spark):
    """Routes without a cab leg, or without a second one, are not shuffled to a road that they do not have."""
    spot = lambda x: build.spot(F.lit(x), F.lit(20.0))
    first = build.cab_leg(F.lit("Home"), F.lit("B"), F.lit(20.0), spot(70.0), spot(70.2))
    last = build.cab_leg(F.lit("A"), F.lit("End"), F.lit(20.0), spot(71.0), spot(71.2))
    ride = build.train_leg(F.lit("1"), F.lit("X"), F.lit("B"), F.lit("A"), F.lit(60), F.lit(660), F.lit(600), F.lit(300))
    legs = F.when(F.col("id") == 0, F.array(ride)).when(F.col("id") == 1, F.array(first, ride)).when(F.col("id") == 2, F.array(first, ride, last))
    routes = spark.range(4).select(
        F.col("id").alias("route_id"), legs.alias("legs"), F.lit(0).alias("wait"), F.lit(1).alias("minutes"), F.lit(1).alias("fare"),
        F.lit("").alias("why"), F.lit(False).alias("road_only"),
    )
    roads = spark.createDataFrame(
        [(20.0, 70.0, 20.0, 70.2, 12.0, 18.0), (20.0, 71.0, 20.0, 71.2, 9.0, 11.0)],
        "from_lat double, from_lng double, to_lat double, to_lng double, km double, mins double",
    )
    out = build.upgrade_road_legs(routes, roads)
    got = {r["route_id"]: ([leg["minutes"] for leg in r["legs"] or []], r["minutes"]) for r in out.collect()}
    assert got == {0: ([600], 1), 1: ([18, 600], 618), 2: ([18, 600, 11], 629), 3: ([], 1)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("__cabs") >= 3


def test_isotonic_over_many_chunks(spark):
    """Distances beyond any width and far more blocks than a task pools, rising, falling and ragged."""
    import numpy as np

    from wayframe.operators import fares

    rng = np.random.default_rng(4)
    curves = {
        "UP": [(float(k), float(k)) for k in range(1, 200)], "DOWN": [(50.0 * k, 1000.0 - k) for k in range(1, 200)],
        "RAGGED": [(100.0 * k, float(k + rng.normal() * 30)) for k in range(1, 201)],
    }
    rows = [(c, km, max(1.0, fare)) for c, points in curves.items() for km, fare in points]
    df = spark.createDataFrame(rows, "class_code string, km double, fare double")
    whole = {(r["class_code"], r["km"]): r["fare"] for r in fares.fit_isotonic(df).collect()}
    small = {(r["class_code"], r["km"]): r["fare"] for r in fares.fit_isotonic(df, points_per_task=8).collect()}
    assert whole.keys() == small.keys() and all(abs(whole[k] - small[k]) < 1e-9 for k in whole)
    for c in curves:
        fitted = [whole[k] for k in sorted(whole) if k[0] == c]
        assert fitted == sorted(fitted)
    assert len({v for k, v in whole.items() if k[0] == "DOWN"}) == 1 and max(k[1] for k in whole) == 20000.0


def test_trigram_candidates_stay_near_the_results(spark):
    """Names that share a word: partners meet on their rarer grams only."""
    from wayframe.operators import naming

    names = spark.range(600).selectExpr("concat('city_', id) AS name")
    queries = names.selectExpr("name AS query")
    out = naming.trigram_matches(queries, names).cache()
    found = {(r["query"], r["name"]) for r in out.collect()}

    def grams(text):
        out = set()
        for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
            padded = f"  {w} "
            out |= {padded[i : i + 3] for i in range(len(padded) - 2)}
        return out

    sets = {f"city_{i}": grams(f"city_{i}") for i in range(600)}
    want = {(a, b) for a in sets for b in sets if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.45}
    assert found == want
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
