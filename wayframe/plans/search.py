"""Trip search for a table of requests: places, railheads, journeys, scores, ranking, explanation."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import score
from ..functions.geo import haversine_km
from ..functions.text import slug
from ..operators import journeys, ranking, stations as places
from ..operators.fares import class_fares
from ..operators.boosting import QuantileBoost, predict_boosted
from ..operators.model import QuantileForest, predict_quantiles
from ..operators.userlog import validate_requests
from ..session import cut_lineage, cut_lineages, unbroadcast
from . import routes as build


@dataclass
class Tables:
    """What a search reads. ``stops`` carries ``detour_km``; ``trains`` days, months and classes as arrays."""

    cities: DataFrame
    stations: DataFrame
    stops: DataFrame
    trains: DataFrame
    delays: DataFrame
    distances: DataFrame
    knots: DataFrame
    fits: DataFrame
    calendar: DataFrame


@dataclass
class Settings:
    """Limits of a search; the defaults are the fixed values."""

    hub_min: int = fixed.HUB_MIN_TRAINS
    head_hub_min: int = fixed.HEAD_HUB_MIN_TRAINS
    top_hubs: int = fixed.TOP_HUBS
    max_wait: int = fixed.MAX_WAIT
    journeys: int = fixed.TOP_JOURNEYS
    few_directs: int = 3
    origin_ladder: list[float] = field(default_factory=lambda: list(fixed.ORIGIN_LADDER_KM))
    dest_ladder: list[float] = field(default_factory=lambda: list(fixed.DEST_LADDER_KM))
    near_named_km: float = 20.0
    guard_km: float = fixed.DETOUR_GUARD_KM
    state_of: Column | None = None


def demand(dates: DataFrame, calendar: DataFrame, day: str = "day") -> DataFrame:
    """Add demand score and drivers of a date, with the calendar at the day before, the day and the day after."""
    own = calendar.select(F.col("d").alias(day), F.col("kind").alias("__kind"), F.col("name").alias("__name")).dropDuplicates([day])
    around = calendar.select(
        F.explode(F.array(F.date_sub("d", 1), F.col("d"), F.date_add("d", 1))).alias(day), F.lit(True).alias("__near")
    ).distinct()
    joined = dates.join(own, day, "left").join(around, day, "left")
    points, drivers = score.demand_drivers(
        F.col("__kind"), F.col("__name"), F.coalesce("__near", F.lit(False)), F.col(day)
    )
    return joined.withColumn("demand_score", points).withColumn("demand_drivers", drivers).drop("__kind", "__name", "__near")


def dated(requests: DataFrame, as_of: Column) -> DataFrame:
    """Travel day, weekday, month and lead of each request; an invalid date counts as none."""
    day = F.try_to_date("date", "yyyy-MM-dd")
    names = F.array(*[F.lit(d) for d in fixed.WEEKDAYS])
    return (
        requests.withColumn("day", day).withColumn("dow", F.weekday("day"))
        .withColumn("day3", F.get(names, F.col("dow"))).withColumn("month", F.month("day"))
        .withColumn("days_out", F.datediff("day", as_of))
    )


def located(requests: DataFrame, t: Tables, s: Settings) -> DataFrame:
    """Requests with the coordinates of both places; those with an unknown place are left out."""
    texts = requests.select(F.col("from_place").alias("place")).unionByName(requests.select(F.col("to_place").alias("place")))
    found = unbroadcast(cut_lineage(places.geocode(texts, t.cities, t.stations, s.state_of, s.near_named_km)))
    o = found.select(F.col("place").alias("from_place"), F.col("name").alias("o_name"), F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"))
    d = found.select(F.col("place").alias("to_place"), F.col("name").alias("d_name"), F.col("lat").alias("d_lat"), F.col("lng").alias("d_lng"))
    return requests.join(o, "from_place").join(d, "to_place")


def railheads(trips: DataFrame, t: Tables, s: Settings) -> tuple[DataFrame, DataFrame]:
    def heads(lat: str, lng: str, ladder: list[float]) -> DataFrame:
        points = trips.select("request_id", F.col(lat).alias("lat"), F.col(lng).alias("lng"))
        out = places.nearest_railheads(points, t.stations, ladder, hub_min=s.head_hub_min)
        return out.drop("lat", "lng", "tier_km")

    o, d = cut_lineages(heads("o_lat", "o_lng", s.origin_ladder), heads("d_lat", "d_lng", s.dest_ladder))
    return o, d


def _ends(rides: DataFrame, o: DataFrame, d: DataFrame) -> DataFrame:
    """Rides with their railheads and the request's places; senseless ones removed."""
    b = o.select("request_id", F.col("code").alias("board"), F.col("km").alias("b_km"), F.col("head_lat").alias("b_lat"), F.col("head_lng").alias("b_lng"))
    a = d.select("request_id", F.col("code").alias("alight"), F.col("km").alias("a_km"), F.col("head_lat").alias("a_lat"), F.col("head_lng").alias("a_lng"))
    return rides.join(b, ["request_id", "board"]).join(a, ["request_id", "alight"])


def _sensible(rides: DataFrame, trips: DataFrame) -> DataFrame:
    spots = trips.select("request_id", "o_lat", "o_lng", "d_lat", "d_lng", "month")
    cols = [F.col(c) for c in ("b_lat", "b_lng", "a_lat", "a_lng", "o_lat", "o_lng", "d_lat", "d_lng")]
    return rides.join(spots, "request_id").filter(journeys.useful(*cols)).drop("o_lat", "o_lng", "d_lat", "d_lng")


def direct_rides(trips: DataFrame, o: DataFrame, d: DataFrame, t: Tables, s: Settings) -> DataFrame:
    """The best ride of each through train per request."""
    rides = journeys.direct(trips, o, d, t.stops, t.trains, guard_km=s.guard_km)
    ends = _sensible(_ends(rides, o, d), trips)
    season = t.trains.select(F.col("number").alias("train"), "months")
    ends = ends.join(season, "train", "left").filter(journeys.runs_in_month(F.col("months"), F.col("month")))
    return journeys.best_per_train(ends.drop("months", "month"), F.col("b_km") + F.col("a_km"))


Model = QuantileForest | QuantileBoost


def predicted(model: Model, rows: DataFrame) -> DataFrame:
    """Rows with the curve of either model, where a row may be predicted."""
    return predict_boosted(model, rows) if isinstance(model, QuantileBoost) else predict_quantiles(model, rows)


def leg_predictor(trips: DataFrame, t: Tables, model: Model):
    """Adds to first legs the ``p50`` of their arrival at the change, on the day of the trip."""

    def predict(legs: DataFrame) -> DataFrame:
        rows = legs.join(trips.select("request_id", "dow", "month"), "request_id")
        return predicted(model, delay_features(rows, t, "t1", "hub", "arr1", "arr1_day")).select(*legs.columns, "p50")

    return predict


def change_rides(trips: DataFrame, o: DataFrame, d: DataFrame, t: Tables, s: Settings, model: Model | None = None) -> DataFrame:
    """One-change journeys of the given requests."""
    wanted = trips.select("request_id")
    o_some = o.join(wanted, "request_id", "left_semi")
    d_some = d.join(wanted, "request_id", "left_semi")
    typical = t.delays.select("train_no", "p50")
    predict = None if model is None else leg_predictor(trips, t, model)
    found = journeys.one_change(
        trips, o_some, d_some, t.stops, t.trains, t.stations, typical, s.hub_min, s.top_hubs, s.max_wait, s.journeys,
        s.guard_km, predict,
    )
    ends = _sensible(_ends(found, o_some, d_some), trips)
    season = t.trains.select("number", "months")
    for train in ("t1", "t2"):
        months = season.select(F.col("number").alias(train), F.col("months").alias("__months"))
        ends = ends.join(months, train, "left").filter(journeys.runs_in_month(F.col("__months"), F.col("month"))).drop("__months")
    return ends.drop("month")


def delay_features(legs: DataFrame, t: Tables, train: str, station: str, arr: str, day: str) -> DataFrame:
    """Model features of a leg's arrival; NULL baseline where the train has too few observations."""
    base = t.delays.filter(F.col("n_obs") >= fixed.MIN_OBSERVATIONS).select(
        F.col("train_no").alias(train), F.col("avg_delay").alias("baseline")
    )
    cum = t.distances.select(F.col("train_number").alias(train), F.col("station_code").alias(station), F.col("cum_km").alias("dist_km"))
    total = t.distances.groupBy(F.col("train_number").alias(train)).agg(F.max("cum_km").alias("__total"))
    names = t.trains.select(F.col("number").alias(train), F.col("name").alias("__name"))
    out = legs.join(base, train, "left").join(cum, [train, station], "left").join(total, train, "left").join(names, train, "left")
    return (
        out.withColumn("tier_code", score.tier_code(score.infer_tier(F.col(train), F.col("__name"))).cast("double"))
        .withColumn("frac_route", F.when(F.col("__total") > 0, F.col("dist_km") / F.col("__total")))
        .withColumn("sched_hour", F.coalesce(F.floor(F.col(arr) / 60), F.lit(-1)).cast("double"))
        .withColumn("day_offset", F.greatest(F.coalesce(F.col(day), F.lit(1)) - 1, F.lit(0)).cast("double"))
        .drop("__total", "__name")
    )


def rail_legs(directs: DataFrame, changes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(routes, legs): one row per route, and one row per train leg of it."""
    d = directs.withColumn("route_key", F.concat_ws("-", "train", "board", "alight"))
    if changes is None:
        legs = ("t1", "board", "hub", "t2", "alight")
        changes = d.limit(0).select(
            "request_id", "b_km", "a_km", *[F.lit("").alias(c) for c in legs], F.lit(0).cast("bigint").alias("hub_trains"),
            *[F.lit(0).alias(c) for c in ("wait", "dep1", "arr1", "it1", "b1_seq", "a1_seq", "arr1_day", "dep2", "arr2", "it2", "b2_seq", "a2_seq", "arr2_day")],
        )
    c = changes.withColumn("route_key", F.concat(F.concat_ws("-", "t1", "hub", "t2"), F.lit(">"), F.col("alight"), F.lit("#"), F.col("b2_seq")))
    head = ["request_id", "route_key", "board", "alight", "b_km", "a_km"]
    none_text, none_int = F.lit(None).cast("string"), F.lit(None).cast("int")
    routes = d.select(
        *head, F.col("route_key").alias("route_id"), F.lit(0).alias("transfers"), none_int.alias("wait"),
        none_text.alias("change_at"), none_int.alias("hub_trains"),
    ).unionByName(
        c.select(*head, F.split_part("route_key", F.lit(">"), F.lit(1)).alias("route_id"), F.lit(1).alias("transfers"),
                 "wait", F.col("hub").alias("change_at"), "hub_trains")
    )

    def one(df, no, train, start, end, dep, arr, minutes, b_seq, a_seq, day):
        return df.select(
            "request_id", "route_key", F.lit(no).alias("leg_no"), F.col(train).alias("train"), F.col(start).alias("start"),
            F.col(end).alias("end"), F.col(dep).alias("dep"), F.col(arr).alias("arr"), F.col(minutes).alias("minutes"),
            (F.col(a_seq) - F.col(b_seq) - 1).alias("halts"), F.col(day).alias("arr_day"),
        )

    legs = (
        one(d, 1, "train", "board", "alight", "dep", "arr", "minutes", "b_seq", "a_seq", "a_day")
        .unionByName(one(c, 1, "t1", "board", "hub", "dep1", "arr1", "it1", "b1_seq", "a1_seq", "arr1_day"))
        .unionByName(one(c, 2, "t2", "hub", "alight", "dep2", "arr2", "it2", "b2_seq", "a2_seq", "arr2_day"))
    )
    return routes, legs


def scored_legs(legs: DataFrame, trips: DataFrame, t: Tables, model: Model | None = None) -> DataFrame:
    """Train legs with length, tier, delay profile, classes and fares."""
    info = t.trains.select(F.col("number").alias("train"), F.col("name").alias("train_name"), "classes", "days", "months")
    delays = t.delays.select(F.col("train_no").alias("train"), "avg_delay", "on_time_pct", "p90", "n_obs")
    when = trips.select("request_id", "dow", "month", "demand_score")
    work = legs.join(info, "train", "left").join(delays, "train", "left")  # where legs are by train already
    work = journeys.leg_km(work, t.distances, t.stations, "train", "start", "end", "minutes", "km").join(when, "request_id")
    work = work.withColumn("tier", score.infer_tier(F.col("train"), F.col("train_name")))
    curve = None
    if model is not None:
        keep = work.columns
        renamed = work.withColumnRenamed("avg_delay", "__avg").withColumnRenamed("p90", "__p90")
        ctx = delay_features(renamed, t, "train", "end", "arr", "arr_day")
        scored = predicted(model, ctx).drop("avg_delay", "p50", "p90")
        work = scored.withColumnRenamed("__avg", "avg_delay").withColumnRenamed("__p90", "p90").select(*keep, "curve")
        curve = F.col("curve")
    offset = F.when(F.col("dow").isNotNull(), F.col("arr_day") - 1)
    profile = score.delay_profile(
        F.col("tier"), F.col("km"), F.col("halts"), F.col("avg_delay"), F.col("on_time_pct"), F.col("p90"), F.col("n_obs"), offset, curve
    )
    offered = score.offered_classes(F.coalesce("classes", F.array().cast("array<string>")), F.col("tier"), F.col("train_name"))
    work = work.withColumn("profile", profile).withColumn("offered", offered)
    work = work.withColumn("multiplier", score.flexi_multiplier(F.col("tier"), F.col("demand_score")))
    # equal rides of different requests share their fares
    ride = ["train", "start", "end", "km", "tier", "multiplier"]
    priced = class_fares(work.select(*ride, "offered").dropDuplicates(ride), ride, t.knots, t.fits)
    return work.join(priced, ride, "left").select(
        "request_id", "route_key", "leg_no", "train", "train_name", "start", "end", "dep", "arr", "minutes", "halts",
        "km", "tier", "profile", "offered", "days", "months", "class_fares", "fare",
    )


def scored_routes(routes: DataFrame, legs: DataFrame, trips: DataFrame, o: DataFrame, d: DataFrame) -> DataFrame:
    """Rail routes with all numbers they are ranked by, from the one or two train legs of each.

    Texts and leg lists wait until the shown routes are chosen.
    """
    fields = [c for c in legs.columns if c not in ("request_id", "route_key")]
    row = F.struct(*fields)
    pair = legs.groupBy("request_id", "route_key").agg(
        F.max(F.when(F.col("leg_no") == 1, row)).alias("l1"), F.max(F.when(F.col("leg_no") == 2, row)).alias("l2")
    )
    b = o.select("request_id", F.col("code").alias("board"), F.col("name").alias("board_name"), F.col("trains").alias("head_trains"),
                 F.col("head_lat").alias("b_lat"), F.col("head_lng").alias("b_lng"))
    a = d.select("request_id", F.col("code").alias("alight"), F.col("name").alias("alight_name"),
                 F.col("head_lat").alias("a_lat"), F.col("head_lng").alias("a_lng"))
    asked = trips.select("request_id", "from_place", "to_place", "pref", "days_out", "month", "o_lat", "o_lng", "d_lat", "d_lng")
    # legs are wide, so they come last
    work = (
        routes.join(b, ["request_id", "board"]).join(a, ["request_id", "alight"]).join(asked, "request_id")
        .join(pair, ["request_id", "route_key"])
    )
    work = work.withColumn("first_km", F.col("b_km") * fixed.ROAD_FACTOR).withColumn("last_km", F.col("a_km") * fixed.ROAD_FACTOR)
    p1, p2 = F.col("l1.profile"), F.col("l2.profile")
    change = F.col("transfers") == 1
    safety = F.when(change, score.connection_safety(F.col("wait"), p1["avg_mins"], p1["curve"]))
    on_time = F.when(change, F.least(p1["on_time_pct"], p2["on_time_pct"])).otherwise(p1["on_time_pct"])
    sources = F.array(p1["source"], p2["source"])
    source = F.when(~change, p1["source"]).when(F.array_contains(sources, "predicted"), "predicted").when(
        (p1["source"] == "measured") & (p2["source"] == "measured"), "measured"
    ).otherwise("modelled")
    tier = F.when(change, score.heavier_tier(F.col("l1.tier"), F.col("l2.tier"))).otherwise(F.col("l1.tier"))
    classes = F.when(change, score.classes_in_order(F.col("l1.offered"), F.coalesce("l2.offered", F.array().cast("array<string>")))).otherwise(
        score.classes_in_order(F.col("l1.offered"))
    )
    work = work.withColumn("safety", safety).withColumn("on_time", on_time).withColumn("source", source)
    work = work.withColumn("classes", classes).withColumn("seat", score.confirmation(F.col("classes"), tier, F.col("days_out"), F.col("month")))
    rated = score.reliability(F.col("on_time"), F.col("safety"), F.col("transfers"), F.col("first_km"), F.col("seat.pct"))
    cross = change | (F.col("first_km") > 20)
    zero = F.lit(0)

    def by_road(cost):
        return F.when(F.col("first_km") > 2, cost(F.col("first_km"))).otherwise(zero) + F.when(F.col("last_km") > 2, cost(F.col("last_km"))).otherwise(zero)

    minutes = F.col("l1.minutes") + F.coalesce("l2.minutes", zero) + F.coalesce("wait", zero) + by_road(score.road_minutes)
    fare = F.col("l1.fare") + F.coalesce("l2.fare", zero) + by_road(score.road_fare)
    return work.select(
        "request_id", "route_key", F.col("route_id").alias("shown_id"), "pref", "from_place", "to_place",
        F.when(cross, "cross-origin").otherwise("direct").alias("route_type"), minutes.alias("minutes"), fare.alias("fare"),
        rated.alias("reliability"), "transfers", "wait", "safety", "on_time", "source",
        F.col("seat.pct").alias("confirmation_pct"), F.col("seat.state").alias("confirmation"),
        F.when(change, F.col("change_at")).when(cross, F.col("board")).alias("hub"),
        F.when(change, F.col("hub_trains")).otherwise(F.col("head_trains")).cast("int").alias("board_trains"),
        "board_name", F.col("board").alias("board_code"), "alight_name", F.col("l1.train").alias("first_train"),
        F.col("l1.train_name").alias("first_train_name"), F.col("l1.dep").alias("dep_min"), F.lit(False).alias("road_only"),
        score.ac_available(F.col("classes")).alias("ac_available"), "classes", "first_km", "last_km", "l1", "l2",
        "o_lat", "o_lng", "d_lat", "d_lng", "b_lat", "b_lng", "a_lat", "a_lng",
    )


def road_routes(trips: DataFrame, rail: DataFrame, o: DataFrame, d: DataFrame) -> DataFrame:
    """The road-only option, for short trips and for requests without any rail route, if both ends have a railhead."""
    for heads in (o, d):
        trips = trips.join(heads.select("request_id"), "request_id", "left_semi")
    served = rail.select("request_id").distinct().withColumn("__rail", F.lit(True))
    km = haversine_km(F.col("o_lat"), F.col("o_lng"), F.col("d_lat"), F.col("d_lng")) * fixed.ROAD_FACTOR
    work = trips.withColumn("km", km).join(served, "request_id", "left")
    work = work.filter((F.col("km") <= fixed.ROAD_ONLY_MAX_KM) | F.col("__rail").isNull())
    rid = F.concat(F.lit("road-"), slug(F.col("from_place")), F.lit("-"), slug(F.col("to_place")))
    known = {c: F.col(c) for c in ("request_id", "pref", "from_place", "to_place", "o_lat", "o_lng", "d_lat", "d_lng")}
    known |= {
        "route_key": rid, "shown_id": rid, "route_type": F.lit("direct"),
        "minutes": F.greatest(F.lit(15), score.road_minutes(F.col("km"))), "fare": score.road_fare(F.col("km")),
        "reliability": F.lit(fixed.ROAD_RELIABILITY), "transfers": F.lit(0), "confirmation": F.lit("confirmed"),
        "road_only": F.lit(True), "classes": F.array().cast("array<string>"), "first_km": F.col("km"),
    }
    types = dict(rail.dtypes)
    return work.select(*[known.get(c, F.lit(None)).cast(types[c]).alias(c) for c in rail.columns])


def explained(routes: DataFrame, stations: DataFrame) -> DataFrame:
    """Shown routes with their legs, score parts, reasons and main train."""
    hub = stations.select(F.col("code").alias("hub"), F.col("name").alias("hub_name"), F.col("lat").alias("h_lat"), F.col("lng").alias("h_lng"))
    work = routes.join(hub, "hub", "left")
    change, road = F.col("transfers") == 1, F.col("road_only")
    p1 = F.col("l1.profile")
    o_spot, d_spot = build.spot(F.col("o_lng"), F.col("o_lat")), build.spot(F.col("d_lng"), F.col("d_lat"))
    b_spot, a_spot = build.spot(F.col("b_lng"), F.col("b_lat")), build.spot(F.col("a_lng"), F.col("a_lat"))
    h_spot = build.spot(F.col("h_lng"), F.col("h_lat"))

    def rail(leg: str, start_name, end_name, start_spot, end_spot):
        c = lambda f: F.col(f"{leg}.{f}")
        return build.train_leg(c("train"), c("train_name"), start_name, end_name, c("dep"), c("arr"), c("minutes"), c("fare"), start_spot, end_spot)

    one = F.array(rail("l1", F.col("board_name"), F.col("alight_name"), b_spot, a_spot))
    two = F.array(
        rail("l1", F.col("board_name"), F.col("hub"), b_spot, h_spot),
        build.change_leg(F.col("hub"), F.col("board_trains"), F.col("wait"), F.col("safety")),
        rail("l2", F.col("hub"), F.col("alight_name"), h_spot, a_spot),
    )
    by_rail = build.with_access(
        F.when(change, two).otherwise(one), F.col("first_km"), F.col("last_km"), F.col("from_place"), F.col("to_place"),
        F.col("board_name"), F.col("alight_name"), o_spot, b_spot, a_spot, d_spot,
    )
    cab = build.cab_leg(F.col("from_place"), F.col("to_place"), F.col("first_km"), o_spot, d_spot)
    cab = cab.withField("name", F.concat(F.lit("Road · "), F.col("from_place"), F.lit(" → "), F.col("to_place")))

    def part(label, value):
        return F.struct(F.lit(label).alias("label"), F.lit(value).alias("value"), F.lit(None).cast("int").alias("weight"))

    road_parts = F.array(part("No transfers", 100), part("Always available", 90), part("Door to door", 95))
    parts = build.breakdown(F.col("transfers"), F.col("confirmation_pct"), F.col("on_time"), F.col("source"), F.col("safety"), F.col("first_km"))
    main = F.when(change & (F.col("l2.minutes") > F.col("l1.minutes")), F.col("l2")).otherwise(F.col("l1"))
    why = (
        F.when(road, build.why_road(F.col("first_km"), F.col("minutes")))
        .when(change, build.why_change(F.col("hub"), F.col("board_trains"), F.col("wait"), F.col("safety")))
        .otherwise(build.why_direct(
            F.col("board_name"), F.col("first_km"), F.col("board_trains"), F.col("route_type") == "cross-origin",
            F.col("on_time"), F.col("source"), F.col("confirmation_pct"),
        ))
    )
    advice = build.own_plan_b(
        F.col("transfers"), p1["p90"], F.col("source"), F.col("confirmation_pct"), F.col("safety"), F.col("hub"), F.col("board_trains")
    )
    inner = ["l1", "l2", "o_lat", "o_lng", "d_lat", "d_lng", "b_lat", "b_lng", "a_lat", "a_lng", "h_lat", "h_lng"]
    return (
        work.withColumn("legs", F.when(road, F.array(cab)).otherwise(by_rail))
        .withColumn("breakdown", F.when(road, road_parts).otherwise(parts))
        .withColumn("why", why).withColumn("plan_b", F.when(~road, advice))
        .withColumn("main_train", main["train"]).withColumn("class_fares", main["class_fares"])
        .withColumn("days", main["days"]).withColumn("delay", p1).drop(*inner)
    )


def rebuilt_routes(route_ids: DataFrame, t: Tables, model: Model | None = None, guard_km: float = fixed.DETOUR_GUARD_KM) -> DataFrame:
    """The whole scored and explained route of each ``train-board-alight`` id, from station to station and without a date."""
    rides = cut_lineage(journeys.rebuild_direct(route_ids, t.stops, guard_km))
    place = t.stations.select("code", "name", "lat", "lng", "num_trains")
    spot = lambda end: place.select(F.col("code").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("name", "lat", "lng", "num_trains")])
    known = rides.join(spot("board"), "board").join(spot("alight"), "alight").withColumn("request_id", F.col("route_id"))
    nothing = {"pref": "string", "days_out": "int", "month": "int", "dow": "int", "o_lat": "double", "o_lng": "double", "d_lat": "double", "d_lng": "double"}
    trips = known.select(
        "request_id", F.col("board_name").alias("from_place"), F.col("alight_name").alias("to_place"), F.lit(0).alias("demand_score"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()],
    )

    def head(end: str) -> DataFrame:
        return known.select(
            "request_id", F.col(end).alias("code"), F.col(f"{end}_name").alias("name"), F.col(f"{end}_num_trains").alias("trains"),
            F.lit(0.0).alias("km"), F.col(f"{end}_lat").alias("head_lat"), F.col(f"{end}_lng").alias("head_lng"),
        )

    directs = known.select("request_id", *[c for c in rides.columns if c != "route_id"], F.lit(0.0).alias("b_km"), F.lit(0.0).alias("a_km"))
    routes, legs = rail_legs(directs, None)
    scored = scored_legs(legs, trips, t, model)
    return explained(scored_routes(routes, scored, trips, head("board"), head("alight")), t.stations)


class TripSearch:
    """The search of a table of requests, step by step.

    Steps that later ones read more than once (places, railheads, through rides, routes) are
    checkpointed when first asked for, so a lost executor costs one step and nothing is computed
    twice. Only the steps an answer needs are run. Tables that grow with requests or trains are not broadcast: their
    files are small for their rows.
    """

    def __init__(
        self, requests: DataFrame, tables: Tables, as_of: Column, settings: Settings | None = None,
        model: Model | None = None,
    ):
        large = {c: unbroadcast(getattr(tables, c)) for c in ("cities", "stops", "trains", "delays", "distances")}
        self.tables, self.settings, self.model = replace(tables, **large), settings or Settings(), model
        self.valid, self.rejected = validate_requests(unbroadcast(requests))
        self.as_of = as_of

    @cached_property
    def trips(self) -> DataFrame:
        rows = demand(dated(self.valid, self.as_of), self.tables.calendar)
        return unbroadcast(cut_lineage(located(rows, self.tables, self.settings)))

    @cached_property
    def heads(self) -> tuple[DataFrame, DataFrame]:
        o, d = railheads(self.trips, self.tables, self.settings)
        return unbroadcast(o), unbroadcast(d)

    @cached_property
    def directs(self) -> DataFrame:
        return unbroadcast(cut_lineage(direct_rides(self.trips, *self.heads, self.tables, self.settings)))

    @cached_property
    def changes(self) -> DataFrame:
        """One-change journeys, only of requests with few through trains."""
        counts = self.directs.groupBy("request_id").agg(F.count(F.lit(1)).alias("__n"))
        joined = self.trips.join(counts, "request_id", "left")
        few = unbroadcast(joined.filter(F.coalesce("__n", F.lit(0)) < self.settings.few_directs).drop("__n"))
        return unbroadcast(cut_lineage(change_rides(few, *self.heads, self.tables, self.settings, self.model)))

    @cached_property
    def rail(self) -> DataFrame:
        """All scored rail routes."""
        routes, legs = rail_legs(self.directs, self.changes)
        scored = scored_legs(legs, self.trips, self.tables, self.model)
        return unbroadcast(cut_lineage(scored_routes(routes, scored, self.trips, *self.heads)))

    @cached_property
    def shown(self) -> DataFrame:
        """The ranked and cut list per request, road option included."""
        every = self.rail.unionByName(road_routes(self.trips, self.rail, *self.heads))
        chosen = ranking.cap_routes(every.withColumn("route_id", F.col("route_key")))
        return unbroadcast(cut_lineage(explained(chosen, self.tables.stations)))

    @cached_property
    def routes(self) -> DataFrame:
        """The shown routes with the next train as plan B where one follows."""
        planned = ranking.plan_b(self.shown)
        name = self.shown.filter(~F.col("road_only")).select(
            "request_id", F.col("route_id").alias("plan_b_route"),
            F.concat(F.col("first_train"), F.lit(" "), F.coalesce("first_train_name", F.lit(""))).alias("__next"),
        )
        planned = planned.join(name, ["request_id", "plan_b_route"], "left")
        text = ranking.plan_b_text(F.trim("__next"), F.col("plan_b_dep"), F.col("plan_b_fare"), F.col("plan_b_minutes"))
        return planned.withColumn("plan_b", F.coalesce(text, F.col("plan_b"))).drop("__next")

    @cached_property
    def unanswered(self) -> DataFrame:
        """Requests without any route and why: not valid, a place that is not found, or no railhead in reach."""
        placed = self.trips.select("request_id")
        headed = placed
        for heads in self.heads:
            headed = headed.join(heads.select("request_id"), "request_id", "left_semi")

        def why(df: DataFrame, reason: str) -> DataFrame:
            return df.select("request_id", F.lit(reason).alias("reason"))

        return (
            why(self.rejected, "invalid_request")
            .unionByName(why(self.valid.join(placed, "request_id", "left_anti"), "place_not_found"))
            .unionByName(why(placed.join(headed, "request_id", "left_anti"), "no_railhead"))
        )

    @cached_property
    def reasoning(self) -> DataFrame:
        by_board = self.directs.groupBy("request_id", F.col("board").alias("code")).agg(F.count(F.lit(1)).cast("int").alias("directs"))
        heads = self.heads[0].select("request_id", "code", "name", F.col("trains").cast("int").alias("trains"), "km")
        to_name = self.trips.select("request_id", F.col("d_name").alias("to_name"))
        return ranking.reasoning(self.shown.join(to_name, "request_id"), heads, by_board)

    @cached_property
    def advisory(self) -> DataFrame:
        advice = score.demand_advisory(F.col("demand_score"), F.col("demand_drivers"))
        rows = self.trips.select("request_id", advice.alias("advisory"), "demand_drivers")
        return rows.filter(F.col("advisory").isNotNull())
