"""Direct and one-change journeys for a whole table of requests.

Rides are ordered stop pairs of one train. Pairs of stops meet by (train, span of boarding stops), so
a train that holds a large part of all stops is spread over as many keys as it has spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from ..functions.geo import haversine_km
from ..functions.score import min_buffer
from ..session import cut_lineage, unbroadcast
from .segments import full_rank


def runs_on(days: Column, day3: Column) -> Column:
    """No date or unknown running days pass; else the weekday must be listed."""
    return day3.isNull() | days.isNull() | (F.size(days) == 0) | F.array_contains(days, day3)


def runs_in_month(months: Column, month: Column) -> Column:
    """Trains of all year pass; seasonal ones only in their months and never without a date."""
    seasonal = months.isNotNull() & (F.size(months) > 0)
    return ~seasonal | F.coalesce(F.array_contains(months, month), F.lit(False))


def _boards(stops: DataFrame, guard: bool, guard_km: float) -> DataFrame:
    rows = stops
    if guard and "detour_km" in stops.columns:
        rows = rows.filter(F.col("detour_km") <= guard_km)
    return rows.select(
        F.col("train_number").alias("train"), F.col("station_code").alias("board"), F.col("seq").alias("b_seq"),
        F.coalesce("dep_min", "arr_min").alias("dep"), F.col("day").alias("b_day"),
    ).filter(F.col("dep").isNotNull())


def _alights(stops: DataFrame, guard: bool, guard_km: float) -> DataFrame:
    rows = stops
    if guard and "detour_km" in stops.columns:
        rows = rows.filter(F.col("detour_km") <= guard_km)
    return rows.select(
        F.col("train_number").alias("train"), F.col("station_code").alias("alight"), F.col("seq").alias("a_seq"),
        F.coalesce("arr_min", "dep_min").alias("arr"), F.col("day").alias("a_day"),
    ).filter(F.col("arr").isNotNull())


#: Stops of a train in a span.
SPAN = 512


def _span(seq: Column, span: int = SPAN) -> Column:
    return F.floor(seq / span).cast("bigint")


def _ride(b: DataFrame, a: DataFrame, on: list[str], span: int = SPAN) -> DataFrame:
    """Later alightings of each boarding. An alighting goes to the spans up to its own: to one, on all but very long trains."""
    b = b.withColumn("__span", _span(F.col("b_seq"), span))
    a = a.withColumn("__span", F.explode(F.sequence(F.lit(0).cast("bigint"), _span(F.col("a_seq"), span))))
    minutes = (F.col("a_day") - F.col("b_day")) * fixed.DAY_MINUTES + F.col("arr") - F.col("dep")
    return (
        b.join(a, [*on, "__span"]).drop("__span").filter(F.col("a_seq") > F.col("b_seq"))
        .withColumn("minutes", minutes.cast("int")).filter(F.col("minutes") > 0)
    )


def ride_pairs(
    stops: DataFrame, board_codes: DataFrame, alight_codes: DataFrame,
    guard_board: bool, guard_alight: bool, guard_km: float = fixed.DETOUR_GUARD_KM, span: int = SPAN,
) -> DataFrame:
    """Rides of one train between a wanted boarding and a wanted alighting station."""
    b = _boards(stops, guard_board, guard_km).join(board_codes.select(F.col("code").alias("board")).distinct(), "board", "left_semi")
    a = _alights(stops, guard_alight, guard_km).join(alight_codes.select(F.col("code").alias("alight")).distinct(), "alight", "left_semi")
    return _ride(b, a, ["train"], span)


def _numbers(codes: DataFrame) -> DataFrame:
    """(code, no): distinct codes with numbers from 1, each below 2^31."""
    group = F.pmod(F.xxhash64("code"), F.lit(1024))
    return cut_lineage(full_rank(codes.dropna().distinct(), [], [group], [F.col("code")], "no").select("code", "no"))


def direct(
    requests: DataFrame, o_heads: DataFrame, d_heads: DataFrame, stops: DataFrame, trains: DataFrame,
    guard_km: float = fixed.DETOUR_GUARD_KM, span: int = SPAN,
) -> DataFrame:
    """Every (board, alight) ride of one train from an origin head to a destination head.

    Rides between stations that some request uses are one table for all requests, which meet them on
    (board, alight): at most 12 by 12 rows per request. These are most of the work, so they carry no codes: both stations
    are one number.
    """
    numbers = _numbers(o_heads.select("code").unionByName(d_heads.select("code")))
    o = o_heads.select("request_id", "code").join(numbers, "code").select("request_id", F.col("no").alias("__b"))
    d = d_heads.select("request_id", "code").join(numbers, "code").select("request_id", F.col("no").alias("__a"))
    both = F.shiftleft(F.col("__b").cast("bigint"), 32).bitwiseOR(F.col("__a").cast("bigint")).alias("__both")
    pairs = ride_pairs(stops, o_heads.select("code"), d_heads.select("code"), True, True, guard_km, span)
    for code, no in (("board", "__b"), ("alight", "__a")):
        pairs = pairs.join(numbers.select(F.col("code").alias(code), F.col("no").alias(no)), code)
    pairs = pairs.select("train", "board", "b_seq", "dep", "b_day", "alight", "a_seq", "arr", "a_day", "minutes", both)
    rides = o.join(d, "request_id").select("request_id", both).join(pairs, "__both").drop("__both")
    info = trains.select(F.col("number").alias("train"), "days")
    when = requests.select("request_id", "day3")
    return (
        rides.join(info, "train", "left").join(when, "request_id")
        .filter(runs_on(F.col("days"), F.col("day3")))
        .select("request_id", "train", "board", "b_seq", "dep", "b_day", "alight", "a_seq", "arr", "a_day", "minutes")
    )


def useful(b_lat, b_lng, a_lat, a_lng, o_lat, o_lng, d_lat, d_lng, slack_km: float = 5.0) -> Column:
    """The ride must end clearly nearer to the destination and not nearer to the origin."""
    nearer = haversine_km(a_lat, a_lng, d_lat, d_lng) < haversine_km(b_lat, b_lng, d_lat, d_lng) - slack_km
    away = haversine_km(a_lat, a_lng, o_lat, o_lng) > haversine_km(b_lat, b_lng, o_lat, o_lng) - slack_km
    return F.coalesce(nearer & away, F.lit(True))


def best_per_train(rides: DataFrame, access: Column) -> DataFrame:
    """The ride with the least road access per (request, train); then the shorter one, then codes."""
    order = F.struct(access.alias("access_km"), F.col("minutes"), F.col("board"), F.col("alight"), F.col("b_seq"), F.col("a_seq"))
    keep = [c for c in rides.columns if c not in ("request_id", "train")]
    best = rides.withColumn("__o", order).groupBy("request_id", "train").agg(
        F.min_by(F.struct(*keep), "__o").alias("r"), F.min("__o.access_km").alias("access_km")
    )
    return best.select("request_id", "train", "r.*", "access_km")


def _reached_hubs(rides: DataFrame, hubs: DataFrame, limit: DataFrame) -> DataFrame:
    """(board, hub, hub_trains, place, kept): the busiest hubs of each board, on some day among the first ``limit``.

    ``rides`` carries ``on``, one bit per weekday and one for no date; ``kept`` has the bits of the days on which the
    hub is among the first. ``place`` is its place among all hubs of the board.
    """
    pairs = rides.groupBy("board", F.col("alight").alias("hub")).agg(F.bit_or("on").alias("on")).join(hubs, "hub")
    order = W.partitionBy("board").orderBy(F.desc("hub_trains"), "hub")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    days = range(len(fixed.WEEKDAYS) + 1)
    ranked = pairs.withColumn("place", F.row_number().over(order))
    for d in days:
        ranked = ranked.withColumn(f"__r{d}", F.sum(F.when(F.col("on").bitwiseAND(1 << d) != 0, 1).otherwise(0)).over(so_far))
    ranked = ranked.withColumn("__one", F.lit(1)).join(limit, "__one")
    bits = [F.when((F.col("on").bitwiseAND(1 << d) != 0) & (F.col(f"__r{d}") <= F.col("__limit")), 1 << d).otherwise(0) for d in days]
    kept = bits[0]
    for bit in bits[1:]:
        kept = kept.bitwiseOR(bit)
    return ranked.withColumn("kept", kept).filter(F.col("kept") != 0).select("board", "hub", "hub_trains", "place", "kept")


def best_first_legs(
    requests: DataFrame, o_heads: DataFrame, d_heads: DataFrame, stops: DataFrame, trains: DataFrame,
    hubs: DataFrame, top_hubs: int = fixed.TOP_HUBS, guard_km: float = fixed.DETOUR_GUARD_KM,
) -> DataFrame:
    """The shortest ride per (request, hub), for the busiest hubs a request reaches.

    The hubs of each board are ranked first, by the days on which some ride reaches them, and only so many are kept as a
    request can use after its own railheads are left out. The shortest rides to these are listed per (board, day),
    busiest hub first; a request takes the first ``top_hubs`` of each list that are not its own: no other can matter.
    """
    info = trains.select(F.col("number").alias("train"), "days")
    hub_codes = hubs.select(F.col("code"))
    bits = F.lit(1)
    for i, d in enumerate(fixed.WEEKDAYS, 1):
        bits = bits.bitwiseOR(F.when(runs_on(F.col("days"), F.lit(d)), 1 << i).otherwise(0))
    rides = ride_pairs(stops, o_heads.select("code"), hub_codes, True, False, guard_km).join(info, "train", "left").select(
        "board", "alight", "minutes", "train", "b_seq", "a_seq", "dep", "arr", F.col("a_day").alias("arr_day"), bits.alias("on")
    )
    rides = unbroadcast(cut_lineage(rides))  # read for the hubs and for the rides to them
    busy = hubs.select(F.col("code").alias("hub"), F.col("num_trains").alias("hub_trains")).distinct()
    own = o_heads.select("request_id", F.col("code").alias("hub")).unionByName(
        d_heads.select("request_id", F.col("code").alias("hub"))
    ).join(busy.select("hub").distinct(), "hub", "left_semi").groupBy("request_id").agg(F.collect_set("hub").alias("own"))
    own = unbroadcast(cut_lineage(own))
    # a request drops its own heads and keeps its busiest hubs, so of each board no more can matter
    limit = F.broadcast(own.agg((F.coalesce(F.max(F.size("own")), F.lit(0)) + top_hubs).alias("__limit"), F.lit(1).alias("__one")))  # one row
    ride = F.struct("minutes", "train", "b_seq", "a_seq", "dep", "arr", "arr_day")
    some = _reached_hubs(rides, busy, limit)
    days = F.filter(F.array(*[F.lit(d) for d in range(len(fixed.WEEKDAYS) + 1)]), lambda d: F.getbit(F.col("on").bitwiseAND(F.col("kept")), d) != 0)
    best = (
        rides.withColumnRenamed("alight", "hub").join(some, ["board", "hub"]).withColumn("day_no", F.explode(days))
        .groupBy("board", "hub", "day_no", "hub_trains").agg(F.min(ride).alias("r"), F.min("place").alias("place"))
    )
    listed = best.groupBy("board", "day_no").agg(F.array_sort(F.collect_list(F.struct("place", "hub", "hub_trains", "r"))).alias("reach"))
    listed = cut_lineage(listed)  # few rows, for which all rides were sent
    names = F.array(*[F.lit(d) for d in fixed.WEEKDAYS])
    day_no = F.when(F.col("day3").isNull(), 0).otherwise(F.array_position(names, F.col("day3"))).cast("int")
    o = o_heads.select("request_id", F.col("code").alias("board")).join(
        requests.select("request_id", day_no.alias("day_no")), "request_id"
    ).join(own, "request_id", "left")
    others = F.filter("reach", lambda x: F.col("own").isNull() | ~F.array_contains("own", x["hub"]))
    ride = F.struct("minutes", "train", "board", "b_seq", "a_seq", "dep", "arr", "arr_day")
    reached = (
        o.join(listed, ["board", "day_no"]).select("request_id", "board", F.explode(F.slice(others, 1, top_hubs)).alias("x"))
        .select("request_id", "board", "x.hub", "x.hub_trains", "x.r.*")
        .repartition("request_id")  # for the shortest ride to a hub and the ranks of hubs; so few rows that none stays behind
        .groupBy("request_id", "hub", "hub_trains").agg(F.min(ride).alias("r"))
        .select("request_id", "hub", "hub_trains", "r.*")
    )
    over = W.partitionBy("request_id").orderBy(F.desc("hub_trains"), "hub")
    return (
        reached.withColumn("__rn", F.row_number().over(over)).filter(F.col("__rn") <= top_hubs)
        .select(
            "request_id", "hub", "hub_trains", F.col("train").alias("t1"), "board", F.col("b_seq").alias("b1_seq"),
            F.col("a_seq").alias("a1_seq"), F.col("dep").alias("dep1"), F.col("arr").alias("arr1"),
            F.col("arr_day").alias("arr1_day"), F.col("minutes").alias("it1"),
        )
    )


#: Minutes of a departure bucket; a divisor of the day.
BUCKET = 240


def connections(
    first_legs: DataFrame, requests: DataFrame, d_heads: DataFrame, stops: DataFrame, trains: DataFrame, hubs: DataFrame,
    max_wait: int = fixed.MAX_WAIT, guard_km: float = fixed.DETOUR_GUARD_KM,
) -> DataFrame:
    """Second legs that leave the hub inside the wait window; first reachable head per second train.

    ``first_legs`` carries ``min_buf``. Second legs are keyed by (hub, alight, bucket of their departure), and an arrival
    goes to the buckets that its wait covers, over midnight too: a busy hub is spread over its destinations and the
    day, and few legs outside the wait are met. Only arrivals with some ride from their hub to the railhead go that far.
    """
    info = trains.select(F.col("number").alias("train"), "days")
    rides = ride_pairs(stops, hubs.select("code"), d_heads.select("code"), False, True, guard_km).join(info, "train", "left")
    second = rides.select(
        F.col("board").alias("hub"), "alight", F.col("train").alias("t2"), F.col("b_seq").alias("b2_seq"),
        F.col("a_seq").alias("a2_seq"), F.col("dep").alias("dep2"), F.col("arr").alias("arr2"),
        F.col("a_day").alias("arr2_day"), F.col("minutes").alias("it2"), "days",
    )
    second = unbroadcast(cut_lineage(second))  # read for the pairs of stations and for the rides
    wanted = (
        first_legs.join(requests.select("request_id", "day3"), "request_id")
        .join(d_heads.select("request_id", F.col("code").alias("alight")), "request_id")
        .join(second.select("hub", "alight").distinct(), ["hub", "alight"], "left_semi")
    )
    met = _met(wanted, second, max_wait).filter(runs_on(F.col("days"), F.col("day3"))).drop("days", "day3")
    met = met.repartition("request_id")  # whatever is then sought among the journeys of a request is found in place
    keep = [c for c in met.columns if c not in ("request_id", "hub", "t2", "b2_seq")]
    first = met.groupBy("request_id", "hub", "t2", "b2_seq").agg(F.min_by(F.struct(*keep), "a2_seq").alias("r"))
    return first.select("request_id", "hub", "t2", "b2_seq", "r.*").withColumn(
        "cost", F.col("it1") + F.col("wait") + F.col("it2")
    )


def _spread(wanted: DataFrame, max_wait: int, bucket: int) -> DataFrame:
    """Arrivals, once per bucket of departures that their wait covers; a wait of a whole day and more covers each once."""
    day, count = fixed.DAY_MINUTES, fixed.DAY_MINUTES // bucket
    first = F.floor((F.col("arr1") + F.col("min_buf")) / bucket)
    last = F.least(F.floor((F.col("arr1") + F.lit(min(max_wait, day - 1))) / bucket), first + F.lit(count - 1))
    buckets = F.transform(F.sequence(first, F.greatest(first, last)), lambda x: F.pmod(x, F.lit(count)).cast("int"))
    return wanted.where(F.col("min_buf") <= max_wait).withColumn("__bucket", F.explode(buckets))


def _met(wanted: DataFrame, second: DataFrame, max_wait: int, bucket: int = BUCKET) -> DataFrame:
    """Arrivals and the departures of other trains within their wait, with ``wait``; each pair once."""
    keyed = second.withColumn("__bucket", F.floor(F.col("dep2") / bucket).cast("int"))
    wait = F.pmod(F.col("dep2") - F.col("arr1"), F.lit(fixed.DAY_MINUTES))
    return (
        _spread(wanted, max_wait, bucket).join(keyed, ["hub", "alight", "__bucket"]).drop("__bucket").withColumn("wait", wait.cast("int"))
        .filter((F.col("t2") != F.col("t1")) & (F.col("wait") >= F.col("min_buf")) & (F.col("wait") <= max_wait))
    )


def one_change(
    requests: DataFrame, o_heads: DataFrame, d_heads: DataFrame, stops: DataFrame, trains: DataFrame,
    stations: DataFrame, p50_of: DataFrame | None = None, hub_min: int = fixed.HUB_MIN_TRAINS,
    top_hubs: int = fixed.TOP_HUBS, max_wait: int = fixed.MAX_WAIT, k: int = fixed.TOP_JOURNEYS,
    guard_km: float = fixed.DETOUR_GUARD_KM, predict=None,
) -> DataFrame:
    """The ``k`` shortest journeys with one change per request.

    ``p50_of`` (train_no, p50) is the typical delay that sets the least buffer; ``predict`` maps the
    first legs to the same rows with a ``p50`` for the travel date, NULL where it has none.
    """
    hubs = stations.filter(F.col("num_trains") >= hub_min).select("code", "num_trains")
    legs = best_first_legs(requests, o_heads, d_heads, stops, trains, hubs, top_hubs, guard_km)
    if predict is not None:
        legs = predict(legs).withColumnRenamed("p50", "__p50")
    else:
        legs = legs.withColumn("__p50", F.lit(None).cast("double"))
    if p50_of is not None:
        known = p50_of.select(F.col("train_no").alias("t1"), F.col("p50").alias("__flat"))
        legs = legs.join(known, "t1", "left").withColumn("__p50", F.coalesce("__p50", "__flat")).drop("__flat")
    legs = legs.withColumn("min_buf", min_buffer(F.col("__p50"))).drop("__p50")
    met = connections(legs, requests, d_heads, stops, trains, hubs, max_wait, guard_km)
    keep = [c for c in met.columns if c not in ("request_id", "board", "hub", "alight")]
    best = met.groupBy("request_id", "board", "hub", "alight").agg(
        F.min_by(F.struct(*keep), F.struct("cost", "t2", "b2_seq", "a2_seq")).alias("r")
    ).select("request_id", "board", "hub", "alight", "r.*")
    over = W.partitionBy("request_id").orderBy("cost", "hub", "alight", "t1", "t2")
    return best.withColumn("position", F.row_number().over(over)).filter(F.col("position") <= k)


def station_distances(stops: DataFrame) -> DataFrame:
    """(train, station, cum_km); the last stop counts where a train calls twice."""
    return stops.filter(F.col("cum_km").isNotNull()).groupBy("train_number", "station_code").agg(
        F.max_by("cum_km", "seq").alias("cum_km")
    )


#: Distances of a train that go to its legs as one row.
DISTANCES = 512


def _with_cum_km(legs: DataFrame, cumulative: DataFrame, train: str, start: str, end: str, limit: int = DISTANCES) -> DataFrame:
    """Legs with the distances ``__c1`` and ``__c2`` of both ends on their train, NULL where it has none.

    The distances of a train go to its legs as one row, so that legs move once for both ends. Where some train has more
    than ``limit``, they meet each end on (train, station). A station that is listed twice gives a row for each.
    """
    cum = cumulative.select(F.col("train_number").alias(train), F.col("station_code").alias("s"), F.col("cum_km").alias("c"))
    known = unbroadcast(cut_lineage(cum.dropna(subset=[train, "s"]).groupBy(train).agg(F.collect_list(F.struct("s", "c")).alias("__km"))))
    if not known.filter(F.size("__km") > limit).isEmpty():
        c1 = cum.select(train, F.col("s").alias(start), F.col("c").alias("__c1"))
        c2 = cum.select(train, F.col("s").alias(end), F.col("c").alias("__c2"))
        return legs.join(c1, [train, start], "left").join(c2, [train, end], "left")

    def at(station: str) -> Column:
        here = F.filter("__km", lambda x: x["s"] == F.col(station))
        return F.explode_outer(F.transform(here, lambda x: x["c"]))

    return legs.join(known, train, "left").withColumn("__c1", at(start)).withColumn("__c2", at(end)).drop("__km")


def leg_km(
    legs: DataFrame, cumulative: DataFrame, stations: DataFrame, train: str, start: str, end: str,
    minutes: str, name: str = "rail_km",
) -> DataFrame:
    """Rail length of a leg: measured difference, else great circle by a factor, else from the time."""
    s1 = stations.select(F.col("code").alias(start), F.col("lat").alias("__y1"), F.col("lng").alias("__x1"))
    s2 = stations.select(F.col("code").alias(end), F.col("lat").alias("__y2"), F.col("lng").alias("__x2"))
    out = _with_cum_km(legs, cumulative, train, start, end).join(s1, start, "left").join(s2, end, "left")
    measured = F.nullif(F.abs(F.col("__c2") - F.col("__c1")), F.lit(0.0))
    circle = haversine_km(F.col("__y1"), F.col("__x1"), F.col("__y2"), F.col("__x2")) * fixed.RAIL_FACTOR
    km = F.coalesce(measured, circle, F.col(minutes) / 60 * fixed.RAIL_KMPH)
    return out.withColumn(name, km).drop("__c1", "__c2", "__y1", "__x1", "__y2", "__x2")


def leg_points(legs: DataFrame, stops: DataFrame, keys: list[str]) -> DataFrame:
    """Stations passed on each leg, one row per stop (``pos`` is the stop number). They meet by span of the train."""
    path = stops.select(
        F.col("train_number").alias("train"), F.col("seq").alias("pos"), F.col("station_code").alias("code"), _span(F.col("seq")).alias("__span")
    )
    passed = legs.withColumn("__span", F.explode(F.sequence(_span(F.col("b_seq")), _span(F.col("a_seq")))))
    return passed.join(path, ["train", "__span"]).filter((F.col("pos") >= F.col("b_seq")) & (F.col("pos") <= F.col("a_seq"))).select(
        *keys, "pos", "code"
    )


def leg_paths(points: DataFrame, stations: DataFrame, keys: list[str]) -> DataFrame:
    """Stop names and drawn coordinates per leg, for the few legs that are shown.

    Coordinates equal to the one before are left out; fewer than two points or names give NULL.
    """
    place = stations.select("code", "name", "lat", "lng")
    rows = points.join(place, "code", "left")
    stop = F.struct("pos", F.coalesce("name", "code").alias("name"), "lat", "lng")
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(stop)).alias("p"))
    located = F.filter("p", lambda x: x["lat"].isNotNull())
    spots = F.transform(located, lambda x: F.struct(x["lng"].alias("lng"), x["lat"].alias("lat")))
    coords = drop_repeats(spots)
    names = F.transform("p", lambda x: x["name"])
    return listed.select(
        *keys,
        F.when(F.size(names) >= 2, names).alias("stops"),
        F.when(F.size(coords) >= 2, coords).alias("coords"),
    )


def drop_repeats(items: Column) -> Column:
    """Array without elements equal to the one before."""
    return F.filter(items, lambda x, i: (i == 0) | (F.get(items, i - 1) != x))


def parse_direct_id(route_id: Column) -> Column:
    """(train, board, alight) of ``train-board-alight``; NULL for other ids, also those that end in digits."""
    parts = F.split(route_id, "-")
    fits = (F.size(parts) == 3) & F.get(parts, F.lit(0)).rlike(r"^\d+$") & ~F.get(parts, F.lit(2)).rlike(r"^\d+$")
    return F.when(
        fits,
        F.struct(
            F.get(parts, F.lit(0)).alias("train"), F.get(parts, F.lit(1)).alias("board"), F.get(parts, F.lit(2)).alias("alight")
        ),
    )


def rebuild_direct(route_ids: DataFrame, stops: DataFrame, guard_km: float = fixed.DETOUR_GUARD_KM) -> DataFrame:
    """The first ride of each ``train-board-alight`` id, straight from the timetable."""
    # the id is its three parts, so that only these are sent, and boardings carry the id to its alightings
    key = ["train", "board", "alight"]
    ids = route_ids.select(parse_direct_id(F.col("route_id")).alias("p")).filter(F.col("p").isNotNull()).select("p.*")
    ids = cut_lineage(ids.distinct())
    boarded = cut_lineage(ids.join(_boards(stops, True, guard_km), ["train", "board"]))
    rides = _ride(boarded, _alights(stops, True, guard_km), ["train", "alight"])
    keep = [c for c in rides.columns if c not in key]
    first = rides.groupBy(*key).agg(F.min_by(F.struct(*keep), F.struct("b_seq", "a_seq")).alias("r"))
    columns = ["train", "board", "b_seq", "dep", "b_day", "alight", "a_seq", "arr", "a_day", "minutes"]
    return first.select(F.concat_ws("-", *key).alias("route_id"), *key, "r.*").select("route_id", *columns)


def point_along(path: DataFrame, keys: list[str], pos: str, share: float) -> DataFrame:
    """The point at a share of the planar length of each path (``lng``, ``lat`` by position)."""
    from .segments import segmented

    step = segmented(path, keys, pos, nexts={"__next": F.struct("lng", "lat")}).filter(F.col("__next").isNotNull())
    dx, dy = F.col("__next.lng") - F.col("lng"), F.col("__next.lat") - F.col("lat")
    step = cut_lineage(step.withColumn("__d", F.sqrt(dx * dx + dy * dy)))
    run = segmented(step, keys, pos, sums={"__upto": F.col("__d")})
    total = step.groupBy(*keys).agg(F.sum("__d").alias("__total"))
    target = F.lit(share) * F.col("__total")
    hit = run.join(total, keys).filter(target <= F.col("__upto") + 1e-9)
    first = hit.groupBy(*keys).agg(F.min_by(F.struct("lng", "lat", "__next", "__d", "__upto", "__total"), pos).alias("r"))
    part = F.when(F.col("r.__d") == 0, 0.0).otherwise(
        (F.lit(share) * F.col("r.__total") - (F.col("r.__upto") - F.col("r.__d"))) / F.col("r.__d")
    )
    return first.select(
        *keys, (F.col("r.lng") + part * (F.col("r.__next.lng") - F.col("r.lng"))).alias("lng"),
        (F.col("r.lat") + part * (F.col("r.__next.lat") - F.col("r.lat"))).alias("lat"),
    )
