"""Ranking, diversifying, filtering, tagging and explaining the routes of each request.

``routes`` has request_id, route_id, pref, fare, minutes, reliability, transfers, route_type, hub,
first_train, dep_min and road_only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import format_duration, is_late_night, minutes_clock, in_departure_windows
from .segments import full_rank

KEYS = ["k1", "k2", "k3", "k4"]


def sort_keys(pref: Column) -> list[Column]:
    """Ascending sort keys of a preference; the route id breaks the last tie."""
    def pick(cheap, fast, safe):
        return F.when(pref == "cheapest", cheap).when(pref == "fastest", fast).otherwise(safe)

    zero = F.lit(0)
    cross = F.when(F.col("route_type") == "cross-origin", 1).otherwise(0)
    return [
        pick(F.col("fare"), F.col("minutes"), F.col("transfers")).cast("int").alias("k1"),
        pick(zero, zero, -F.col("reliability")).cast("int").alias("k2"),
        pick(zero, zero, cross).cast("int").alias("k3"),
        pick(zero, zero, F.col("minutes")).cast("int").alias("k4"),
    ]


def with_keys(routes: DataFrame) -> DataFrame:
    return routes.select("*", *sort_keys(F.col("pref")))


def _order(prefix: list[str] | None = None) -> list[Column]:
    return [F.col(c) for c in [*(prefix or []), *KEYS, "route_id"]]


def rank_routes(routes: DataFrame) -> DataFrame:
    """``position`` of every route of a request under its preference; no list is cut."""
    ranked = full_rank(with_keys(routes), ["request_id"], [F.col("k1"), F.col("k2")], _order(), "position")
    return ranked.drop(*KEYS)


def simple_rank(routes: DataFrame) -> DataFrame:
    """As ``rank_routes`` but by reliability alone where no other preference is set."""
    k1 = F.when(F.col("pref") == "cheapest", F.col("fare")).when(F.col("pref") == "fastest", F.col("minutes")).otherwise(
        -F.col("reliability")
    )
    work = routes.withColumn("k1", k1.cast("int"))
    return full_rank(work, ["request_id"], [F.col("k1")], [F.col("k1"), F.col("route_id")], "position").drop("k1")


def overflow_flags(routes: DataFrame, per_hub: int = 2) -> DataFrame:
    """``overflow`` is 1 for change routes past two per hub or one per (hub, first train)."""
    keyed = with_keys(routes) if "k1" not in routes.columns else routes
    change = keyed.filter(F.col("transfers") > 0).withColumn("__hub", F.coalesce("hub", F.lit("_x")))
    order = F.struct(*KEYS, "route_id")
    first = change.groupBy("request_id", "__hub", "first_train").agg(F.min(order).alias("o"))
    over = W.partitionBy("request_id", "__hub").orderBy("o")
    kept = first.withColumn("__rn", F.row_number().over(over)).filter(F.col("__rn") <= per_hub)
    kept = kept.select("request_id", F.col("o.route_id").alias("route_id"), F.lit(1).alias("__kept"))
    return (
        keyed.join(kept, ["request_id", "route_id"], "left")
        .withColumn("overflow", F.when((F.col("transfers") == 0) | (F.col("__kept") == 1), 0).otherwise(1))
        .drop("__kept")
    )


def diversify(routes: DataFrame, per_hub: int = 2) -> DataFrame:
    """All routes with their position: kept ones first, overflow appended, each in rank order."""
    flagged = overflow_flags(routes, per_hub)
    bucket = [F.col("overflow"), F.col("k1"), F.col("k2")]
    return full_rank(flagged, ["request_id"], bucket, _order(["overflow"]), "position").drop(*KEYS)


def cap_routes(routes: DataFrame, rail: int = 15, total: int = 16) -> DataFrame:
    """The shown list: the first rail routes after diversifying, every road route, ranked again."""
    flagged = overflow_flags(routes)
    over = W.partitionBy("request_id").orderBy(*_order(["overflow"]))
    by_rail = flagged.filter(~F.col("road_only")).withColumn("__rn", F.row_number().over(over))
    kept = by_rail.filter(F.col("__rn") <= rail).drop("__rn").unionByName(flagged.filter("road_only"))
    again = W.partitionBy("request_id").orderBy(*_order())
    return (
        kept.withColumn("position", F.row_number().over(again)).filter(F.col("position") <= total)
        .drop("overflow", *KEYS)
    )


def plan_b(routes: DataFrame) -> DataFrame:
    """The route to take when one is missed: next later first departure of the same request.

    ``routes`` has ``position``. The best route per (request, departure minute) is taken first, at
    most 1440 rows per request, and the one after each departure is looked up among these.
    """
    rail = routes.filter(~F.col("road_only") & F.col("dep_min").isNotNull())
    slot = rail.groupBy("request_id", "dep_min").agg(
        F.min_by(F.struct("route_id", "fare", "minutes", "dep_min"), "position").alias("best")
    )
    over = W.partitionBy("request_id").orderBy("dep_min")
    after = slot.select("request_id", "dep_min", F.lead("best").over(over).alias("alt"))
    return routes.join(after, ["request_id", "dep_min"], "left").select(
        *[c for c in routes.columns if c != "alt"],
        F.when(~F.col("road_only"), F.col("alt.route_id")).alias("plan_b_route"),
        F.when(~F.col("road_only"), F.col("alt.dep_min")).alias("plan_b_dep"),
        F.when(~F.col("road_only"), F.col("alt.fare")).alias("plan_b_fare"),
        F.when(~F.col("road_only"), F.col("alt.minutes")).alias("plan_b_minutes"),
    )


def plan_b_text(name: Column, dep: Column, fare: Column, minutes: Column) -> Column:
    return F.concat(
        F.lit("Miss it? Next train: "), name, F.lit(" departing "), minutes_clock(dep), F.lit(" — ₹"),
        fare.cast("string"), F.lit(", "), format_duration(minutes), F.lit(" door to door."),
    )


def tag_best(routes: DataFrame) -> DataFrame:
    """Cheapest and fastest route per request; the first of the list on a tie."""
    best = routes.groupBy("request_id").agg(
        F.min_by("route_id", F.struct("fare", "position")).alias("__cheap"),
        F.min_by("route_id", F.struct("minutes", "position")).alias("__fast"),
    )
    cheap, fast = F.col("route_id") == F.col("__cheap"), F.col("route_id") == F.col("__fast")
    tag = F.when(cheap & fast, "Cheapest & fastest").when(cheap, "Cheapest").when(fast, "Fastest")
    return routes.join(best, "request_id").withColumn("tag", tag).drop("__cheap", "__fast")


def filter_routes(
    routes: DataFrame, ac_only: bool = False, no_transfers: bool = False, avoid_late: bool = False,
    travel_class: str | None = None, windows: list[str] | None = None,
) -> DataFrame:
    """Result filters; ``legs`` is an array of structs with mode, depart and arrive."""
    out = routes
    if ac_only:
        out = out.filter(F.coalesce(F.col("ac_available"), F.col("fare") >= 600))
    if no_transfers:
        out = out.filter(F.col("transfers") <= 0)
    if avoid_late:
        arriving = F.filter("legs", lambda l: (l["mode"] != "connection") & l["arrive"].isNotNull())
        last = F.try_element_at(arriving, F.lit(-1))["arrive"]
        out = out.filter(~F.coalesce(is_late_night(last), F.lit(False)))
    if travel_class:
        out = out.filter(F.col("classes").isNull() | F.array_contains("classes", travel_class))
    if windows:
        trains = F.filter("legs", lambda l: (l["mode"] == "train") & l["depart"].isNotNull())
        depart = F.try_element_at(trains, F.lit(1))["depart"]
        out = out.filter(depart.isNull() | in_departure_windows(depart, F.array(*[F.lit(w) for w in windows])))
    return out


def hub_choices(routes: DataFrame) -> DataFrame:
    """Cross-origin routes per hub: how many, the best one and its first leg."""
    cross = routes.filter((F.col("route_type") == "cross-origin") & F.col("hub").isNotNull())
    return cross.groupBy("request_id", "hub").agg(
        F.count(F.lit(1)).alias("routes"),
        F.min_by("route_id", "position").alias("best_route"),
        F.min_by("first_mile_minutes", "position").alias("first_mile_minutes"),
        F.min_by("first_mile_fare", "position").alias("first_mile_fare"),
    )


def compare_best(routes: DataFrame) -> DataFrame:
    """The first direct route beside the first cross-origin one, or beside the next route at all."""
    direct = F.col("route_type") == "direct"
    pos = F.col("position")
    ends = routes.groupBy("request_id").agg(
        F.min(F.when(direct, pos)).alias("d"),
        F.min(F.when(~direct, pos)).alias("c"),
        # the two first positions are enough to step over the direct route
        F.min(pos).alias("p1"),
        F.min(F.when(pos > 1, pos)).alias("p2"),
    )
    other = F.when(F.col("d").isNull() | (F.col("p1") != F.col("d")), F.col("p1")).otherwise(F.col("p2"))
    chosen = ends.select("request_id", "d", F.coalesce("c", other).alias("a"))
    row = routes.select("request_id", "position", "route_id", "route_type")
    left = row.select("request_id", F.col("position").alias("d"), F.col("route_id").alias("direct_route"))
    right = row.select(
        "request_id", F.col("position").alias("a"), F.col("route_id").alias("alt_route"), F.col("route_type").alias("alt_type")
    )
    return (
        chosen.join(left, ["request_id", "d"], "left").join(right, ["request_id", "a"], "left")
        .select("request_id", "direct_route", "alt_route", F.coalesce(F.col("alt_type") == "direct", F.lit(False)).alias("all_direct"))
    )


def corridor_benchmark(routes: DataFrame, known: DataFrame, limit_pct: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Fastest route against the known hours per corridor, and the overall deviation."""
    fastest = routes.groupBy("corridor").agg(F.min("minutes").alias("minutes"))
    hours = F.col("minutes") / 60
    rows = known.join(fastest, "corridor", "left").select(
        "corridor", "known_hours", F.round(hours, 6).alias("engine_hours"),
        F.round((hours - F.col("known_hours")) / F.col("known_hours") * 100, 6).alias("deviation_pct"),
    )
    verdict = (
        F.when(F.col("deviation_pct").isNull(), "NO ROUTE")
        .when(F.abs("deviation_pct") <= limit_pct, "OK").otherwise("SUSPICIOUS")
    )
    rows = rows.withColumn("verdict", verdict)
    summary = rows.agg(
        F.count("deviation_pct").alias("compared"),
        F.round(F.avg(F.abs("deviation_pct")), 6).alias("mean_abs_pct"),
        F.round(F.max(F.abs("deviation_pct")), 6).alias("worst_pct"),
    )
    return rows, summary


def hub_score(trains: Column, directs: Column) -> Column:
    return F.least(F.lit(92), 30 + F.floor(trains / 6).cast("int") + 9 * directs.cast("int"))


def direct_confirmability(directs: Column) -> Column:
    return F.greatest(F.lit(5), F.least(F.lit(90), directs.cast("int") * 18))


def reasoning(routes: DataFrame, heads: DataFrame, directs: DataFrame) -> DataFrame:
    """Why the first route of each request wins, with up to four railheads scanned.

    ``heads`` are the origin railheads (at most twelve per request), ``directs`` the direct trains
    per (request_id, code), ``routes`` have position, board_name and hub_name, and to_name.
    """
    top = routes.filter(F.col("position") == 1).select(
        "request_id", "route_type", "transfers", "hub", "hub_name", "board_name", "board_trains", "to_name"
    )
    true_direct = routes.groupBy("request_id").agg(
        F.count_if((F.col("transfers") == 0) & (F.col("route_type") == "direct")).alias("n_direct")
    )
    known = heads.join(directs, ["request_id", "code"], "left").withColumn("directs", F.coalesce("directs", F.lit(0)).cast("int"))
    known = known.withColumn("pct", hub_score(F.col("trains"), F.col("directs")))
    entry = F.struct(
        (-F.col("directs")).alias("o1"), (-F.col("trains")).alias("o2"), "code", "name", "trains", "directs", "pct", "km"
    )
    listed = known.groupBy("request_id").agg(F.array_sort(F.collect_list(entry)).alias("heads"))  # at most twelve
    work = top.join(true_direct, "request_id").join(listed, "request_id", "left")
    heads_col = F.coalesce("heads", F.expr("cast(array() as array<struct<o1:int,o2:int,code:string,name:string,trains:int,directs:int,pct:int,km:double>>)"))
    work = work.withColumn("heads", heads_col)
    is_direct = (F.col("transfers") == 0) & (F.col("route_type") == "direct")

    also = F.transform(
        F.filter(F.slice("heads", 1, 2), lambda h: h["name"] != F.col("board_name")),
        lambda h: _hub_row(h, F.lit(False), F.concat(F.bround(h["km"]).cast("int").cast("string"), F.lit(" km away"))),
    )
    # the hub of the winning route always shows, of the four scanned heads three others at most
    scanned = F.slice("heads", 1, 4)
    shown = F.filter(scanned, lambda h, i: (h["code"] == F.col("hub")) | (i < 3))
    hubs = F.transform(
        shown,
        lambda h: _hub_row(
            h, F.coalesce(h["code"] == F.col("hub"), F.lit(False)),
            F.when(h["directs"] > 0, F.concat(h["directs"].cast("string"), F.lit(" through train(s)"))).otherwise("no through train"),
        ),
    )
    missing = F.col("hub").isNotNull() & ~F.exists(shown, lambda h: h["code"] == F.col("hub"))
    extra = F.array(
        F.struct(
            F.col("hub_name").alias("name"), F.coalesce("board_trains", F.lit(0)).cast("int").alias("trains"),
            F.lit(70).alias("pct"), F.lit(True).alias("winner"), F.lit("best onward connections").alias("note"),
        )
    )
    hubs = F.when(missing, F.concat(hubs, extra)).otherwise(hubs)
    hub_directs = F.coalesce(
        F.try_element_at(F.filter("heads", lambda h: h["code"] == F.col("hub")), F.lit(1))["directs"], F.lit(0)
    )
    others = F.exists("heads", lambda h: (h["directs"] > 0) & ~F.coalesce(h["code"] == F.col("hub"), F.lit(False)))
    board_directs = F.coalesce(
        F.try_element_at(F.filter("heads", lambda h: (h["name"] == F.col("board_name")) & (h["directs"] > 0)), F.lit(1))["directs"],
        F.col("n_direct").cast("int"),
    )
    n = F.col("n_direct").cast("string")
    via = F.concat(F.lit("Via "), F.coalesce("hub_name", F.lit("")), F.lit(" wins — "))
    conclusion = (
        F.when(
            is_direct,
            F.concat(F.lit("Direct wins — "), n, F.lit(" through-train option(s) from "), F.coalesce("board_name", F.lit("")),
                     F.lit(", no detour or change of train needed.")),
        )
        .when(
            (hub_directs > 0) & ~others,
            F.concat(via, F.lit("the only nearby railhead with a through train to "), F.col("to_name"),
                     F.lit(": one road hop, then no change of train.")),
        )
        .when(
            hub_directs > 0,
            F.concat(via, hub_directs.cast("string"), F.lit(" through train(s) to "), F.col("to_name"),
                     F.lit(" and the best door-to-door time scanned.")),
        )
        .otherwise(
            F.concat(via, F.lit("no railhead here has a through train; "), F.coalesce("hub_name", F.lit("")),
                     F.lit(" offers the safest one-change link."))
        )
    )
    return work.select(
        "request_id",
        F.when(is_direct, "direct").otherwise("cross-origin").alias("mode"),
        F.when(is_direct, F.col("board_name")).alias("winner_name"),
        F.when(is_direct, board_directs).alias("winner_trains"),
        F.when(~is_direct, direct_confirmability(F.col("n_direct"))).alias("direct_confirmability"),
        F.when(~is_direct, F.when(F.col("n_direct") > 0, F.concat(n, F.lit(" local through option(s)"))).otherwise("no through train from here")).alias("direct_note"),
        F.when(is_direct, also).otherwise(hubs).alias("hubs"),
        conclusion.alias("conclusion"),
    )


def _hub_row(h: Column, winner: Column, note: Column) -> Column:
    return F.struct(
        h["name"].alias("name"), h["trains"].cast("int").alias("trains"), h["pct"].alias("pct"),
        winner.alias("winner"), note.alias("note"),
    )


def reasoning_items(reasons: DataFrame, from_col: str = "from_name", to_col: str = "to_name") -> DataFrame:
    """The reasoning as an ordered list of (kind, title, sub)."""
    direct = F.col("mode") == "direct"
    title = F.concat(F.lit("Direct "), F.col(from_col), F.lit(" → "), F.col(to_col))
    size = F.size("hubs")
    plural = F.when(size > 1, "s").otherwise("")

    def item(kind, head, sub):
        return F.struct(kind.alias("kind"), head.alias("title"), sub.alias("sub"))

    none = F.lit(None).cast("string")
    first = F.when(
        direct, item(F.lit("directWin"), title, F.concat(F.coalesce(F.col("winner_trains").cast("string"), F.lit("")), F.lit(" daily direct trains")))
    ).otherwise(
        item(F.lit("directFail"), title, F.concat(F.col("direct_confirmability").cast("string"), F.lit("% confirmable · "), F.col("direct_note")))
    )
    scan = F.when(
        direct, F.when(size > 0, item(F.lit("scan"), F.concat(F.lit("Also checked "), size.cast("string"), F.lit(" nearby hub"), plural), none))
    ).otherwise(item(F.lit("scan"), F.concat(F.lit("Scanned "), size.cast("string"), F.lit(" nearby hub"), plural), none))
    hubs = F.transform(
        "hubs",
        lambda h: item(
            F.when(direct | ~h["winner"], "muted").otherwise("winner"), h["name"],
            F.when(direct, h["note"]).otherwise(
                F.concat(h["trains"].cast("string"), F.lit("/day · "), h["pct"].cast("string"), F.lit("%"))
            ),
        ),
    )
    return reasons.withColumn("items", F.concat(F.array_compact(F.array(first, scan)), hubs))
