"""Places and stations: nearest railheads, geocoding, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from ..functions.geo import cell, cells_within, haversine_km, step_for
from ..functions.text import place_alias, place_hint, place_name, strip_parens
from ..session import cut_lineage
from .naming import substring_matches, trigram_matches


#: Points in a task of a radius search, and points for which the stations are copied once.
POINTS_PER_TASK, POINTS_PER_PIECE = 4096, 131_072


def within_km(points: DataFrame, stations: DataFrame, radius_km: float) -> DataFrame:
    """Points (``lat``, ``lng``) joined to the stations within a radius, with ``km``.

    The grid cells around a point meet the cell of a station by equality, so the radius search is a
    hash join and not a comparison of everything with everything. Pairs are far more than rows: many points are
    spread over tasks by their number, and those of one cell over pieces that each have a copy of its stations.
    """
    step = step_for(radius_km)
    n = points.count()
    tasks, pieces = -(-n // POINTS_PER_TASK), max(1, -(-n // POINTS_PER_PIECE))
    p = points.withColumn("__cell", F.explode(cells_within(F.col("lat"), F.col("lng"), radius_km, step))).select(
        *[F.col(c).alias(f"p_{c}") for c in points.columns],
        F.col("__cell.cell_lat").alias("cell_lat"), F.col("__cell.cell_lng").alias("cell_lng"),
    )
    s = stations.filter(F.col("lat").isNotNull()).withColumn("cell_lat", cell(F.col("lat"), step)).withColumn(
        "cell_lng", cell(F.col("lng"), step)
    )
    on = ["cell_lat", "cell_lng"]
    if pieces > 1:
        on.append("__piece")
        p = p.withColumn("__piece", F.pmod(F.xxhash64(*[f"p_{c}" for c in points.columns]), F.lit(pieces)).cast("int"))
        s = s.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    if tasks > 8:
        p = p.repartition(tasks, *on)
    km = haversine_km(F.col("p_lat"), F.col("p_lng"), F.col("lat"), F.col("lng"))
    return p.join(s, on).withColumn("km", km).filter(F.col("km") <= radius_km).drop(*on)


def _nearest(cand: DataFrame, keep: int) -> DataFrame:
    over = W.partitionBy("p_lat", "p_lng").orderBy("km", "code")
    return cand.withColumn("__rn", F.row_number().over(over)).filter(F.col("__rn") <= keep).drop("__rn")


def nearest_railheads(
    points: DataFrame, stations: DataFrame, ladder_km: list[float],
    near: int = fixed.HEADS_NEAR, hubs: int = fixed.HEADS_HUBS,
    hub_min: int = fixed.HEAD_HUB_MIN_TRAINS, hub_km: float = fixed.HEAD_HUB_KM,
) -> DataFrame:
    """The nearest stations and the nearest hubs of each point, each station once.

    ``ladder_km`` lists radii; the next one counts only for points where the radii before give
    neither a station nor a hub, and only these are searched in it. Points with equal coordinates
    are searched once.
    """
    served = stations.filter(F.col("num_trains") > 0)
    spots = cut_lineage(points.filter(F.col("lat").isNotNull()).select("lat", "lng").distinct())
    big = served.filter(F.col("num_trains") >= hub_min)
    far = cut_lineage(_nearest(within_km(spots, big, hub_km), hubs).withColumn("__hub", F.lit(1)).withColumn("tier_km", F.lit(float(ladder_km[0]))))
    found, left = far, spots
    for step, radius in enumerate(ladder_km):
        if step and left.isEmpty():
            break
        close = _nearest(within_km(left, served, radius), near).withColumn("__hub", F.lit(0)).withColumn("tier_km", F.lit(float(radius)))
        close = cut_lineage(close)
        found = found.unionByName(close)
        answered = close.unionByName(far) if step == 0 else close
        left = left.join(answered.select(F.col("p_lat").alias("lat"), F.col("p_lng").alias("lng")).distinct(), ["lat", "lng"], "left_anti")
    heads = found.groupBy("p_lat", "p_lng", "code").agg(
        F.first(F.struct("name", "num_trains", "lat", "lng", "km")).alias("s"), F.max("tier_km").alias("tier_km")
    ).select(
        F.col("p_lat").alias("lat"), F.col("p_lng").alias("lng"), "code", F.col("s.name").alias("name"),
        F.col("s.num_trains").alias("trains"), F.col("s.km").alias("km"),
        F.col("s.lat").alias("head_lat"), F.col("s.lng").alias("head_lng"), "tier_km",
    )
    return points.join(heads, ["lat", "lng"])


def has_named_station(places: DataFrame, stations: DataFrame, radius_km: float = 20.0) -> DataFrame:
    """Places (``token``, ``lat``, ``lng``) with a served station near whose name contains the token."""
    spots = places.select("token", "lat", "lng").distinct()
    served = stations.filter(F.col("num_trains") > 0).select("name", "lat", "lng").distinct()
    hits = within_km(spots, served, radius_km).filter(
        F.contains(F.upper("name"), F.upper(F.trim(F.col("p_token"))))
    )
    return hits.select(F.col("p_token").alias("token"), F.col("p_lat").alias("lat"), F.col("p_lng").alias("lng")).distinct()


def station_geocode(queries: DataFrame, stations: DataFrame) -> DataFrame:
    """Best station per ``query``: whole name, then start, then part; the busier one on a tie."""
    served = stations.filter(F.col("num_trains") > 0)
    keys = queries.select(F.lower(F.trim("query")).alias("query")).distinct()
    hits = substring_matches(keys, served.select("name")).join(served, "name")
    score = F.when(F.col("whole"), 3).when(F.col("at_start"), 2).otherwise(1)
    best = hits.groupBy("query").agg(
        F.min_by(F.struct("code", "name", "lat", "lng"), F.struct(-score, -F.col("num_trains"), F.col("code"))).alias("s")
    )
    return best.select("query", "s.*")


def station_suggestions(queries: DataFrame, stations: DataFrame, limit: int = 5) -> DataFrame:
    """Station names per query: names that start with it, then names that contain it, by traffic."""
    served = stations.filter(F.col("num_trains") > 0)
    keys = queries.select(F.lower(F.trim("query")).alias("query")).distinct()
    hits = substring_matches(keys, served.select("name")).join(served, "name")
    order = F.struct(F.when(F.col("at_start"), 0).otherwise(1).alias("c"), (-F.col("num_trains")).alias("n"), F.col("code"))
    one = hits.groupBy("query", F.lower("name").alias("__low")).agg(
        F.min(order).alias("__o"), F.min_by("name", order).alias("name")
    )
    over = W.partitionBy("query").orderBy("__o")
    return (
        one.withColumn("position", F.row_number().over(over)).filter(F.col("position") <= limit)
        .select("query", "position", "name")
    )


def _city_candidates(keys: DataFrame, cities: DataFrame, keep: int = 5) -> DataFrame:
    """Most populous cities per key; either spelling matches, as two equi-joins."""
    by_name = cities.withColumn("__k", F.lower("name"))
    by_ascii = cities.withColumn("__k", F.lower("asciiname"))
    asked = keys.select(F.col("lookup").alias("__k")).distinct()
    both = by_name.unionByName(by_ascii).join(asked, "__k", "left_semi").dropDuplicates(["__k", "id"])
    over = W.partitionBy("__k").orderBy(F.desc_nulls_last("population"), "id")
    ranked = both.withColumn("pop_rank", F.row_number().over(over)).filter(F.col("pop_rank") <= keep)
    return keys.join(ranked, keys["lookup"] == ranked["__k"]).drop("__k")


def geocode(
    places: DataFrame, cities: DataFrame, stations: DataFrame, state_of: Column | None = None,
    near_km: float = 20.0, col: str = "place",
) -> DataFrame:
    """Coordinates per distinct place text, ``Name`` or ``Name, State``.

    Cities by population, held to the state when it fits one of them, a city with a same-named
    station near first; the station index answers for the rest and for ``..., railway station``.
    """
    if state_of is None:
        from ..functions.text import lookup

        state_of = lookup(fixed.STATE_BY_ADMIN, F.col("admin1"))
    texts = places.select(F.col(col).alias("place")).filter(F.col("place").isNotNull()).distinct()
    parsed = texts.withColumn("bare", place_name(F.col("place"))).withColumn("hint", place_hint(F.col("place")))
    parsed = parsed.withColumn("as_station", F.coalesce(F.col("hint") == "railway station", F.lit(False)))
    parsed = parsed.withColumn("spelled", place_alias(F.col("bare"))).withColumn("lookup", F.lower("spelled"))
    # the texts and their candidates are read several times from here on
    parsed = cut_lineage(parsed)
    cand = _city_candidates(parsed.filter(~F.col("as_station")), cities.withColumn("__state", state_of))
    fits = F.col("hint").isNotNull() & F.startswith(F.lower(F.coalesce("__state", F.lit(""))), F.col("hint"))
    per_place = W.partitionBy("place")
    cand = cand.withColumn("__fits", fits).withColumn("__any", F.max("__fits").over(per_place))
    cand = cut_lineage(cand.filter(~F.col("__any") | F.col("__fits")))
    tokens = cand.select(F.col("spelled").alias("token"), "lat", "lng")
    confirmed = has_named_station(tokens, stations, near_km).withColumn("__ok", F.lit(1))
    cand = cand.join(confirmed.withColumnRenamed("token", "spelled"), ["spelled", "lat", "lng"], "left")
    order = F.struct(F.when(F.col("__ok") == 1, 0).otherwise(1), F.col("pop_rank"))
    chosen = cut_lineage(cand.groupBy("place").agg(F.min_by(F.struct("name", "lat", "lng"), order).alias("c")))
    open_places = parsed.join(chosen.select("place"), "place", "left_anti")
    asked = F.when(F.col("as_station"), F.col("bare")).otherwise(F.col("spelled"))
    open_places = open_places.withColumn("query", F.lower(F.trim(asked)))
    by_station = open_places.join(station_geocode(open_places.select("query"), stations), "query").select(
        "place", "name", "lat", "lng", F.lit("station").alias("source")
    )
    return chosen.select("place", "c.*", F.lit("city").alias("source")).unionByName(by_station)


def prefix_matches(queries: DataFrame, names: DataFrame, low: int = 2) -> DataFrame:
    """(query, name) of distinct texts where the name starts with the query, any case."""
    q = queries.select("query").distinct().filter(F.length("query") >= low)
    lengths = q.select(F.length("query").alias("size")).distinct()
    n = names.select("name").distinct().withColumn("low_name", F.lower("name"))
    starts = (
        n.withColumn("size", F.explode(F.sequence(F.lit(low), F.greatest(F.length("low_name"), F.lit(low)))))
        .join(lengths, "size", "left_semi")
        .filter(F.col("size") <= F.length("low_name"))
        .select("name", F.left("low_name", F.col("size")).alias("query"))
    )
    return q.join(starts, "query").distinct()


def suggest_places(
    queries: DataFrame, cities: DataFrame, stations: DataFrame,
    k: int = 8, first: int = 10, more: int = 6, threshold: float = 0.45,
) -> DataFrame:
    """Autocomplete: cities by prefix, then similar names, then stations, until ``k`` are found."""
    asked = cut_lineage(queries.select(F.lower(F.trim("query")).alias("query")).distinct().filter(F.length("query") >= 2))
    spelled = asked.withColumn("spelled", place_alias(F.col("query")))
    keys = spelled.select(F.col("spelled").alias("query")).distinct()
    known = cut_lineage(cities.select("id", "name", "asciiname", F.col("state"), "population"))
    by_name = prefix_matches(keys, known.select("name")).join(known, "name")
    by_ascii = prefix_matches(keys, known.select(F.col("asciiname").alias("name"))).withColumnRenamed(
        "name", "asciiname"
    ).join(known, "asciiname")
    hits = by_name.unionByName(by_ascii).dropDuplicates(["query", "id"])
    over = W.partitionBy("query").orderBy(F.desc_nulls_last("population"), "id")
    stage1 = hits.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= first)

    similar = trigram_matches(keys, known.select(F.lower("name").alias("name")), threshold).withColumnRenamed("name", "low_name")
    alike = similar.join(known.withColumn("low_name", F.lower("name")), "low_name")
    over = W.partitionBy("query").orderBy(F.desc("similarity"), F.desc_nulls_last("population"), "id")
    stage2 = alike.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= more)

    served = stations.filter(F.col("num_trains") > 0)
    towns = prefix_matches(asked, served.select("name")).join(served, "name")
    over = W.partitionBy("query").orderBy(F.desc("num_trains"), "code")
    stage3 = towns.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= more)

    def labelled(df: DataFrame, stage: int, query: str) -> DataFrame:
        return df.select(
            F.col(query).alias("query"), F.struct(F.lit(stage).alias("stage"), F.col("rank")).alias("o"),
            "name", F.coalesce("state", F.lit("")).alias("state"),
        )

    def asked_as(df: DataFrame) -> DataFrame:
        return spelled.withColumnRenamed("query", "asked").join(df.withColumnRenamed("query", "spelled"), "spelled")

    every = (
        labelled(asked_as(stage1), 1, "asked")
        .unionByName(labelled(asked_as(stage2), 2, "asked"))
        .unionByName(labelled(stage3, 3, "query"))
    )
    once = every.groupBy("query", F.lower("name").alias("__low"), "state").agg(
        F.min("o").alias("o"), F.min_by("name", "o").alias("name")
    )
    asked_w = W.partitionBy("query")  # at most 22 rows each
    n1 = F.count_if(F.col("o.stage") == 1).over(asked_w)
    n2 = F.count_if(F.col("o.stage") <= 2).over(asked_w)
    gated = once.withColumn("__n1", n1).withColumn("__n2", n2).filter(
        (F.col("o.stage") == 1)
        | ((F.col("o.stage") == 2) & (F.col("__n1") < k))
        | ((F.col("o.stage") == 3) & (F.col("__n1") < k) & (F.col("__n2") < k))
    )
    return (
        gated.withColumn("position", F.row_number().over(asked_w.orderBy("o")))
        .filter(F.col("position") <= k)
        .select("query", "position", "name", "state")
    )


def coordinates_by_name(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Coordinates of a place name, else of the name without a trailing bracket group."""
    whole = known.select("name", F.col("lat").alias("__lat"), F.col("lng").alias("__lng"))
    bare = known.select(F.col("name").alias("__bare"), F.col("lat").alias("__lat2"), F.col("lng").alias("__lng2"))
    out = asked.withColumn("__bare", strip_parens(F.col("name"))).join(whole, "name", "left").join(bare, "__bare", "left")
    return out.withColumn("lat", F.coalesce("__lat", "__lat2")).withColumn("lng", F.coalesce("__lng", "__lng2")).drop(
        "__bare", "__lat", "__lng", "__lat2", "__lng2"
    )
