"""Stations bound to a wrong place: detection from the timetable, proposals, rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from ..functions.geo import cell, cells_within, haversine_km, step_for
from ..functions.text import alnum_key
from ..session import cut_lineage
from .segments import SEGMENT, nth_values, segmented
from .timetable import with_train_counts


def neighbour_midpoints(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """(code, lat, lng) half way between the located stops before and after each located stop."""
    place = stations.filter(F.col("lat").isNotNull()).select(F.col("code").alias("station_code"), "lat", "lng")
    located = stops.select("train_number", "seq", "station_code", *[c for c in (SEGMENT,) if c in stops.columns]).join(place, "station_code")
    if SEGMENT not in stops.columns:
        located = cut_lineage(located)  # read for the windows and for what they carry
    spot = F.struct("lat", "lng")
    around = segmented(located, ["train_number"], "seq", lasts={"p": spot}, nexts={"n": spot})
    return around.filter(F.col("p").isNotNull() & F.col("n").isNotNull()).select(
        F.col("station_code").alias("code"),
        ((F.col("p.lat") + F.col("n.lat")) / 2).alias("lat"),
        ((F.col("p.lng") + F.col("n.lng")) / 2).alias("lng"),
    )


def expected_locations(midpoints: DataFrame, min_points: int = 3) -> DataFrame:
    """Upper median of the mid-points per station, latitude and longitude apart.

    Equal values are counted together and only the bucket of the median is ordered, so a station on
    very many trains is no single task.
    """
    middle = {"v": F.floor(F.col("n") / 2) + 1}
    bucket = F.floor(F.col("__value") * 100)
    lat = nth_values(midpoints, ["code"], "lat", middle, bucket).select("code", "n", F.col("v").alias("exp_lat"))
    lng = nth_values(midpoints, ["code"], "lng", middle, bucket).select("code", F.col("v").alias("exp_lng"))
    return lat.filter(F.col("n") >= min_points).join(lng, "code")


def mislocated(
    stops: DataFrame, stations: DataFrame, outlier_km: float = fixed.DETOUR_GUARD_KM,
    far_fraction: float = 0.6, min_points: int = 3,
) -> DataFrame:
    """Stations far from where their trains pass: far from the median and from most mid-points."""
    mids = cut_lineage(neighbour_midpoints(stops, stations))  # read for two medians and the share
    place = stations.select("code", "name", F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    far = haversine_km(F.col("s_lat"), F.col("s_lng"), F.col("lat"), F.col("lng")) > outlier_km
    share = (
        mids.join(place, "code").groupBy("code")
        .agg(F.avg(F.when(far, 1.0).otherwise(0.0)).alias("far_share"), F.count(F.lit(1)).alias("trains"))
        .filter(F.col("trains") >= min_points)
    )
    off = haversine_km(F.col("s_lat"), F.col("s_lng"), F.col("exp_lat"), F.col("exp_lng"))
    return (
        expected_locations(mids, min_points).drop("n").join(share, "code").join(place, "code")
        .withColumn("off_exact", off)
        .filter((F.col("off_exact") > outlier_km) & (F.col("far_share") >= far_fraction))
        .select("code", "name", "exp_lat", "exp_lng", F.bround("off_exact").cast("int").alias("off_km"), "far_share", "trains")
    )


#: Radii of the search for a station's right place, as shares of the widest one.
RADII = (1 / 64, 1 / 16, 1 / 4, 1)


def _starts(names: DataFrame, key: str, size: int) -> DataFrame:
    """Proper starts of at least ``size`` letters of each key."""
    longer = names.filter(F.length(key) > size)
    sizes = longer.withColumn("__n", F.explode(F.sequence(F.lit(size), F.length(key) - 1)))
    return sizes.select(key, F.left(F.col(key), F.col("__n")).alias("__start"))


def _alike(asked: DataFrame, known: DataFrame, min_prefix: int) -> DataFrame:
    """(bad_key, good_key) that name the same place as same_name sees it, by equality of keys and their starts."""
    size = max(min_prefix, 1)
    a, k = asked.filter(F.col("bad_key") != "").distinct(), known.filter(F.col("good_key") != "").distinct()
    equal = a.join(k, F.col("bad_key") == F.col("good_key"))
    starts = _starts(k, "good_key", size).join(a, F.col("__start") == F.col("bad_key"))
    started = _starts(a, "bad_key", size).join(k, F.col("__start") == F.col("good_key"))
    pairs = [df.select("bad_key", "good_key") for df in (equal, starts, started)]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2])


def propose_remap(bad: DataFrame, stations: DataFrame, max_km: float = 10.0, min_prefix: int = 5) -> DataFrame:
    """The nearest other station of the same name close to where each bad one should be.

    Names meet first; then candidates meet by equality on name and grid cell, in radii that grow up to ``max_km``: a
    wider one is searched only for stations that the ones before leave without a match. Of the stations of one name at
    one point, two codes are enough, as a station is left out only for itself.
    """
    spots = cut_lineage(bad.select(
        F.col("code").alias("bad_code"), F.col("name").alias("bad_name"), alnum_key(F.col("name")).alias("bad_key"),
        "trains", "off_km", "exp_lat", "exp_lng",
    ))
    good = stations.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("code").isNotNull()).select(
        F.col("code").alias("good_code"), F.col("name").alias("good_name"), alnum_key(F.col("name")).alias("good_key"),
        F.col("lat").alias("g_lat"), F.col("lng").alias("g_lng"),
    )
    names = cut_lineage(_alike(spots.select("bad_key"), good.select("good_key"), min_prefix))
    at_point = W.partitionBy("good_key", "g_lat", "g_lng").orderBy("good_code")
    once = good.groupBy("good_key", "g_lat", "g_lng", "good_code").agg(F.min("good_name").alias("good_name"))
    wanted = names.select("good_key").distinct()
    good = cut_lineage(
        once.withColumn("__rn", F.row_number().over(at_point)).filter(F.col("__rn") <= 2).drop("__rn").join(wanted, "good_key", "left_semi"))
    km = haversine_km(F.col("exp_lat"), F.col("exp_lng"), F.col("g_lat"), F.col("g_lng"))
    found, left = None, spots
    for share in RADII:
        if found is not None and left.isEmpty():
            break
        radius = max_km * share
        step = step_for(radius)
        b = left.withColumn("__cell", F.explode(cells_within(F.col("exp_lat"), F.col("exp_lng"), radius, step))).select(
            *left.columns, F.col("__cell.cell_lat").alias("cell_lat"), F.col("__cell.cell_lng").alias("cell_lng"))
        g = good.withColumn("cell_lat", cell(F.col("g_lat"), step)).withColumn("cell_lng", cell(F.col("g_lng"), step))
        close = (
            b.join(names, "bad_key").join(g, ["good_key", "cell_lat", "cell_lng"])
            .filter(F.col("bad_code") != F.col("good_code")).withColumn("km", km).filter(F.col("km") <= radius)
        )
        best = cut_lineage(close.groupBy("bad_code").agg(
            F.min_by(F.struct("bad_name", "good_code", "good_name", "trains", "off_km", "km"), F.struct("km", "good_code")).alias("r")
        ))
        found = best if found is None else found.unionByName(best)
        left = left.join(best.select("bad_code"), "bad_code", "left_anti")
    return found.select(
        "bad_code", "r.bad_name", "r.good_code", "r.good_name", "r.trains", "r.off_km", F.bround("r.km", 1).alias("match_km")
    )


def unfixed(bad: DataFrame, remap: DataFrame) -> DataFrame:
    """Flagged stations without a proposal."""
    return bad.join(remap.select(F.col("bad_code").alias("code")), "code", "left_anti")


def apply_remap(stops: DataFrame, stations: DataFrame, remap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stops on the right code and name, and the stations with fresh train counts."""
    to = remap.select(F.col("bad_code").alias("station_code"), "good_code", "good_name")
    moved = stops.join(to, "station_code", "left").withColumn("station_code", F.coalesce("good_code", "station_code"))
    if "station_name" in stops.columns:
        moved = moved.withColumn("station_name", F.coalesce("good_name", "station_name"))
    moved = moved.select(*stops.columns)
    return moved, with_train_counts(stations, moved)
