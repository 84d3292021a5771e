"""Timetable build: numbering, day rollover, gap filling, counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from ..functions.geo import haversine_km
from ..functions.text import minutes_clock, norm_train_no
from .segments import dense_positions, SEGMENT, segmented, with_segments


def assign_seq(stops: DataFrame, pos: str = "pos", min_stops: int = 2) -> DataFrame:
    """Number the stops of each train from 1 and drop trains with too few of them."""
    counts = stops.groupBy("train_number").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_stops)
    kept = stops.join(counts.select("train_number"), "train_number", "left_semi")
    return dense_positions(kept, ["train_number"], pos, "seq")


def infer_day(stops: DataFrame, pos: str = "seq", width: int = 1024) -> DataFrame:
    """Journey day of each stop: one more whenever a clock is earlier than the one before it.

    Days are counted inside (train, segment of positions) from one shuffle of the stops. One row per segment
    carries on the last clock and the days so far; at the first clock of a segment it may add a day itself.
    """
    known, first = F.coalesce("dep_min", "arr_min"), F.coalesce("arr_min", "dep_min")
    inside = W.partitionBy("train_number", SEGMENT).orderBy(pos)
    before = F.last(known, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1))
    own = F.when(F.col("dep_min") < F.col("arr_min"), 1).otherwise(0)
    local = (
        with_segments(stops, pos, width).withColumn("__before", before)
        .withColumn("__wraps", F.when(first < F.col("__before"), 1).otherwise(0) + own)
        .withColumn("__run", F.sum("__wraps").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    )
    at = F.when(known.isNotNull(), F.col(pos))
    facts = local.groupBy("train_number", SEGMENT).agg(
        F.sum("__wraps").alias("wraps"), F.min_by(first, at).alias("head"), F.max_by(known, at).alias("last")
    )
    earlier = W.partitionBy("train_number").orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    edge = facts.withColumn("before", F.last("last", ignorenulls=True).over(earlier)).withColumn(
        "__edge", F.when(F.col("head") < F.col("before"), 1).otherwise(0)
    )
    carry = edge.withColumn("__start", F.coalesce(F.sum(F.col("wraps") + F.col("__edge")).over(earlier), F.lit(0))).select(
        "train_number", SEGMENT, "__edge", "__start"
    )
    started = F.when(known.isNotNull() | F.col("__before").isNotNull(), F.col("__edge")).otherwise(0)
    day = (1 + F.col("__start") + F.col("__run") + started).cast("int")
    return local.join(carry, ["train_number", SEGMENT]).withColumn("day", day).drop(
        SEGMENT, "__before", "__wraps", "__run", "__edge", "__start"
    )


def placeable_stops(stops: DataFrame, stations: DataFrame, min_stops: int = 2) -> DataFrame:
    """Stops at stations with coordinates, of trains that keep enough of them, numbered again."""
    located = stations.filter(F.col("lat").isNotNull()).select(F.upper(F.trim("code")).alias("station_code"))
    kept = stops.join(located, "station_code", "left_semi")
    return assign_seq(kept.withColumnRenamed("seq", "__old"), "__old", min_stops).drop("__old")


def gap_fill(base: DataFrame, extra: DataFrame, key: str = "number") -> DataFrame:
    """All of ``base`` plus the rows of ``extra`` whose train is not in ``base``."""
    added = extra.join(base.select(key).distinct(), key, "left_anti")
    return base.unionByName(added, allowMissingColumns=True)


def stops_of(stops: DataFrame, trains: DataFrame) -> DataFrame:
    """Stops of the listed trains."""
    return stops.join(trains.select(F.col("number").alias("train_number")).distinct(), "train_number", "left_semi")


def with_train_names(stops: DataFrame, trains: DataFrame) -> DataFrame:
    """Stops with the name of their train; NULL for a train that is not listed."""
    names = trains.select(F.col("number").alias("train_number"), F.col("name").alias("train_name"))
    return stops.join(names, "train_number", "left")


def append_with_ids(existing: DataFrame, new: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """New rows with ids that go on after the largest id in use.

    Rows are numbered per hash bucket and shifted by the sizes of the buckets before, so no task
    holds them all. One largest id is read by the driver.
    """
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top")).first()["top"]
    buckets = 1 << 16
    work = new.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = work.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)  # one row per bucket
    shift = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    local = F.row_number().over(W.partitionBy("__bucket").orderBy(*order))
    return (
        work.withColumn("__local", local)
        .join(shift, "__bucket")
        .withColumn(id_col, (F.col("__local") + F.col("__shift") + F.lit(int(top))).cast("bigint"))
        .drop("__bucket", "__local", "__shift")
    )


def station_train_counts(stops: DataFrame) -> DataFrame:
    """Distinct trains per station. Duplicates go first, so a busy station is counted in parallel."""
    return (
        stops.select("station_code", "train_number").distinct()
        .groupBy("station_code").agg(F.count(F.lit(1)).alias("num_trains"))
    )


def with_train_counts(stations: DataFrame, stops: DataFrame) -> DataFrame:
    """Stations with a fresh train count, zero where no train stops."""
    counts = station_train_counts(stops).withColumnRenamed("station_code", "code")
    return (
        stations.drop("num_trains").join(counts, "code", "left")
        .withColumn("num_trains", F.coalesce("num_trains", F.lit(0)).cast("int"))
    )


def match_report(matched: DataFrame, worst: int = 10) -> tuple[DataFrame, DataFrame]:
    """Share of station references without a code, and the names that miss most often."""
    miss = F.col("code").isNull()
    totals = matched.agg(
        F.count(F.lit(1)).alias("refs"), F.count_if(miss).alias("unmatched"),
        F.round(100.0 * F.count_if(miss) / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("unmatched_pct"),
    )
    names = (
        matched.filter(miss).groupBy("raw_name").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "raw_name").limit(worst)
    )
    return totals, names


def route_lengths(stops: DataFrame) -> DataFrame:
    """Longest cumulative distance and the distance of the last stop per train."""
    return stops.groupBy("train_number").agg(
        F.max("cum_km").alias("total_km"), F.max_by("cum_km", "seq").alias("distance_km")
    )


def network_stats(stops: DataFrame, stations: DataFrame, hub_min: int = fixed.HUB_MIN_TRAINS) -> DataFrame:
    """One row: trains, stops, stations, hubs."""
    per_train = stops.groupBy("train_number").agg(F.count(F.lit(1)).alias("n"))
    left = per_train.agg(F.count(F.lit(1)).alias("trains"), F.sum("n").alias("stops"))
    right = stations.agg(
        F.count(F.lit(1)).alias("stations"), F.count_if(F.col("num_trains") >= hub_min).alias("hubs")
    )
    one = F.lit(1).alias("__one")
    return left.select(one, "*").join(right.select(one, "*"), "__one").drop("__one")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def stop_detour(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """Extra km a stop adds against the nearest located stops before and after it."""
    place = stations.select(F.col("code").alias("station_code"), "lat", "lng")
    located = stops.join(place, "station_code", "left")
    spot = F.when(F.col("lat").isNotNull(), F.struct("lat", "lng"))
    around = segmented(located, ["train_number"], "seq", lasts={"__prev": spot}, nexts={"__next": spot}, lengths=stops)
    p, h, n = F.col("__prev"), F.struct("lat", "lng"), F.col("__next")

    def km(a, b):
        return haversine_km(a["lat"], a["lng"], b["lat"], b["lng"])

    detour = km(p, h) + km(h, n) - km(p, n)
    return around.withColumn("detour_km", F.coalesce(detour, F.lit(0.0))).drop("__prev", "__next", "lat", "lng")


def describe_trains(stops: DataFrame) -> DataFrame:
    """``first HH:MM → last (n halts)`` per train."""
    first = F.min_by(F.struct("station_code", F.coalesce("dep_min", "arr_min").alias("t")), "seq")
    rows = stops.groupBy("train_number").agg(
        first.alias("f"), F.max_by("station_code", "seq").alias("last"), F.count(F.lit(1)).alias("n")
    )
    text = F.concat(
        F.col("f.station_code"), F.lit(" "), F.coalesce(minutes_clock(F.col("f.t")), F.lit("--:--")),
        F.lit(" → "), F.col("last"), F.lit(" ("), F.col("n").cast("string"), F.lit(" halts)"),
    )
    return rows.select("train_number", text.alias("summary"))


def number_series(number):
    """Audit stratum of a train number."""
    five = F.length(number) == 5
    return (
        F.when(five & F.left(number, F.lit(2)).isin("12", "22"), "premium/SF")
        .when(five & (F.left(number, F.lit(1)) == "1"), "mail/express")
        .when(five & (F.left(number, F.lit(1)) == "5"), "passenger")
        .when(~(five & F.left(number, F.lit(1)).isin("1", "2", "5")), "other")
    )


def audit_sample(trains: DataFrame, per_stratum: int = 5, seed: int = 42) -> DataFrame:
    """A repeatable sample of trains per number series: the rows with the smallest seeded hash."""
    work = trains.withColumn("stratum", number_series(F.col("number"))).filter(F.col("stratum").isNotNull())
    over = W.partitionBy("stratum").orderBy(F.md5(F.concat(F.col("number"), F.lit(f"#{seed}"))), "number")
    return work.withColumn("pick", F.row_number().over(over)).filter(F.col("pick") <= per_stratum)


def normalised_numbers(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, norm_train_no(F.col(col)))
