"""Batch jobs: delay load, timetable load, extra schedule, fares, station repair, model training."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting, delays, fares, model, naming, repair, timetable
from ..session import cut_lineage
from ..sources import files, sinks


@dataclass
class DelayLoad:
    stats: DataFrame
    days: DataFrame
    seasonal: DataFrame
    corrections: DataFrame
    trains: DataFrame


def load_delays(raw: DataFrame, trains: DataFrame, out: str | None = None, write: bool = True) -> DelayLoad:
    """Delay statistics, running days and seasons from one scan of the dump, and the corrected trains.

    The scan leaves one small table: counts per train of each delay and of each origin date.
    """
    counts = cut_lineage(delays.observation_counts(delays.clean_observations(raw)))
    stats = delays.stats_of(counts.filter("what = 'delay'").select("train_no", F.col("value").cast("int").alias("delay_min"), "n"))
    origin = counts.filter("what = 'origin'").select("train_no", F.col("value").alias("day_text"), "n")
    days, seasonal = delays.days_of(origin), delays.seasons_of(origin)
    corrections = delays.day_corrections(trains, days)
    fixed_trains = delays.apply_operating_months(delays.apply_day_corrections(trains, corrections), seasonal)
    if out:
        sinks.overwrite_table(stats.withColumn("source", F.lit("measured")), f"{out}/train_delays", write=write)
        sinks.overwrite_table(fixed_trains, f"{out}/trains", write=write)
    return DelayLoad(stats, days, seasonal, corrections, fixed_trains)


@dataclass
class TimetableLoad:
    trains: DataFrame
    stops: DataFrame
    report: DataFrame
    worst: DataFrame


def load_timetable(
    fresh: DataFrame, listed: DataFrame, stations: DataFrame, source: str, extra_source: str,
    out: str | None = None, write: bool = True,
) -> TimetableLoad:
    """The blob timetable with matched stations and inferred days, filled up from the listed one."""
    listed = listed if "src_line" in listed.columns else files.with_file_order(listed)
    # names count from every list that parses, stops only from lists of two and more
    named = files.explode_stop_list(listed, min_stops=1).withColumn("code", naming.fix_code(F.col("code")))
    by_list = named.select(F.col("raw_name").alias("name"), "code", F.struct("src_file", "src_line", "pos").alias("pos"))
    extra = files.explode_stop_list(listed).withColumn("code", naming.fix_code(F.col("code"))).drop("src_file", "src_line")
    by_station = stations.select("name", "code", F.lit(0).alias("pos"))
    dictionary = cut_lineage(naming.name_dictionary([by_list, by_station]))
    refs = files.explode_stop_blob(fresh)
    matched = cut_lineage(naming.match_stations(refs, dictionary))
    report, worst = timetable.match_report(matched)
    found = matched.filter(F.col("code").isNotNull()).withColumnRenamed("code", "station_code")
    stops = timetable.infer_day(timetable.assign_seq(found)).withColumn("source", F.lit(source))
    extra_stops = timetable.assign_seq(
        extra.withColumnRenamed("code", "station_code").drop("cum_km")
    ).withColumn("source", F.lit(extra_source))
    kept = stops.groupBy(F.col("train_number").alias("number")).agg(F.count(F.lit(1)).cast("int").alias("num_stops"))
    head = fresh.select(
        F.trim("train_no").alias("number"), F.trim("train_name").alias("name"), "days_of_week", "classes",
        F.col("distance").try_cast("double").alias("distance_km"), F.lit(source).alias("source"),
    ).join(kept, "number")
    more = files.list_trains(listed).withColumn("source", F.lit(extra_source))
    trains = timetable.gap_fill(head, more)
    added = trains.filter(F.col("source") == extra_source)
    all_stops = stops.select("train_number", "station_code", "raw_name", "arrival", "departure", "day", "seq", "source").unionByName(
        timetable.stops_of(extra_stops, added).select("train_number", "station_code", "raw_name", "arrival", "departure", "day", "seq", "source")
    )
    if out:
        sinks.overwrite_table(trains, f"{out}/trains", write=write)
        sinks.overwrite_table(all_stops, f"{out}/stops", write=write)
        sinks.overwrite_table(timetable.with_train_counts(stations, all_stops), f"{out}/stations", write=write)
    return TimetableLoad(trains, all_stops, report, worst)


@dataclass
class ExtraLoad:
    trains: DataFrame
    stops: DataFrame
    stations: DataFrame
    maps: DataFrame


def load_extra_schedule(
    schedule: DataFrame, types: DataFrame, names: DataFrame, trains: DataFrame, stops: DataFrame,
    stations: DataFrame, source: str = "delay-schedule", out: str | None = None, write: bool = True,
) -> ExtraLoad:
    """All trains and stops, those of the coded schedule that are not known yet among them, stations with fresh train
    counts, and the distance maps. A station where no train stops keeps its count. Trains and stops that ``out`` already has
    are appended to; they are the given ones then."""
    from ..functions.text import clock_minutes, guess_classes

    maps = sinks.distance_maps(
        schedule.filter(F.col("cum_km").isNotNull() & (F.col("station_code") != ""))
        .groupBy("train_number", "station_code").agg(F.max_by("cum_km", "station_no").alias("cum_km"))
    )
    known = trains.select(F.trim("number").alias("train_number"))
    open_rows = schedule.join(known, "train_number", "left_anti")
    placed = timetable.placeable_stops(open_rows.withColumn("seq", F.col("station_no")), stations)
    lengths = placed.groupBy("train_number").agg(F.max_by("cum_km", "seq").alias("distance_km"), F.count(F.lit(1)).alias("num_stops"))
    described = lengths.join(types.withColumnRenamed("number", "train_number"), "train_number", "left")
    unnamed = F.concat(F.lit("Train "), F.col("train_number"))
    new_trains = described.select(
        F.col("train_number").alias("number"), F.coalesce(F.nullif("name", F.lit("")), unnamed).alias("name"), "num_stops",
        guess_classes(F.col("type_code")).alias("classes"), "distance_km", F.lit(source).alias("source"),
    )
    named = placed.join(names.select(F.col("code").alias("station_code"), F.col("name").alias("__full")), "station_code", "left")
    rows = named.select(
        "train_number", "station_code", F.coalesce("__full", "station_code").alias("station_name"), "arrival", "departure",
        clock_minutes(F.col("arrival")).alias("arr_min"), clock_minutes(F.col("departure")).alias("dep_min"), "day", "seq",
        F.lit(source).alias("source"),
    )
    # only what is added is written; the tables that are there stay as they are
    new_stops = cut_lineage(timetable.append_with_ids(stops, rows, ["train_number", "seq"]))
    new_trains = cut_lineage(new_trains)
    all_trains = trains.unionByName(new_trains, allowMissingColumns=True)
    all_stops = stops.unionByName(new_stops, allowMissingColumns=True)
    counts = timetable.station_train_counts(all_stops).select(F.col("station_code").alias("code"), F.col("num_trains").cast("int").alias("__count"))
    old = F.col("num_trains") if "num_trains" in stations.columns else F.lit(0)
    counted = cut_lineage(stations.join(counts, "code", "left").withColumn("num_trains", F.coalesce("__count", old).cast("int")).drop("__count"))
    if out:
        sinks.add_rows(trains, new_trains, f"{out}/trains", write=write)
        sinks.add_rows(stops, new_stops, f"{out}/stops", write=write)
        sinks.overwrite_table(counted, f"{out}/stations", write=write)
    return ExtraLoad(all_trains, all_stops, counted, maps)


def load_fares(raw: DataFrame, out: str | None = None, write: bool = True) -> tuple[DataFrame, DataFrame]:
    """(knots, linear fits) of every class with enough quotes."""
    quotes = fares.clean_quotes(raw)
    knots = fares.stored_knots(fares.fit_isotonic(quotes))
    fits = fares.fit_linear(quotes)
    if out:
        sinks.write_json(sinks.fare_table(knots, fits), f"{out}/fare_table", write=write)
    return knots, fits


def repair_stations(
    stops: DataFrame, stations: DataFrame, out: str | None = None, write: bool = False, max_km: float = 10.0, **limits
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(flagged, remap, stops, stations). Nothing is written unless asked for."""
    flagged = cut_lineage(repair.mislocated(stops, stations, **limits))
    remap = cut_lineage(repair.propose_remap(flagged, stations, max_km))
    moved, counted = repair.apply_remap(stops, stations, remap)
    if out:
        sinks.write_json(sinks.repair_audit(remap, flagged), f"{out}/station_fixes", write=write)
        sinks.overwrite_table(moved, f"{out}/stops", write=write)
        sinks.overwrite_table(counted, f"{out}/stations", write=write)
    return flagged, remap, moved, counted


@dataclass
class Training:
    forest: model.QuantileForest
    scored: DataFrame
    errors: DataFrame
    coverage: DataFrame
    strata: DataFrame


def train_delay_model(
    features: DataFrame, trained_at: str, identity: list[str], cap: int = 400, seed: int = 42, **forest_args
) -> Training:
    """Split all rows by hash; fit the forest on at most ``cap`` of the fitting rows per train, calibrate and score it
    on all rows that were set aside and held out."""
    features = cut_lineage(features)
    held = model.is_held_out(identity, seed=seed)
    aside = model.is_held_out(identity, seed=seed + 1)
    sample = cut_lineage(model.sample_per_key(features.filter(~held & ~aside), "train_no", identity, cap, seed))
    forest = model.fit_quantile_forest(sample, trained_at, seed=seed, **forest_args)
    forest = model.calibrated(forest, features.filter(~held & aside))
    # calibration covers all rows, also later journey days, which are refused when serving
    scored = cut_lineage(model.predict_quantiles(forest, features.filter(held), gate=False))
    return Training(forest, scored, model.error_report(scored), model.coverage_report(scored), model.stratified_report(scored))


@dataclass
class BoostTraining:
    model: boosting.QuantileBoost
    scored: DataFrame
    losses: DataFrame
    errors: DataFrame
    coverage: DataFrame
    strata: DataFrame


#: Features whose order means nothing to the delay.
CATEGORICAL = ["tier_code", "dow", "month"]


def train_boosted_model(
    features: DataFrame, identity: list[str], cap: int = 400, seed: int = 42, how: boosting.Boosting = boosting.Boosting()
) -> BoostTraining:
    """Split all rows by hash; boost on at most ``cap`` of the fitting rows per train, a tenth of which only stops the
    rounds, and score the model on all held-out rows."""
    features = cut_lineage(features)
    held = model.is_held_out(identity, seed=seed)
    sample = model.sample_per_key(features.filter(~held), "train_no", identity, cap, seed)
    aside = model.is_held_out(identity, share=0.1, seed=seed + 1)
    found = boosting.fit_quantile_boost(sample, model.FEATURES, CATEGORICAL, how, aside=aside)
    scored = cut_lineage(boosting.predict_boosted(found, features.filter(held), gate=False))
    return BoostTraining(
        found, scored, boosting.pinball_report(scored), model.error_report(scored), model.coverage_report(scored), model.stratified_report(scored))
