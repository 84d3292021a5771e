"""Delay history: statistics per train, running days, seasonal months, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import csv_items, norm_train_no


def clean_observations(raw: DataFrame, low: int = -120, high: int = 1440) -> DataFrame:
    """Train, date, station number and whole-minute delay; a delay out of range becomes NULL.

    Rows stay without a delay, as a sighting still proves that the train ran.
    """
    number = F.col("delay").try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e9)
    minutes = F.when(usable, number).cast("int")
    return raw.select(
        norm_train_no(F.col("train_no")).alias("train_no"),
        F.col("obs_date"),
        F.col("station_no").cast("int").alias("station_no"),
        F.when(minutes.between(low, high), minutes).alias("delay_min"),
    ).filter(F.col("train_no") != "")


def delay_histogram(obs: DataFrame) -> DataFrame:
    """Count per (train, delay): at most 1561 rows per train, combined before the shuffle."""
    return (
        obs.filter(F.col("delay_min").isNotNull())
        .groupBy("train_no", "delay_min")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def observation_counts(obs: DataFrame) -> DataFrame:
    """Counts per train of each delay and of each date on which it was seen at its first station, from one scan."""
    origin = (F.col("station_no") == 1) & F.col("obs_date").isNotNull()
    facts = F.filter(
        F.array(
            F.struct(F.lit("delay").alias("what"), F.col("delay_min").cast("string").alias("value")),
            F.struct(F.lit("origin").alias("what"), F.when(origin, F.col("obs_date").cast("string")).alias("value")),
        ),
        lambda x: x["value"].isNotNull(),
    )
    rows = obs.select("train_no", F.explode(facts).alias("f")).select("train_no", "f.what", "f.value")
    return rows.groupBy("train_no", "what", "value").agg(F.count(F.lit(1)).alias("n"))


def delay_stats(
    obs: DataFrame, min_obs: int = fixed.MIN_OBSERVATIONS, on_time: int = fixed.ON_TIME_MINUTES
) -> DataFrame:
    """Average, discrete p50/p80/p90 and on-time share per train with enough observations."""
    return stats_of(delay_histogram(obs), min_obs, on_time)


def stats_of(hist: DataFrame, min_obs: int = fixed.MIN_OBSERVATIONS, on_time: int = fixed.ON_TIME_MINUTES) -> DataFrame:
    """Delay statistics from counts per (train_no, delay_min)."""
    train = W.partitionBy("train_no")
    ranked = hist.withColumn("total", F.sum("n").over(train)).withColumn(
        "upto", F.sum("n").over(train.orderBy("delay_min").rowsBetween(W.unboundedPreceding, W.currentRow))
    )

    def pct(q: float):
        return F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("delay_min"))).cast("double")

    return (
        ranked.filter(F.col("total") >= min_obs)
        .groupBy("train_no")
        .agg(
            F.bround(F.sum(F.col("delay_min") * F.col("n")) / F.max("total"), 1).alias("avg_delay"),
            pct(0.5).alias("p50"),
            pct(0.8).alias("p80"),
            pct(0.9).alias("p90"),
            F.bround(
                100 * F.sum(F.when(F.col("delay_min") <= on_time, F.col("n")).otherwise(0)) / F.max("total"), 1
            ).alias("on_time_pct"),
            F.max("total").alias("n_obs"),
        )
    )


def _origin_dates(obs: DataFrame) -> DataFrame:
    """Sightings at the first station, one row per train and date text."""
    return (
        obs.filter((F.col("station_no") == 1) & F.col("obs_date").isNotNull())
        .groupBy("train_no", F.col("obs_date").cast("string").alias("day_text"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def running_days(obs: DataFrame, min_origin: int = 12, share: float = 0.25, floor: int = 2) -> DataFrame:
    """Weekdays on which a train really starts, from at most seven counts per train."""
    return days_of(_origin_dates(obs), min_origin, share, floor)


def days_of(origin: DataFrame, min_origin: int = 12, share: float = 0.25, floor: int = 2) -> DataFrame:
    """Running days from counts per (train_no, day_text)."""
    per_day = (
        origin
        .withColumn("dow", F.weekday(F.try_to_date("day_text")))
        .filter(F.col("dow").isNotNull())
        .groupBy("train_no", "dow")
        .agg(F.sum("n").alias("n"))
    )
    train = W.partitionBy("train_no")
    kept = (
        per_day.withColumn("total", F.sum("n").over(train))
        .withColumn("peak", F.max("n").over(train))
        .filter(
            (F.col("total") >= min_origin)
            & (F.col("n") >= F.greatest(F.lit(float(floor)), F.lit(share) * F.col("peak")))
        )
    )
    names = F.array(*[F.lit(d) for d in fixed.WEEKDAYS])
    days = F.transform(F.array_sort(F.collect_list("dow")), lambda i: F.element_at(names, i + 1))
    return kept.groupBy("train_no").agg(F.array_join(days, ",").alias("days_of_week"))


def seasonal_months(obs: DataFrame, max_days: int = 30, max_months: int = 3) -> DataFrame:
    """Operating months of trains seen on few dates within few months.

    Unreadable dates count as dates; only their month is unknown.
    """
    return seasons_of(_origin_dates(obs), max_days, max_months)


def seasons_of(origin: DataFrame, max_days: int = 30, max_months: int = 3) -> DataFrame:
    """Operating months from one row per (train_no, day_text)."""
    month = F.when(F.length("day_text") >= 7, F.substring("day_text", 6, 2).try_cast("int"))
    return (
        origin
        .groupBy("train_no")
        .agg(F.count(F.lit(1)).alias("days"), F.array_sort(F.collect_set(month)).alias("months"))
        .filter((F.col("days") <= max_days) & (F.size("months") > 0) & (F.size("months") <= max_months))
        .select("train_no", F.array_join(F.col("months").cast("array<string>"), ",").alias("operating_months"))
    )


def day_corrections(trains: DataFrame, days: DataFrame) -> DataFrame:
    """Trains whose stored running days differ from the observed ones."""
    stored = F.array_sort(F.array_distinct(csv_items(F.col("t.days_of_week"))))
    seen = F.array_sort(F.array_distinct(csv_items(F.col("d.days_of_week"))))
    return (
        trains.alias("t")
        .join(days.alias("d"), F.trim(F.col("t.number")) == F.col("d.train_no"))
        .filter(stored != seen)
        .select(
            F.col("t.number"),
            F.col("d.days_of_week").alias("days_of_week"),
            ((F.size(stored) >= 7) & (F.size(seen) < 7)).alias("wrongly_daily"),
        )
    )


def apply_day_corrections(trains: DataFrame, corrections: DataFrame) -> DataFrame:
    fixes = corrections.select("number", F.col("days_of_week").alias("__days"))
    return (
        trains.join(fixes, "number", "left")
        .withColumn("days_of_week", F.coalesce("__days", "days_of_week"))
        .drop("__days")
    )


def apply_operating_months(trains: DataFrame, seasonal: DataFrame) -> DataFrame:
    """Reset, then set the operating months; NULL means all year. Adds the column where missing."""
    months = seasonal.select(F.col("train_no").alias("number"), "operating_months")
    base = trains.drop("operating_months").withColumn("__key", F.trim("number"))
    return base.join(months.withColumnRenamed("number", "__key"), "__key", "left").drop("__key")
