"""Tier, delay, connection, confirmation, demand and reliability scores as column expressions.

Whole-number results use ``bround`` (half to even).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import lookup


def whole(c: Column) -> Column:
    return F.bround(c).cast("int")


def clamp(c: Column, low: float, high: float) -> Column:
    """Value held between two bounds; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


# --- trains and delays ---------------------------------------------------------------------------

def infer_tier(train_no: Column, name: Column) -> Column:
    number = F.trim(F.coalesce(train_no, F.lit("")))
    words = "|".join(fixed.PREMIUM_WORDS)
    return (
        F.when(F.upper(F.coalesce(name, F.lit(""))).rlike(words), "premium")
        .when(F.left(number, F.lit(2)).isin(fixed.SUPERFAST_PREFIXES), "superfast")
        .when(F.left(number, F.lit(1)) == "5", "passenger")
        .otherwise("express")
    )


def tier_code(tier: Column) -> Column:
    return F.coalesce(lookup(fixed.TIER_CODE, tier), F.lit(2))


def heavier_tier(a: Column, b: Column) -> Column:
    """The tier of higher rank; the first on a tie."""
    return F.when(lookup(fixed.TIER_RANK, a) >= lookup(fixed.TIER_RANK, b), a).otherwise(b)


def expected_delay(tier: Column, km: Column, halts: Column) -> Column:
    base = F.coalesce(lookup(fixed.TIER_BASE_DELAY, tier), F.lit(33))
    return base + 8.0 * F.coalesce(km, F.lit(0.0)) / 1000 + 0.35 * F.greatest(F.coalesce(halts, F.lit(0)), F.lit(0))


def share_within(minutes: Column, mean: Column) -> Column:
    """Share of an exponential delay with this mean that stays within ``minutes``."""
    return 1 - F.exp(-minutes / F.greatest(mean.cast("double"), F.lit(6.0)))


def confidence(n_obs: Column) -> Column:
    n = F.coalesce(n_obs, F.lit(0))
    return F.when(n == 0, "none").when(n >= 1000, "high").when(n >= 100, "moderate").otherwise("limited")


# --- quantile curves -----------------------------------------------------------------------------
# A curve is an array of minutes, one per level of ``fixed.QUANTILE_LEVELS``.

def monotone(curve: Column) -> Column:
    return F.array_sort(curve)


def _levels() -> Column:
    return F.array(*[F.lit(x) for x in fixed.QUANTILE_LEVELS])


def curve_cdf(curve: Column, x: Column) -> Column:
    """Share of delays up to ``x``: linear between quantiles, 0.97 beyond the last one."""
    first = F.element_at(curve, 1)
    levels = F.concat(F.array(F.lit(max(0.0, fixed.QUANTILE_LEVELS[0] - 0.10))), _levels())
    points = F.concat(F.array(F.least(first, F.lit(0.0))), curve)
    segments = F.zip_with(
        F.zip_with(
            F.slice(levels, 1, len(fixed.QUANTILE_LEVELS)), F.slice(levels, 2, len(fixed.QUANTILE_LEVELS)),
            lambda p0, p1: F.struct(p0.alias("p0"), p1.alias("p1")),
        ),
        F.zip_with(
            F.slice(points, 1, len(fixed.QUANTILE_LEVELS)), F.slice(points, 2, len(fixed.QUANTILE_LEVELS)),
            lambda m0, m1: F.struct(m0.alias("m0"), m1.alias("m1")),
        ),
        lambda p, m: F.when(x <= m["m0"], p["p0"]).when(
            x <= m["m1"],
            p["p0"] + F.when(m["m1"] == m["m0"], 0.0).otherwise((x - m["m0"]) / (m["m1"] - m["m0"])) * (p["p1"] - p["p0"]),
        ),
    )
    inside = F.try_element_at(F.filter(segments, lambda s: s.isNotNull()), F.lit(1))
    return F.when(F.size(curve) > 0, F.coalesce(F.bround(clamp(inside, 0.02, 0.99), 3), F.lit(0.97)))


def curve_mean(curve: Column) -> Column:
    """Mean delay: area under the curve from (0, 0), flat after the last level, negatives as zero."""
    levels = F.concat(F.array(F.lit(0.0)), _levels(), F.array(F.lit(1.0)))
    floor = F.transform(curve, lambda v: F.greatest(v, F.lit(0.0)))
    points = F.concat(F.array(F.lit(0.0)), floor, F.array(F.element_at(floor, -1)))
    n = len(fixed.QUANTILE_LEVELS) + 1
    widths = F.zip_with(F.slice(levels, 2, n), F.slice(levels, 1, n), lambda hi, lo: hi - lo)
    heights = F.zip_with(F.slice(points, 2, n), F.slice(points, 1, n), lambda hi, lo: (hi + lo) / 2)
    areas = F.zip_with(widths, heights, lambda w, h: w * h)
    return F.when(F.size(curve) > 0, F.aggregate(areas, F.lit(0.0), lambda acc, v: acc + v))


def connection_safety(buffer: Column, mean: Column, curve: Column | None = None) -> Column:
    """Percent chance of making a change; NULL under 30 minutes of buffer."""
    share = share_within(buffer, mean)
    if curve is not None:
        share = F.when(curve.isNotNull(), curve_cdf(curve, buffer)).otherwise(share)
    return F.when(buffer >= fixed.MIN_BUFFER, clamp(whole(100 * share), 35, 98))


def min_buffer(p50: Column) -> Column:
    """Shortest useful change: the typical delay of the incoming train, between 30 and 90 minutes."""
    return F.coalesce(clamp(whole(p50), fixed.MIN_BUFFER, fixed.MAX_BUFFER), F.lit(fixed.MIN_BUFFER))


def delay_profile(
    tier: Column, km: Column, halts: Column, avg_delay: Column, on_time_pct: Column,
    p90: Column, n_obs: Column, day_offset: Column, curve: Column | None = None,
) -> Column:
    """Struct of the best delay evidence: predicted curve, measured history, else a tier model."""
    has_history = F.coalesce(n_obs, F.lit(0)) >= fixed.MIN_OBSERVATIONS
    none_int, none_double = F.lit(None).cast("int"), F.lit(None).cast("double")
    guess = whole(expected_delay(tier, km, halts))
    multi_day = F.coalesce(day_offset, F.lit(0)) >= 2

    def row(avg, on_time, p50, tail, source, n, label, quantiles):
        return F.struct(
            avg.alias("avg_mins"), on_time.alias("on_time_pct"), p50.alias("p50"), tail.alias("p90"),
            F.lit(source).alias("source"), n.cast("int").alias("n_obs"), label.alias("confidence"),
            multi_day.alias("multi_day"), quantiles.alias("curve"),
        )

    no_curve = F.lit(None).cast("array<double>")
    measured = row(
        whole(avg_delay), whole(on_time_pct), none_double, p90.cast("double"), "measured", n_obs, confidence(n_obs), no_curve
    )
    modelled = row(
        guess, whole(100 * share_within(F.lit(fixed.ON_TIME_MINUTES), guess)), none_double, none_double,
        "modelled", F.lit(0), F.lit("none"), no_curve,
    )
    out = F.when(has_history, measured).otherwise(modelled)
    if curve is None:
        return out
    predicted = row(
        whole(curve_mean(curve)), whole(100 * curve_cdf(curve, F.lit(fixed.ON_TIME_MINUTES))),
        F.bround(F.element_at(curve, fixed.QUANTILE_LEVELS.index(0.5) + 1)),
        F.bround(F.element_at(curve, fixed.QUANTILE_LEVELS.index(0.9) + 1)),
        "predicted", n_obs, confidence(n_obs), curve,
    )
    return F.when(has_history & curve.isNotNull(), predicted).otherwise(out)


# --- confirmation and reliability ----------------------------------------------------------------

def access_score(first_km: Column) -> Column:
    return F.greatest(F.lit(30.0), 100 - F.coalesce(first_km, F.lit(0.0)) / 6)


def reliability(on_time: Column, safety: Column, transfers: Column, first_km: Column, confirmed: Column) -> Column:
    access = access_score(first_km)
    seat = F.coalesce(confirmed, F.lit(70))
    change = F.coalesce(safety, F.lit(60))
    direct = 0.50 * seat + 0.30 * on_time + 0.20 * access
    changed = 0.38 * seat + 0.30 * change + 0.20 * on_time + 0.12 * access
    return clamp(whole(F.when(transfers <= 0, direct).otherwise(changed)), 25, 97)


def confirmation(classes: Column, tier: Column, days_out: Column, month: Column) -> Column:
    """Struct (pct, state): easiest class, tier, lead time and peak season."""
    eases = F.transform(classes, lambda c: F.coalesce(lookup(fixed.CLASS_EASE, c), F.lit(68)))
    base = F.coalesce(F.array_max(eases), F.lit(68))
    lead = F.when(days_out.isNull(), F.lit(8.0)).otherwise(clamp(days_out * 0.5, -6.0, 16.0))
    peak = F.when(F.coalesce(month.isin(fixed.PEAK_MONTHS), F.lit(False)), -12).otherwise(0)
    pct = clamp(whole(base + F.coalesce(lookup(fixed.TIER_DEMAND, tier), F.lit(0)) + lead + peak), 20, 96)
    state = F.when(pct >= 78, "confirmed").when(pct >= 55, "rac").otherwise("waitlisted")
    return F.struct(pct.alias("pct"), state.alias("state"))


# --- demand --------------------------------------------------------------------------------------

def demand_drivers(
    kind: Column, name: Column, near_holiday: Column, day: Column
) -> tuple[Column, Column]:
    """(score, ordered drivers) of a date given its own calendar entry and holiday within a day."""
    weekday = F.weekday(day)
    is_weekend = weekday >= 5
    by_weekend = weekday >= 4  # Friday to Sunday
    touches = by_weekend | (weekday == 0)
    long_weekend = F.coalesce(near_holiday & touches & (kind.isNotNull() | is_weekend), F.lit(False))
    weekend = is_weekend & ~long_weekend
    peak = F.month(day).isin(fixed.PEAK_MONTHS)
    score = F.greatest(
        F.when(kind == "festival", 85).when(kind.isNotNull(), 70).otherwise(0),
        F.when(long_weekend, 60).when(weekend, 35).otherwise(0),
        F.when(peak, 25).otherwise(0),
    )
    nothing_else = kind.isNull() & ~long_weekend & ~weekend
    drivers = F.array_compact(
        F.array(
            F.when(kind == "festival", F.concat(name, F.lit(" (festival)"))).when(kind.isNotNull(), name),
            F.when(long_weekend, F.lit("long weekend")).when(weekend, F.lit("weekend")),
            F.when(peak & nothing_else, F.lit("peak travel season")),
        )
    )
    valid = day.isNotNull()
    return (
        F.when(valid, score).otherwise(0),
        F.when(valid, drivers).otherwise(F.array().cast("array<string>")),
    )


def demand_advisory(score: Column, drivers: Column) -> Column:
    """Struct (level, label, note), NULL under the moderate score."""
    high = score >= fixed.ADVICE_HIGH
    note = F.when(high, fixed.ADVICE_HIGH_NOTE).otherwise(fixed.ADVICE_MODERATE_NOTE)
    label = F.coalesce(F.try_element_at(drivers, F.lit(1)), F.lit(fixed.ADVICE_DEFAULT_LABEL))
    return F.when(
        score >= fixed.ADVICE_MODERATE,
        F.struct(F.when(high, "high").otherwise("moderate").alias("level"), label.alias("label"), note.alias("note")),
    )


def flexi_multiplier(tier: Column, score: Column) -> Column:
    lifted = F.bround(F.least(F.lit(1.4), 1 + 0.4 * (clamp(score, 0, 100) / 100)), 3)
    return F.when(tier == "premium", lifted).otherwise(F.lit(1.0))


# --- fares and roads -----------------------------------------------------------------------------

def modelled_fare(class_code: Column, km: Column, tier: Column, multiplier: Column, rate: Column | None = None) -> Column:
    rate = F.coalesce(lookup(fixed.CLASS_RATE, class_code), F.lit(0.58)) if rate is None else rate
    fare = km * rate + F.coalesce(lookup(fixed.CLASS_RESERVATION, class_code), F.lit(40))
    fast = F.coalesce(lookup(fixed.CLASS_SUPERFAST, class_code), F.lit(30))
    fare = fare + F.when(tier.isin("premium", "superfast"), fast).otherwise(0)
    fare = fare * F.when(class_code.isin(fixed.AC_CLASSES), 1 + fixed.AC_TAX).otherwise(1.0)
    return F.greatest(F.lit(60), whole(fare * F.when(tier == "premium", multiplier).otherwise(1.0)))


def rail_fare(curve_fare: Column, class_code: Column, km: Column, tier: Column, multiplier: Column) -> Column:
    """Fare on the fitted curve, 12 % more on premium trains; the rate model where there is no curve."""
    premium = tier == "premium"
    real = curve_fare * F.when(premium, 1.12).otherwise(1.0) * F.when(premium, multiplier).otherwise(1.0)
    return F.when(curve_fare.isNotNull(), F.greatest(F.lit(60), whole(real))).otherwise(
        modelled_fare(class_code, km, tier, multiplier)
    )


def road_fare(km: Column) -> Column:
    return F.when(km.isNotNull(), F.greatest(F.lit(fixed.ROAD_FARE_MIN), whole(km * fixed.ROAD_FARE_PER_KM)))


def road_minutes(km: Column) -> Column:
    return whole(km / fixed.ROAD_KMPH * 60)


def ac_available(classes: Column) -> Column:
    return F.arrays_overlap(classes, F.array(*[F.lit(c) for c in fixed.AC_CLASSES]))


def offered_classes(classes: Column, tier: Column, name: Column) -> Column:
    """Classes a train really sells: premium trains are either sitting or AC sleeper."""
    title = F.upper(F.coalesce(name, F.lit("")))
    words = F.split(title, r"\s+")
    sitting = (
        F.contains(title, F.lit("SHATABDI"))
        | F.contains(title, F.lit("GATIMAAN"))
        | (F.contains(title, F.lit("VANDE")) & ~F.array_contains(words, "SL"))
        | (F.contains(title, F.lit("TEJAS")) & ~F.array_contains(words, "RAJ"))
    )
    allowed = F.when(sitting, F.array(*[F.lit(c) for c in fixed.SITTING_CLASSES])).otherwise(
        F.array(*[F.lit(c) for c in fixed.SLEEPER_AC_CLASSES])
    )
    kept = F.filter(classes, lambda c: F.array_contains(allowed, c))
    return F.when((tier == "premium") & (F.size(kept) > 0), kept).otherwise(classes)


def classes_in_order(*lists: Column) -> Column:
    """Union of class lists in fare order, other classes sorted at the end."""
    every = reduce(F.array_union, lists) if len(lists) > 1 else F.array_distinct(lists[0])
    order = F.array(*[F.lit(c) for c in fixed.CLASS_ORDER])
    return F.concat(F.array_intersect(order, every), F.array_sort(F.array_except(every, order)))


# --- display tones -------------------------------------------------------------------------------

def tone(score: Column, good: float, fair: float) -> Column:
    return F.when(score >= good, "safe").when(score >= fair, "moderate").otherwise("risky")


def season_risk(day: Column) -> Column:
    """Struct (score, level, label, is_weekend) from season, weekend and a date hash."""
    text = F.date_format(day, "yyyy-MM-dd")
    digits = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("bigint"))
    hashed = F.aggregate(digits, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296)))
    month = F.month(day)
    base = F.coalesce(lookup(fixed.SEASON_BASE, month), F.lit(fixed.SEASON_OTHER))
    weekend = F.weekday(day).isin(4, 5, 6)
    spike = F.pmod(hashed, F.lit(11)) == 0
    score = clamp(
        (base + F.when(weekend, fixed.SEASON_WEEKEND).otherwise(0) + F.pmod(hashed, F.lit(21)) - 10 + F.when(spike, fixed.SEASON_SPIKE).otherwise(0)).cast("int"),
        *fixed.SEASON_LIMITS,
    )
    level = F.when(score >= 65, "high").when(score >= 38, "medium").otherwise("low")
    label = (
        F.when(spike & (score >= 55), "Regional holiday rush expected")
        .when(score >= 65, "Monsoon disruption likely")
        .when((score >= 38) & weekend, "Weekend travel rush")
        .when(score >= 38, "Some monsoon risk")
        .otherwise("Good time to travel")
    )
    return F.struct(score.alias("score"), level.alias("level"), label.alias("label"), weekend.alias("is_weekend"))
