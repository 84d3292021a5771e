"""Column functions for names, train numbers, clocks, class lists and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def _map_of(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, NULL where the key is absent."""
    return F.try_element_at(_map_of(table), key)


# --- names ---------------------------------------------------------------------------------------

def norm_name(c: Column) -> Column:
    """Upper case, anything but A-Z 0-9 as one blank, no outer blanks."""
    letters = F.regexp_replace(F.upper(c), "[^A-Z0-9 ]+", " ")
    return F.regexp_replace(F.trim(letters), r"\s+", " ")


def spaceless(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def alnum_key(c: Column) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def same_name(a: Column, b: Column, min_prefix: int = 5) -> Column:
    """The shorter key starts the longer one; under ``min_prefix`` characters they must be equal."""
    ka, kb = alnum_key(a), alnum_key(b)
    short = F.least(F.length(ka), F.length(kb))
    return (
        F.when(short == 0, F.lit(False))
        .when(short < min_prefix, ka == kb)
        .otherwise(F.left(ka, short) == F.left(kb, short))
    )


def slug(c: Column, size: int = 24) -> Column:
    return F.left(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "_"), F.lit(size))


def strip_parens(c: Column) -> Column:
    """Drop one trailing bracket group."""
    return F.trim(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""))


def place_alias(c: Column) -> Column:
    return F.coalesce(lookup(fixed.PLACE_ALIASES, F.lower(F.trim(c))), c)


def place_name(c: Column) -> Column:
    """Name part of ``Name, State``."""
    return F.trim(F.split_part(c, F.lit(","), F.lit(1)))


def place_hint(c: Column) -> Column:
    """Lower-case second part of ``Name, State``; NULL when there is none."""
    return F.nullif(F.lower(F.trim(F.split_part(c, F.lit(","), F.lit(2)))), F.lit(""))


def trigrams(c: Column) -> Column:
    """Distinct 3-grams per word, each word padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


# --- train numbers -------------------------------------------------------------------------------

def norm_train_no(c: Column) -> Column:
    """Trimmed without leading zeros; an all-zero number stays as it is."""
    bare = F.trim(c)
    return F.coalesce(F.nullif(F.ltrim(bare, F.lit("0")), F.lit("")), bare)


# --- clocks --------------------------------------------------------------------------------------

def parse_clock(c: Column) -> Column:
    """``H:MM`` as ``HH:MM``; NULL unless the hour is 0-23 and the minute 0-59."""
    text = F.trim(c)
    hour = F.regexp_extract(text, r"^(\d{1,2}):(\d{2})$", 1).try_cast("int")
    minute = F.regexp_extract(text, r"^(\d{1,2}):(\d{2})$", 2).try_cast("int")
    return F.when((hour <= 23) & (minute <= 59), F.format_string("%02d:%02d", hour, minute))


def clock_minutes(c: Column) -> Column:
    """Minutes after midnight of ``HH:MM[:SS]``; blank or ``None`` give NULL."""
    hour = F.split_part(c, F.lit(":"), F.lit(1)).try_cast("int")
    minute = F.split_part(c, F.lit(":"), F.lit(2)).try_cast("int")
    return hour * 60 + minute


def minutes_clock(c: Column) -> Column:
    m = c.cast("int")
    return F.when(m.isNotNull(), F.format_string("%02d:%02d", F.floor(m / 60), F.pmod(m, F.lit(60))))


def clock_hour(c: Column) -> Column:
    """Hour of a clock text, -1 where there is none."""
    return F.coalesce(
        F.when(F.contains(c, F.lit(":")), F.split_part(c, F.lit(":"), F.lit(1)).try_cast("int")), F.lit(-1)
    )


def is_late_night(c: Column) -> Column:
    hour = F.substring(c, 1, 2).try_cast("int")
    return F.coalesce((hour >= 23) | (hour < 5), F.lit(False))


def departure_window(c: Column) -> Column:
    """Name of the departure window an ``HH:MM`` clock falls in."""
    hour = F.substring(c, 1, 2).try_cast("int")
    out = None
    for key, first, end in fixed.DEPARTURE_WINDOWS:
        hit = (hour >= first) & (hour < end) if first < end else (hour >= first) | (hour < end)
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out


def in_departure_windows(c: Column, chosen: Column) -> Column:
    """No clock, no usable hour or no chosen window means no filter."""
    window = departure_window(c)
    return F.when(window.isNull() | (F.size(chosen) == 0), F.lit(True)).otherwise(F.array_contains(chosen, window))


# --- class lists, running days, seasons ----------------------------------------------------------

def csv_items(c: Column) -> Column:
    """Comma list as an array without blanks; NULL gives an empty array."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def guess_classes(type_code: Column) -> Column:
    head = F.upper(F.split_part(F.coalesce(type_code, F.lit("")), F.lit("-"), F.lit(1)))
    return F.coalesce(lookup(fixed.CLASSES_BY_TYPE, head), F.lit(fixed.CLASSES_DEFAULT))


def weekday_codes(flags: list[Column]) -> Column:
    """Seven Y/N flags as ``MON,TUE,...``."""
    return F.concat_ws(",", *[F.when(f == "Y", F.lit(d)) for f, d in zip(flags, fixed.WEEKDAYS)])


def days_label(c: Column) -> Column:
    """``Daily`` for seven days, else short names in week order; NULL when unknown."""
    days = csv_items(c)
    named = F.transform(
        F.filter(F.array(*[F.lit(d) for d in fixed.WEEKDAYS]), lambda d: F.array_contains(days, d)), lambda d: F.initcap(d)
    )
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.size(days) == 7, F.lit("Daily"))
        .otherwise(F.array_join(named, ", "))
    )


def month_numbers(c: Column) -> Column:
    """Comma list of months as distinct sorted ints."""
    return F.array_sort(F.array_distinct(F.transform(csv_items(c), lambda m: m.cast("int"))))


def season_label(months: Column) -> Column:
    names = F.array(*[F.lit(m) for m in fixed.MONTH_SHORT])
    listed = F.array_join(F.transform(F.array_sort(months), lambda m: F.element_at(names, m)), ", ")
    return F.when(F.size(months) > 0, F.concat(F.lit("Seasonal · runs in "), listed))


# --- display -------------------------------------------------------------------------------------

def format_duration(minutes: Column) -> Column:
    m = minutes.cast("int")
    return F.concat(F.floor(m / 60).cast("string"), F.lit("h "), F.pmod(m, F.lit(60)).cast("string"), F.lit("min"))


def format_inr(amount: Column) -> Column:
    """Rupees with the last three digits grouped, then pairs."""
    return F.concat(F.lit("₹"), F.regexp_replace(amount.cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,"))


def day_month_label(day_text: Column, fallback: Column) -> Column:
    """Short weekday, day and month; the fallback timestamp where the date is blank; NULL if invalid."""
    day = F.when(F.coalesce(day_text, F.lit("")) == "", fallback.cast("date")).otherwise(F.try_to_date(day_text))
    return F.date_format(day, "E, d MMM")


def day_month_year_label(day_text: Column) -> Column:
    return F.date_format(F.try_to_date(day_text), "d MMM yyyy")


def first_hop(forwarded: Column, peer: Column) -> Column:
    """First address of a forwarded-for list, else the peer."""
    return F.when(
        F.coalesce(forwarded, F.lit("")) != "", F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    ).otherwise(F.coalesce(peer, F.lit("unknown")))


def refresh_road_note(note: Column, km: Column) -> Column:
    """Put a measured road length into a ``~N km road to`` note."""
    fresh = F.concat(F.lit("~"), F.bround(km).cast("int").cast("string"), F.lit(" km"))
    return F.when(F.contains(note, F.lit("km road to")), F.regexp_replace(note, F.lit(r"~\d+ km"), fresh)).otherwise(note)
