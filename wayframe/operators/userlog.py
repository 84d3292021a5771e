"""Saved trips and searches as an event log: latest rows, newest lists, sliding limits, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed


def latest_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event per key, found with partial aggregates and no sort of a key's events."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*keys, "r.*")


def current_rows(log: DataFrame, keys: list[str], order: list[str], deleted: Column) -> DataFrame:
    """Latest rows without those whose last event is a deletion."""
    return latest_per_key(log, keys, order).filter(~deleted)


def keep_newest(df: DataFrame, key: str, order: list[str], n: int = 8) -> DataFrame:
    """The newest ``n`` rows per key; Spark cuts each key before the shuffle."""
    over = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("position", F.row_number().over(over)).filter(F.col("position") <= n)


def sliding_limit(
    hits: DataFrame, key: str, ts: str, event_id: str, limit: int, window_s: int
) -> DataFrame:
    """Hits in the trailing window of each hit, whether it is over the limit, and the wait.

    A hit counts those later than ``window_s`` before it and up to itself, also the flagged ones.
    Each key is cut into spans of one window length; a span also holds a copy of the span before as
    history, so no window function sees a whole key.
    """
    if window_s <= 0:
        return hits.withColumn("hits", F.lit(1)).withColumn("flagged", F.lit(False)).withColumn(
            "retry_after", F.lit(None).cast("int")
        )
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width = window_s * 1_000_000
    base = hits.withColumn("__us", micros).withColumn("__span", F.floor(micros / width).cast("bigint"))
    both = base.withColumn("__at", F.explode(F.array(F.col("__span"), F.col("__span") + 1)))
    both = both.withColumn("__own", F.col("__at") == F.col("__span"))
    part = W.partitionBy(key, "__at")
    number = F.row_number().over(part.orderBy("__us", event_id))
    window = window_s * 1_000_000
    expired = F.count(F.lit(1)).over(part.orderBy("__us").rangeBetween(W.unboundedPreceding, -window))
    oldest = F.min("__us").over(part.orderBy("__us").rangeBetween(-(window - 1), 0))
    counted = both.withColumn("__n", number - expired).withColumn("__oldest", oldest)
    out = counted.filter("__own").withColumn("hits", F.col("__n").cast("int")).withColumn("flagged", F.col("hits") > limit)
    retry = F.floor((F.col("__oldest") + window_s * 1_000_000 - F.col("__us")) / 1_000_000) + 1
    out = out.withColumn("retry_after", F.when(F.col("flagged"), retry.cast("int")))
    return out.drop("__us", "__span", "__at", "__own", "__n", "__oldest")


def search_key(place: Column) -> Column:
    return F.lower(F.trim(place))


def recent_searches(log: DataFrame, n: int = 8) -> DataFrame:
    """Newest distinct (from, to) searches per user, whatever their case."""
    keyed = log.withColumn("from_key", search_key(F.col("from_place"))).withColumn("to_key", search_key(F.col("to_place")))
    keyed = keyed.filter((F.col("from_key") != "") & (F.col("to_key") != ""))
    last = latest_per_key(keyed, ["user_id", "from_key", "to_key"], ["ts", "event_id"])
    return keep_newest(last, "user_id", ["ts", "event_id"], n)


def route_snapshots(routes: DataFrame, route: Column, max_chars: int = fixed.ROUTE_JSON_MAX_CHARS) -> DataFrame:
    """Routes as JSON text; rows without a short id or with too long a text are left out."""
    return (
        routes.withColumn("route_json", F.to_json(route))
        .filter(
            F.col("route_id").isNotNull() & (F.col("route_id") != "")
            & (F.length("route_id") <= fixed.ROUTE_ID_MAX_CHARS) & (F.length("route_json") <= max_chars)
        )
    )


def read_snapshots(saved: DataFrame, schema: str) -> DataFrame:
    """Snapshots parsed back, with the time they were saved inside the route."""
    parsed = F.from_json("route_json", schema)
    return saved.withColumn("route", parsed.withField("saved_at", F.col("saved_at")))


def variant_snapshots(saved: DataFrame, json: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Snapshots of any shape as VARIANT in ``route``, and the named fields: (path, type) each, NULL where a snapshot
    has none or one of another kind. A text that is no JSON, or not an object, is ``broken``."""
    parsed = saved.withColumn("route", F.try_parse_json(F.col(json)))
    is_object = F.coalesce(F.schema_of_variant("route").startswith("OBJECT"), F.lit(False))
    found = parsed.withColumn("broken", ~is_object)
    return found.withColumns({name: F.try_variant_get("route", path, kind) for name, (path, kind) in fields.items()})


def snapshot_shapes(snapshots: DataFrame) -> DataFrame:
    """One row: the schema that all sound snapshots have in common."""
    return snapshots.where("NOT broken").agg(F.schema_of_variant_agg("route").alias("shape"))


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that may be searched, and the rejected ones with the reason."""
    def too_long(c):
        return F.length(F.coalesce(c, F.lit(""))) > fixed.PLACE_MAX_CHARS

    reason = (
        F.when(~F.coalesce(F.col("pref").isin(fixed.PREFS), F.lit(False)), "pref")
        .when(~F.coalesce("date", F.lit("")).rlike(r"^(\d{4}-\d{2}-\d{2})?$"), "date")
        .when(too_long(F.col("from_place")) | too_long(F.col("to_place")), "place")
    )
    checked = requests.withColumn("reject_reason", reason)
    return (
        checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        checked.filter(F.col("reject_reason").isNotNull()),
    )
