"""Ordered per-key work that does not put one key into one task.

A key's rows are cut into segments of ``width`` consecutive positions. Windows run inside
(key, segment); each segment is summed up in one row, a window over those few rows carries the
state on, and a join on (key, segment) brings it back. A key that holds a third of the table is
then spread over as many tasks as it has segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENT = "__segment"


def with_segments(df: DataFrame, pos: str, width: int = 1024) -> DataFrame:
    """Rows with the number of their segment; those that have one keep it."""
    return df if SEGMENT in df.columns else df.withColumn(SEGMENT, F.floor(F.col(pos) / width).cast("bigint"))


def segmented(
    df: DataFrame,
    keys: list[str],
    pos: str,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    width: int = 1024,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """Add inclusive running sums, the last value before a row and the first value after it.

    ``lasts`` and ``nexts`` skip NULL values. ``pos`` orders the rows of a key and is unique in it. Rows of a table that
    is bucketed by keys and segment (sinks.bucketed_by_segment) stay where they are. ``lengths`` is a table of the same keys
    and positions that is cheap to read: keys that it shows within the first segment need nothing carried.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    if lengths is not None and SEGMENT not in df.columns:
        beyond = F.coalesce(F.floor(F.col(pos) / width) != 0, F.lit(True))
        long = lengths.filter(beyond).select(*keys).distinct()
        if long.isEmpty():
            return _one_segment(df, keys, pos, sums, lasts, nexts)
        short = _one_segment(df.join(long, keys, "left_anti"), keys, pos, sums, lasts, nexts)
        return short.unionByName(segmented(df.join(long, keys, "left_semi"), keys, pos, sums, lasts, nexts, width))
    work = with_segments(df, pos, width)
    for name, value in {**sums, **lasts, **nexts}.items():
        work = work.withColumn(f"__v_{name}", value)

    inside = W.partitionBy(*keys, SEGMENT).orderBy(pos)
    to_here = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    after = inside.rowsBetween(1, W.unboundedFollowing)
    local = work
    for name in sums:
        local = local.withColumn(f"__l_{name}", F.sum(f"__v_{name}").over(to_here))
    for name in lasts:
        local = local.withColumn(f"__l_{name}", F.last(f"__v_{name}", ignorenulls=True).over(before))
    for name in nexts:
        local = local.withColumn(f"__l_{name}", F.first(f"__v_{name}", ignorenulls=True).over(after))

    facts = [F.sum(f"__v_{name}").alias(f"__s_{name}") for name in sums]
    facts += [
        F.max_by(F.col(f"__v_{name}"), F.when(F.col(f"__v_{name}").isNotNull(), F.col(pos))).alias(f"__s_{name}")
        for name in lasts
    ]
    facts += [
        F.min_by(F.col(f"__v_{name}"), F.when(F.col(f"__v_{name}").isNotNull(), F.col(pos))).alias(f"__s_{name}")
        for name in nexts
    ]
    over = W.partitionBy(*keys).orderBy(SEGMENT)
    earlier = over.rowsBetween(W.unboundedPreceding, -1)
    later = over.rowsBetween(1, W.unboundedFollowing)
    carry = work.groupBy(*keys, SEGMENT).agg(*facts)
    carried = [F.sum(f"__s_{name}").over(earlier).alias(f"__c_{name}") for name in sums]
    carried += [F.last(f"__s_{name}", ignorenulls=True).over(earlier).alias(f"__c_{name}") for name in lasts]
    carried += [F.first(f"__s_{name}", ignorenulls=True).over(later).alias(f"__c_{name}") for name in nexts]
    carry = carry.select(*keys, SEGMENT, *carried)

    out = local.join(carry, [*keys, SEGMENT])
    for name in sums:
        out = out.withColumn(name, F.col(f"__l_{name}") + F.coalesce(F.col(f"__c_{name}"), F.lit(0)))
    for name in [*lasts, *nexts]:
        out = out.withColumn(name, F.coalesce(F.col(f"__l_{name}"), F.col(f"__c_{name}")))
    return out.drop(SEGMENT, *[c for c in out.columns if c.startswith(("__v_", "__l_", "__c_"))])


def _one_segment(
    df: DataFrame, keys: list[str], pos: str, sums: dict[str, Column], lasts: dict[str, Column], nexts: dict[str, Column]
) -> DataFrame:
    """The same for keys whose rows all lie in one segment: windows inside the key, by one shuffle. NULL keys are no keys."""
    inside = W.partitionBy(*keys).orderBy(pos)
    out = df.dropna(subset=keys).repartition(*keys)  # before the values are added, so that these are not sent
    for name, value in {**sums, **lasts, **nexts}.items():
        out = out.withColumn(f"__v_{name}", value)
    over = {name: F.sum(f"__v_{name}").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) for name in sums}
    over |= {name: F.last(f"__v_{name}", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1)) for name in lasts}
    over |= {name: F.first(f"__v_{name}", ignorenulls=True).over(inside.rowsBetween(1, W.unboundedFollowing)) for name in nexts}
    return out.withColumns(over).drop(*[f"__v_{name}" for name in over])


#: Rows of a key that one task orders, and groups in which keys are counted together.
ROWS_PER_KEY, KEY_GROUPS = 65_536, 65_536


def by_weight(df: DataFrame, keys: list[str], limit: int = ROWS_PER_KEY, groups: int = KEY_GROUPS) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys that have at most ``limit`` rows each, and the rows of all others; None where there are none.

    Keys are counted in groups by their hash, which takes no shuffle of the rows: no key has more rows than its group.
    """
    work = df.withColumn("__group", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    many = work.groupBy("__group").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select("__group")
    if many.isEmpty():
        return df, None
    return work.join(many, "__group", "left_anti").drop("__group"), work.join(many, "__group", "left_semi").drop("__group")


def dense_positions(df: DataFrame, keys: list[str], pos: str, name: str = "seq", width: int = 1024) -> DataFrame:
    """1-based position of each row of a key in the order of ``pos`` (unique in the key)."""
    return segmented(df, keys, pos, sums={name: F.lit(1)}, width=width).withColumn(name, F.col(name).cast("int"))


def full_rank(df: DataFrame, keys: list[str], bucket: list[Column], order: list[Column], name: str = "rank") -> DataFrame:
    """Position of every row in its key, for lists that are not cut to a top k.

    ``bucket`` are ascending leading sort keys, ``order`` the whole sort. Rows are numbered inside
    (key, bucket) and shifted by the size of the buckets before.
    """
    names = [f"__b{i}" for i in range(len(bucket))]
    work = df
    for n, b in zip(names, bucket):
        work = work.withColumn(n, b)
    # one value that is never NULL for a key and its bucket: rows are numbered and shifted where one shuffle puts them
    work = work.withColumn("__at", F.struct(*keys, *names)).drop(*names)
    sizes = work.groupBy("__at").agg(F.count(F.lit(1)).alias("__n"))
    inside = [f"__at.{c}" for c in keys]
    over = W.partitionBy(*inside).orderBy(*[f"__at.{n}" for n in names]).rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select("__at", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__shift"))
    local = F.row_number().over(W.partitionBy("__at").orderBy(*order))
    return work.withColumn("__local", local).join(shift, "__at").withColumn(
        name, (F.col("__local") + F.col("__shift")).cast("int")).drop("__at", "__local", "__shift")


def nth_values(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], bucket: Column, count: str = "n") -> DataFrame:
    """Exact order statistics per key for keys of any size.

    Equal values are merged with their count, counts per bucket find the one bucket that holds the
    wanted rank, and only that bucket is ordered by value. ``ranks`` maps an output name to a
    1-based rank written on the column ``count``; ``bucket`` is written on ``__value`` and must not
    decrease with it.
    """
    merged = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__value"))
        .agg(F.count(F.lit(1)).alias("__w"))
        .withColumn("__bucket", bucket)
    )
    over = W.partitionBy(*keys).orderBy("__bucket")
    buckets = merged.groupBy(*keys, "__bucket").agg(F.sum("__w").alias("__bw"))
    buckets = buckets.withColumn(count, F.sum("__bw").over(W.partitionBy(*keys))).withColumn(
        "__upto", F.sum("__bw").over(over.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("__out"), r.cast("bigint").alias("__rank")) for n, r in ranks.items()]))
    hit = (
        buckets.withColumn("__want", wanted)
        .select(*keys, count, "__bucket", "__upto", "__bw", "__want.*")
        .filter((F.col("__rank") <= F.col("__upto")) & (F.col("__rank") > F.col("__upto") - F.col("__bw")))
        .withColumn("__need", F.col("__rank") - (F.col("__upto") - F.col("__bw")))
        .select(*keys, count, "__bucket", "__out", "__need")
    )
    inside = W.partitionBy(*keys, "__bucket", "__out").orderBy("__value").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = (
        merged.join(hit, [*keys, "__bucket"])
        .withColumn("__cum", F.sum("__w").over(inside))
        .filter((F.col("__cum") >= F.col("__need")) & (F.col("__cum") - F.col("__w") < F.col("__need")))
    )
    outs = [F.max(F.when(F.col("__out") == n, F.col("__value"))).alias(n) for n in ranks]
    return found.groupBy(*keys).agg(F.max(count).alias(count), *outs)


def exact_median(df: DataFrame, keys: list[str], value: str, per_unit: float = 100.0, name: str = "median") -> DataFrame:
    """Middle value, or the mean of the two middle values, per key."""
    n = F.col("n")
    both = nth_values(
        df, keys, value,
        {"__lo": F.floor((n + 1) / 2), "__hi": F.floor(n / 2) + 1},
        F.floor(F.col("__value") * per_unit),
    )
    return both.select(*keys, "n", ((F.col("__lo") + F.col("__hi")) / 2).alias(name))
