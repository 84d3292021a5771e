"""Written steps, split points and column names for the operators of this package."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayframe.session import release, scratch_folder


class Steps:
    """Tables written as Parquet below one new folder that every executor reaches; they cut the lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = scratch_folder(spark, label)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(taken: Iterable[str], base: str) -> str:
    """A column name that none of the taken ones equals, whatever its case."""
    used = {c.lower() for c in taken}
    while base.lower() in used:
        base += "_"
    return base


def id_ranges(df: DataFrame, column: str, rows: int, knots: int = 256) -> Column:
    """Number of the id range of a row, ascending with the id: ranges of about ``rows`` rows; null ids are in range 0.

    At most ``knots`` quantiles come to the driver. Beyond so many ranges, each gap between two of them is cut evenly.
    """
    ids = F.col(column).cast("long")
    size = df.agg(F.count("*").alias("n"), F.min(ids).alias("low"), F.max(ids).alias("high")).first()
    pieces = max(1, -(-size["n"] // rows))
    if pieces == 1 or size["low"] is None:
        return F.lit(0).cast("long")
    coarse = min(pieces, knots)
    fine = -(-pieces // coarse)
    shares = [i / coarse for i in range(1, coarse)]
    inner = df.agg(F.percentile_approx(ids, shares, 20 * coarse).alias("cuts")).first()["cuts"]
    cuts = sorted({size["low"], *inner, size["high"] + 1})
    low, high = F.array(*map(F.lit, cuts[:-1])), F.array(*map(F.lit, cuts[1:]))
    gap = F.greatest(F.size(F.filter(low, lambda x: x <= ids)), F.lit(1))
    first, last = F.element_at(low, gap), F.element_at(high, gap)
    inside = F.least(F.lit(fine - 1), F.floor((ids - first) * F.lit(float(fine)) / (last - first)))
    return F.coalesce(((gap - 1) * fine + inside).cast("long"), F.lit(0).cast("long"))


def kept_by_worker(name: str, make: Callable):
    """An object that a Python worker makes once and keeps from task to task: something remembered, never a result."""
    store = sys.modules.setdefault("wayframe_kept_by_worker", ModuleType("wayframe_kept_by_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]
