"""Table and side-file writers. Every job takes ``write=False`` to report without writing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.segments import SEGMENT, with_segments


def overwrite_table(df: DataFrame, path: str, partition_by: list[str] | None = None, write: bool = True) -> DataFrame:
    """Replace a Parquet table."""
    if write:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df


def bucketed_by_segment(df: DataFrame, path: str, keys: list[str], pos: str, buckets: int = 64, width: int = 1024) -> DataFrame:
    """Write rows bucketed by keys and segment of positions, sorted, and read them from there as a table.

    Windows and groups by (keys, segment), as `operators/segments.py` makes them, then need no shuffle of the rows, and a key
    that holds a third of them is spread over the buckets of its segments. The table is named in the session's catalog.
    """
    work = with_segments(df, pos, width)
    by = [*keys, SEGMENT]
    name = f"bucketed_{uuid.uuid4().hex}"
    # a task per bucket, so that each is one file
    work.repartition(buckets, *by).write.mode("overwrite").option("path", path).bucketBy(buckets, *by).sortBy(*by, pos).saveAsTable(name)
    return df.sparkSession.table(name)


def append_table(df: DataFrame, path: str, write: bool = True) -> DataFrame:
    if write:
        df.write.mode("append").parquet(path)
    return df


def add_rows(existing: DataFrame, new: DataFrame, path: str, write: bool = True) -> None:
    """Make the table at ``path`` hold both: if it already is there, as ``existing``, only the new rows are written."""
    if not write:
        return
    folder = new.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(new.sparkSession._jsc.hadoopConfiguration()).exists(folder):
        new.write.mode("append").parquet(path)
    else:
        existing.unionByName(new, allowMissingColumns=True).write.parquet(path)


def write_json(df: DataFrame, path: str, write: bool = True) -> DataFrame:
    if write:
        df.write.mode("overwrite").json(path)
    return df


def distance_maps(distances: DataFrame, min_stations: int = 2) -> DataFrame:
    """(train_number, station -> km map) of trains with enough measured stations, one row per train."""
    sized = distances.groupBy("train_number").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("station_code", "cum_km")))).alias("stations")
    )
    return sized.filter(F.size("stations") >= min_stations)


def map_km(maps_col: str, start, end):
    """Distance between two stations of a map column; NULL when one is missing."""
    return F.abs(F.try_element_at(F.col(maps_col), end) - F.try_element_at(F.col(maps_col), start))


def fare_table(knots: DataFrame, fits: DataFrame) -> DataFrame:
    """One row per class: its knots as [km, fare] pairs and its linear fit."""
    points = knots.groupBy("class_code").agg(
        F.array_sort(F.collect_list(F.array("km", "fare"))).alias("points")  # knots of a fitted curve
    )
    return points.join(fits.select("class_code", F.struct("rate", "base").alias("fit")), "class_code", "left")


def repair_audit(remap: DataFrame, flagged: DataFrame) -> DataFrame:
    """Proposed remaps and flagged stations as one tagged table, busiest first when written."""
    a = remap.select(F.lit("remap").alias("section"), "trains", F.to_json(F.struct(*remap.columns)).alias("entry"))
    b = flagged.select(F.lit("flagged").alias("section"), "trains", F.to_json(F.struct(*flagged.columns)).alias("entry"))
    return a.unionByName(b).orderBy("section", F.desc("trains"), "entry")
