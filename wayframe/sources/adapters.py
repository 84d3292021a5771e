"""The supplied Parquet tables seen as a transport network.

The tables carry no stations, clocks or coordinates; fixed arithmetic derives them. Every view uses
the whole table. Real input comes through ``sources.files``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import minutes_clock
from ..operators.delays import clean_observations
from ..operators.segments import by_weight, full_rank, segmented
from ..operators.timetable import with_train_counts
from ..session import cut_lineage


class Network:
    """Views on one folder of tables. Views are lazy DataFrames; stops are written once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- timetable -------------------------------------------------------------------------------

    def stops(self) -> DataFrame:
        """lineitem as train stops with clocks, journey day and cumulative km; written once for all readers."""
        return self._stops

    @cached_property
    def _stops(self) -> DataFrame:
        """Lines of most orders are numbered and summed where one shuffle puts them.

        Lines of orders that may be too large for a task are numbered and summed in segments.
        """
        order = ["l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate"]
        by = [F.col(c) for c in order]
        lines = self.table("lineitem").select("l_orderkey", *order).dropna(subset=["l_orderkey"])
        first = F.col("seq") == 1
        ride = F.when(first, 0).otherwise(33 + F.col("l_partkey") % 180)
        length = F.when(first, 0).otherwise(20 + F.col("l_partkey") % 150)
        short, long = by_weight(lines, ["l_orderkey"])
        numbered = short.withColumn("seq", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*by)))
        inside = W.partitionBy("l_orderkey").orderBy("seq")
        to_here = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = numbered.select(
            "l_orderkey", "l_suppkey", "seq", F.sum(ride).over(to_here).alias("ride"), F.sum(length).over(to_here).alias("km"),
            F.lead(F.lit(1)).over(inside).alias("more"),
        )
        if long is not None:
            numbered = full_rank(long, ["l_orderkey"], [F.col("l_linenumber")], by, "seq")
            numbered = cut_lineage(numbered.select("l_orderkey", "l_suppkey", "l_partkey", "seq"))
            carried = segmented(numbered, ["l_orderkey"], "seq", sums={"ride": ride, "km": length}, nexts={"more": F.lit(1)})
            rows = rows.unionByName(carried.select(*rows.columns))
        rows = rows.withColumn("a", F.col("l_orderkey") * 17 % 1430 + F.col("ride"))
        last = F.col("more").isNull()
        end = F.when(last, F.col("a")).otherwise(F.col("a") + 3)
        return cut_lineage(rows.select(
            F.lpad(F.col("l_orderkey").cast("string"), 7, "0").alias("train_number"),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("station_code"),
            F.col("seq").cast("int").alias("seq"),
            F.when(~first, (F.col("a") % 1440).cast("int")).alias("arr_min"),
            F.when(~last, ((F.col("a") + 3) % 1440).cast("int")).alias("dep_min"),
            (F.floor(end / 1440) + 1).cast("int").alias("day"),
            F.col("km").cast("double").alias("cum_km"),
        ))

    def stations_raw(self) -> DataFrame:
        """supplier as stations, named after the places."""
        k = F.col("s_suppkey")
        nation = self.table("nation")
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("S"), k.cast("string")).alias("code"),
            F.concat(F.lit("CITY_"), (k % 400).cast("string"), F.lit(" JN")).alias("name"),
            F.col("n_name").alias("state"),
            (F.lit(8.0) + (k * 37 % 280) / 10.0).alias("lat"),
            (F.lit(68.0) + (k * 53 % 290) / 10.0).alias("lng"),
        )

    def stations(self) -> DataFrame:
        return with_train_counts(self.stations_raw(), self.stops())

    def trains(self) -> DataFrame:
        """orders as trains with names, classes, running days and operating months."""
        k = F.col("o_orderkey")
        mask = (k % 127 + 1).cast("int")
        days = F.array_compact(
            F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, F.lit(d)) for i, d in enumerate(fixed.WEEKDAYS)])
        )
        kind = F.left("o_orderpriority", F.lit(1))
        name = (
            F.when(kind == "1", "RAJDHANI").when(kind == "2", "SHATABDI").when(kind == "3", "SF EXP")
            .when(kind == "4", "EXP").otherwise("PASSENGER")
        )
        status = F.col("o_orderstatus")
        classes = F.when(status == "P", "SL,3A,2A").when(status == "F", "1A,2A,3A,SL").otherwise("CC,2S,EC")
        day_list = F.when(k % 50 != 0, days)
        return self.table("orders").select(
            F.lpad(k.cast("string"), 7, "0").alias("number"),
            F.concat(F.lit("T"), k.cast("string"), F.lit(" "), name).alias("name"),
            name.alias("kind"),
            F.split(classes, ",").alias("classes"),
            classes.alias("class_text"),
            day_list.alias("days"),
            F.array_join(day_list, ",").alias("days_of_week"),
            F.when(k % 20 == 0, F.array(F.month("o_orderdate"))).alias("months"),
            F.to_date("o_orderdate").alias("first_day"),
        )

    def blob(self) -> DataFrame:
        """Stops of each train as one text."""
        names = self.stations_raw().select(F.col("code").alias("station_code"), "name")
        arr = F.coalesce(minutes_clock(F.col("arr_min")), F.lit("Source"))
        dep = F.coalesce(minutes_clock(F.col("dep_min")), F.lit("Destination"))
        part = F.concat("name", F.lit(" (arr="), arr, F.lit(",dep="), dep, F.lit(")"))
        rows = self.stops().join(names, "station_code").select("train_number", "seq", part.alias("part"))
        listed = rows.groupBy("train_number").agg(F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("l"))
        return listed.select(
            F.col("train_number").alias("train_no"),
            F.array_join(F.transform("l", lambda x: x["part"]), " | ").alias("intermediate_stops"),
        )

    # --- observations and fares ------------------------------------------------------------------

    def observations_raw(self) -> DataFrame:
        """events as delay observations spread over a year; errors carry no delay."""
        return self.table("events").select(
            F.lpad(F.col("user_id").cast("string"), 7, "0").alias("train_no"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 365).cast("int")).alias("obs_date"),
            (F.col("event_id") % 5 + 1).cast("int").alias("station_no"),
            F.when(F.col("event_type") == "error", "").otherwise((F.col("value") - 20).cast("string")).alias("delay"),
            "event_id",
        )

    def observations(self) -> DataFrame:
        return clean_observations(self.observations_raw())

    def quotes(self) -> DataFrame:
        """lineitem as fare quotes."""
        flag = F.col("l_returnflag")
        return self.table("lineitem").select(
            F.when(flag == "A", "SL").when(flag == "N", "3A").otherwise("2A").alias("class_code"),
            (F.col("l_quantity") * 40.0).alias("km"),
            (F.col("l_extendedprice") / 100.0 + 3.0 * F.col("l_quantity")).alias("fare"),
        )

    # --- places and requests ---------------------------------------------------------------------

    def places(self) -> DataFrame:
        """customer as a gazetteer in which names repeat."""
        k = F.col("c_custkey")
        nation = self.table("nation")
        return self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            k.alias("id"),
            F.concat(F.lit("CITY_"), (k % 400).cast("string")).alias("name"),
            F.concat(F.lit("City_"), (k % 400).cast("string")).alias("asciiname"),
            F.col("n_name").alias("state"),
            F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("admin1"),
            F.bround("c_acctbal").cast("bigint").alias("population"),
            (F.lit(8.0) + (k * 41 % 280) / 10.0).alias("lat"),
            (F.lit(68.0) + (k * 59 % 290) / 10.0).alias("lng"),
        )

    def requests(self) -> DataFrame:
        """One trip request per customer."""
        k = F.col("c_custkey")
        total = self.table("customer").agg(F.count(F.lit(1)).alias("total"))
        one = F.lit(1).alias("one")
        rows = self.table("customer").select("c_custkey", one).join(F.broadcast(total.select("total", one)), "one")
        to = (k * 7 + 3) % F.col("total")
        return rows.select(
            k.alias("request_id"),
            F.concat(F.lit("CITY_"), (k % 400).cast("string")).alias("from_place"),
            F.concat(F.lit("CITY_"), (to % 400).cast("string")).alias("to_place"),
            F.when(k % 3 == 0, "confirmed").when(k % 3 == 1, "cheapest").otherwise("fastest").alias("pref"),
            F.when(k % 7 == 0, "").otherwise(
                F.date_add(F.lit("2025-01-01").cast("date"), (k % 730).cast("int")).cast("string")
            ).alias("date"),
        )

    # --- ready-made routes -----------------------------------------------------------------------

    def routes(self) -> DataFrame:
        """orders as scored routes, about ten per request."""
        k = F.col("o_orderkey")
        cross = (k % 2 == 1) | (k % 3 == 0)
        road = k % 17 == 0
        return self.table("orders").select(
            F.col("o_custkey").alias("request_id"), k.alias("route_id"),
            F.bround(F.col("o_totalprice") / 100).cast("int").alias("fare"),
            (k * 13 % 1440).cast("int").alias("minutes"),
            (25 + k * 7 % 73).cast("int").alias("reliability"),
            (k % 2).cast("int").alias("transfers"),
            F.when(cross, "cross-origin").otherwise("direct").alias("route_type"),
            F.when(cross, F.concat(F.lit("H"), (k % 10).cast("string"))).alias("hub"),
            F.concat(F.lit("T"), (F.floor(k / 10) % 3).cast("string")).alias("first_train"),
            F.when(~road, (k * 31 % 1440).cast("int")).alias("dep_min"),
            F.when(~road, (k * 44 % 1440).cast("int")).alias("arr_min"),
            road.alias("road_only"),
            F.when(F.col("o_custkey") % 3 == 0, "confirmed").when(F.col("o_custkey") % 3 == 1, "cheapest")
            .otherwise("fastest").alias("pref"),
            F.when(k % 5 != 0, k % 5 < 3).alias("ac_available"),
            F.when(k % 11 != 0, F.split(
                F.when(F.col("o_orderstatus") == "P", "SL,3A,2A").when(F.col("o_orderstatus") == "F", "1A,2A,3A,SL")
                .otherwise("CC,2S,EC"), ",")).alias("classes"),
            (k % 60).cast("int").alias("first_mile_minutes"), (20 + k % 300).cast("int").alias("first_mile_fare"),
            F.to_date("o_orderdate").alias("travel_day"),
            (k % 400 / 4.0).cast("double").alias("first_km"), (k % 90 / 3.0).cast("double").alias("last_km"),
        )
