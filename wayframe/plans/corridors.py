"""Corridors with their routes, and matching free text to a corridor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.naming import substring_matches


def corridor_routes(corridors: DataFrame, routes: DataFrame) -> DataFrame:
    """The given corridors with their routes; a corridor without routes stays with NULLs."""
    return corridors.join(routes.withColumnRenamed("corridor", "id"), "id", "left")


def match_corridors(requests: DataFrame, corridors: DataFrame, key: str) -> DataFrame:
    """The first corridor whose ends contain the two query texts, per request.

    ``requests`` has ``key``, from_query and to_query; ``corridors`` has corridor, from_name, to_name.
    """
    def hits(side: str) -> DataFrame:
        texts = requests.select(F.lower(f"{side}_query").alias("query"))
        names = corridors.select(F.col(f"{side}_name").alias("name"))
        found = substring_matches(texts, names, low=1).select("query", F.col("name").alias(f"{side}_name"))
        return found.join(corridors.select("corridor", f"{side}_name"), f"{side}_name").select(
            F.col("query").alias(f"{side}_key"), "corridor"
        ).distinct()

    ends = requests.select(F.lower("from_query").alias("from_key"), F.lower("to_query").alias("to_key")).distinct()
    best = (
        ends.join(hits("from"), "from_key").join(hits("to"), ["to_key", "corridor"])
        .groupBy("from_key", "to_key").agg(F.min("corridor").alias("corridor"))
    )
    asked = requests.select(key, F.lower("from_query").alias("from_key"), F.lower("to_query").alias("to_key"))
    return asked.join(best, ["from_key", "to_key"], "left").select(key, "corridor")
