"""Great-circle distance and the grid cells that turn a radius search into an equi-join."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import EARTH_KM

KM_PER_DEGREE = EARTH_KM * math.pi / 180.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat = F.sin(F.radians(lat2 - lat1) / 2)
    dlng = F.sin(F.radians(lng2 - lng1) / 2)
    a = dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlng * dlng
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def cell(c: Column, step: float) -> Column:
    return F.floor(c / F.lit(step)).cast("int")


def cells_within(lat: Column, lng: Column, radius_km: float, step: float) -> Column:
    """Array of (cell_lat, cell_lng) covering every point within ``radius_km``.

    The longitude span is the exact one of a spherical cap; near a pole it is the whole circle.
    Longitudes wrap at the date line.
    """
    dlat = F.lit(math.degrees(radius_km / EARTH_KM) + 1e-9)
    ratio = F.lit(math.sin(radius_km / EARTH_KM)) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    dlng = F.when(ratio < 1, F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9).otherwise(F.lit(180.0))
    rows = F.sequence(cell(lat - dlat, step), cell(lat + dlat, step))
    turn = int(round(360.0 / step))
    first = int(math.floor(-180.0 / step))
    columns = F.array_distinct(
        F.transform(
            F.sequence(cell(lng - dlng, step), cell(lng + dlng, step)),
            lambda x: (F.pmod(x - F.lit(first), F.lit(turn)) + F.lit(first)).cast("int"),
        )
    )
    return F.flatten(
        F.transform(rows, lambda r: F.transform(columns, lambda k: F.struct(r.alias("cell_lat"), k.alias("cell_lng"))))
    )


def step_for(radius_km: float, per_radius: int = 2) -> float:
    """Cell size in degrees that divides the circle and gives about ``per_radius`` cells per radius."""
    wanted = max(radius_km / KM_PER_DEGREE / per_radius, 0.01)
    return 360.0 / max(1, int(360.0 / wanted))
