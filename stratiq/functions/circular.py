"""Directions in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import C, col


def circular_mean(angle: C) -> Column:
    """Aggregate: the mean direction in [0, 360)."""
    x = F.radians(col(angle).cast("double"))
    mean = F.degrees(F.atan2(F.avg(F.sin(x)), F.avg(F.cos(x))))
    return F.when(mean < 0, mean + 360).otherwise(mean)


def southness(aspect: C) -> Column:
    """1 for south, 0 for north."""
    return (F.cos(F.radians(col(aspect).cast("double")) - F.lit(3.141592653589793)) + 1) / 2


def windwardness(aspect: C, wind: C) -> Column:
    """1 where a slope faces the wind, -1 in its lee."""
    return F.cos(F.radians(col(aspect).cast("double") - col(wind)))


def season(month: C) -> Column:
    """April to September is Summer, the rest Winter."""
    return F.when(col(month).between(4, 9), "Summer").otherwise("Winter")


def utm_epsg(lon: C, lat: C) -> Column:
    """EPSG code of the UTM zone: 326xx in the north, 327xx in the south."""
    zone = (F.floor((col(lon) + 180) / 6) + 1).cast("int")
    return F.when(col(lat) >= 0, F.lit(32600) + zone).otherwise(F.lit(32700) + zone)
