"""Vegetation indices and the leaf-area network over reflectances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import C, col, div


def ndvi(nir: C, red: C) -> Column:
    return div(col(nir) - col(red), col(nir) + col(red))


def kndvi(nir: C, red: C) -> Column:
    return F.tanh(F.pow(ndvi(nir, red), F.lit(2.0)))


def savi(nir: C, red: C, soil: float = 0.5) -> Column:
    return div((col(nir) - col(red)) * (1 + soil), col(nir) + col(red) + soil)


def evi(nir: C, red: C, blue: C) -> Column:
    return div((col(nir) - col(red)) * 2.5, col(nir) + col(red) * 6.0 - col(blue) * 7.5 + 1.0)


def mask_classes(value: C, cls: C, blanked: tuple) -> Column:
    """Null where the class is one of those blanked."""
    return F.when(~col(cls).isin(*blanked), col(value))


def tansig(x: Column) -> Column:
    return F.lit(2.0) / (F.lit(1.0) + F.exp(x * -2.0)) - 1.0


def scaled(x: C, low: float, high: float) -> Column:
    """[low, high] to [-1, 1]."""
    return (col(x) - low) * 2.0 / (high - low) - 1.0


def unscaled(x: Column, low: float, high: float) -> Column:
    return (x + 1.0) * 0.5 * (high - low) + low


def network(inputs: list[Column], hidden: list[list[float]], output: list[float]) -> Column:
    """One hidden layer of tansig neurons; each list holds a bias and then one weight per input."""
    layer = lambda row, xs: reduce(lambda a, b: a + b, [x * F.lit(w) for w, x in zip(row[1:], xs, strict=True)], F.lit(row[0]))
    return layer(output, [tansig(layer(row, inputs)) for row in hidden])
