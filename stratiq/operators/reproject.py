"""Grids from one projection into another: each cell of the target asks the source at the place that its middle comes from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: SQL text of two coordinates to SQL text of two others, as in ``stratiq.functions.projection``.
Mapping = Callable[[str, str], tuple[str, str]]


@dataclass(frozen=True)
class Lattice:
    """Where the cells of a grid lie: the outer corner of cell (0, 0), and the steps along columns and rows (negative if they run west or south)."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int

    def cells(self, spark: SparkSession) -> DataFrame:
        """row, col of all cells."""
        return spark.range(self.rows * self.cols).select(F.floor(F.col("id") / self.cols).alias("row"), (F.col("id") % self.cols).alias("col"))

    def middle(self, row: str = "row", col: str = "col") -> tuple[str, str]:
        """x and y of a cell's middle, as SQL text."""
        return f"({self.x0!r} + ({col} + CAST(0.5 AS DOUBLE)) * {self.dx!r})", f"({self.y0!r} + ({row} + CAST(0.5 AS DOUBLE)) * {self.dy!r})"

    def place(self, x: str, y: str) -> tuple[str, str]:
        """Row and column of a place, with their fractions, as SQL text; cell (i, j) holds i up to i + 1, j up to j + 1."""
        return f"(({y} - {self.y0!r}) / CAST({self.dy!r} AS DOUBLE))", f"(({x} - {self.x0!r}) / CAST({self.dx!r} AS DOUBLE))"


def _corners(grid: DataFrame, z: str) -> DataFrame:
    """row, col and the values of the cell (_nw), the next in the row (_ne), and those below (_sw, _se); null where a cell is missing."""
    line, column = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    # Places beside a missing cell matter for no target: all four corners must be there.
    pairs = grid.select("row", "col", F.col(z).alias("_nw"), F.when(F.lead("col").over(line) == F.col("col") + 1, F.lead(z).over(line)).alias("_ne"))
    below = F.lead("row").over(column) == F.col("row") + 1
    return pairs.select("row", "col", "_nw", "_ne", F.when(below, F.lead("_nw").over(column)).alias("_sw"), F.when(below, F.lead("_ne").over(column)).alias("_se"))


def reproject(grid: DataFrame, z: str, source: Lattice, target: Lattice, backward: Mapping, method: str = "bilinear", steps: int | None = None) -> DataFrame:
    """row, col, z of all cells of ``target``; ``backward`` takes its coordinates to those of ``source``.

    nearest: the value of the source cell that holds the place.  bilinear: by
    distance from the middles of the four cells around it, null unless all four
    have a value.  Cells outside of the source, and missing values, give null.
    With ``steps``, places are rounded to that part of a cell, which
    makes weights exact where another engine must find the same.
    One join by cell, whatever the method: for bilinear values each source cell
    first takes its neighbours in the next column and row along.
    """
    if method not in ("nearest", "bilinear"):
        raise ValueError(f"unknown method {method}")
    x, y = backward("_x", "_y")
    row, col = source.place("_u", "_v")
    asked = target.cells(grid.sparkSession)
    for names, texts in ((("_x", "_y"), target.middle()), (("_u", "_v"), (x, y)), (("_r", "_c"), (row, col))):
        asked = asked.withColumns({n: F.expr(t) for n, t in zip(names, texts, strict=True)})
    shift = 0.5 if method == "bilinear" else 0.0
    if steps:
        asked = asked.withColumns({c: F.round(F.col(c) * steps) / steps for c in ("_r", "_c")})
    asked = asked.select("row", "col", F.floor(F.col("_r") - shift).alias("_i"), F.floor(F.col("_c") - shift).alias("_j"), (F.col("_r") - shift).alias("_r"), (F.col("_c") - shift).alias("_c"))
    cells = _corners(grid, z) if method == "bilinear" else grid.select("row", "col", F.col(z).alias("_nw"))
    found = asked.join(cells.withColumnsRenamed({"row": "_i", "col": "_j"}), ["_i", "_j"], "left")
    if method == "nearest":
        return found.select("row", "col", F.col("_nw").alias(z))
    down, right = F.col("_r") - F.col("_i"), F.col("_c") - F.col("_j")
    value = (1 - down) * ((1 - right) * F.col("_nw") + right * F.col("_ne")) + down * ((1 - right) * F.col("_sw") + right * F.col("_se"))
    return found.select("row", "col", value.alias(z))
