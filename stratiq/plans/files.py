"""Grids and cubes written as files of their own formats and read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiq.operators.reproject import Lattice
from stratiq.sources import gridfiles
from stratiq.sources.scratch import removed_at_end, scratch_path

from .registry import query
from .views import table, twin, v_grid


def _lattice(cells: DataFrame) -> Lattice:
    """Unit cells from the origin on, as far as the grid goes."""
    far = cells.agg(F.max("row").alias("row"), F.max("col").alias("col")).first()
    return Lattice(0.0, 0.0, 1.0, 1.0, int(-1 if far["row"] is None else far["row"]) + 1, int(-1 if far["col"] is None else far["col"]) + 1)


def _place(spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, name)
    removed_at_end(spark, path)
    return path


def _cell(axis: str) -> Column:
    return F.floor(axis)


@query(twin("SELECT row, col, z, CASE WHEN lab = 'F' THEN z END AS done FROM v_grid"))
def tiff_cells(spark, sf_dir):
    """The grid as GeoTIFF tiles of two bands, the second with gaps, and its cells from these files."""
    grid = v_grid(spark, sf_dir).withColumn("done", F.when(F.col("lab") == "F", F.col("z")))
    path = _place(spark, "tiffs")
    if not gridfiles.write_tiffs(grid, ["z", "done"], path, _lattice(grid)):
        return grid.select("row", "col", "z", "done")
    cells = gridfiles.read_files(spark, "geotiff", path).filter("b1 IS NOT NULL")
    return cells.select(_cell("y").alias("row"), _cell("x").alias("col"), F.col("b1").alias("z"), F.col("b2").alias("done"))


@query("SELECT CAST(floor(user_id / 10e0) AS BIGINT) AS row, user_id % 10 AS col, date_trunc('hour', ts) AS ts, max(value) AS value FROM events GROUP BY 1, 2, 3 HAVING max(value) IS NOT NULL")
def netcdf_cells(spark, sf_dir):
    """Hourly maxima of stations on a grid as NetCDF files by day and tile, and their cells from these files."""
    user = F.col("user_id")
    hours = table(spark, sf_dir, "events").groupBy(F.floor(user / 10).alias("row"), (user % 10).alias("col"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max("value").alias("value"))
    path = _place(spark, "cubes")
    if not gridfiles.write_cubes(hours, "value", path, _lattice(hours)):
        return hours
    cells = gridfiles.read_files(spark, "netcdf", path).filter("value IS NOT NULL")
    return cells.select(_cell("y").alias("row"), _cell("x").alias("col"), "ts", "value")
