"""Writers.  Spark's commit protocol makes each of them all or nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition: Sequence[str] = ()) -> None:
    """Parquet; overwrite, append, or 'ignore' to leave what is there."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_tiles(cells: DataFrame, path: str, tile: str) -> None:
    """Cells partitioned by tile, each tile's rows together."""
    cells.repartition(tile).write.mode("overwrite").partitionBy(tile).parquet(path)


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Named layers, each a table of its own columns below ``path``.  A layer that is there is replaced, others stay; empty ones are not written."""
    for name, df in layers.items():
        if not df.isEmpty():
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_layer(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to the end: Spark marks it when all its tasks have committed."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def unless_present(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A step's table: read if a run has completed it, otherwise built and written.  An incomplete table is replaced."""
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_cube(df: DataFrame, path: str, time: str) -> None:
    """A cube of cells and times, a folder for each day (``_day``): ranges of time are read alone."""
    day = F.to_date(time)
    df.withColumn("_day", day).repartition("_day").write.mode("overwrite").partitionBy("_day").parquet(path)


def read_cube(spark: SparkSession, path: str, time: str, start: str, end: str) -> DataFrame:
    """The cube's cells of a closed range of times; the days outside are not read."""
    first, last = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    rows = spark.read.parquet(path).filter(F.col("_day").between(F.to_date(first), F.to_date(last)))
    return rows.filter(F.col(time).cast("timestamp_ntz").between(first, last)).drop("_day")


def write_grids(grids: DataFrame, names: Sequence[str], path: str, nodata: float = -99999.0) -> None:
    """Several grids of one extent in one table: row, col and a column for each name, null and NaN as ``nodata``."""
    grids.select("row", "col", *[F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(nodata)), F.lit(nodata)).alias(n) for n in names]).write.mode("overwrite").parquet(path)


def read_grids(spark: SparkSession, path: str, nodata: float = -99999.0) -> DataFrame:
    """What :func:`write_grids` wrote, ``nodata`` as null."""
    df = spark.read.parquet(path)
    return df.select("row", "col", *[F.nullif(F.col(c), F.lit(nodata)).alias(c) for c in df.columns if c not in ("row", "col")])
