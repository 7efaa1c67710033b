"""Station series: seasons, directions, windows of time; batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiq.functions.circular import circular_mean, season
from stratiq.functions.numeric import sector

from .relational import panels, shares


def in_days(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Rows of [first, last + 1 day)."""
    return df.filter((F.col(ts) >= F.lit(first).cast("timestamp_ntz")) & (F.col(ts) < F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")))


def wind_means() -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "mean_ws": F.avg("ws"), "mean_wd": circular_mean("wd")}


def wind_overall(df: DataFrame) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in wind_means().items()], F.max("ws").alias("max_ws"))


def wind_by_station(df: DataFrame) -> DataFrame:
    return df.groupBy("station").agg(*[c.alias(n) for n, c in wind_means().items()], F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def mean_of_means(df: DataFrame) -> DataFrame:
    """Means over stations for each time stamp, then over time stamps, by season and for the year."""
    per = df.groupBy("ts").agg(F.avg("ws").alias("ws"), circular_mean("wd").alias("wd")).withColumn("period", season(F.month("ts")))
    return panels(per, "period", "Annual", mean_ws=F.avg("ws"), mean_wd=circular_mean("wd"))


def direction_shares(df: DataFrame, by_station: bool, width: float = 30.0) -> DataFrame:
    rows = df.withColumn("sector", sector("wd", width)).filter("sector is not null")
    return shares(rows, ["station", "sector"], within=["station"]) if by_station else shares(rows, ["sector"])


def wind_rose(df: DataFrame, width: float, speeds: list[float]) -> DataFrame:
    """Counts by direction sector and speed class (the number of cuts at or below the speed)."""
    cls = F.size(F.filter(F.array(*map(F.lit, speeds)), lambda c: c <= F.col("ws")))
    return df.filter("ws is not null").withColumn("sector", sector("wd", width)).withColumn("speed_class", cls).groupBy("sector", "speed_class").agg(F.count(F.lit(1)).alias("n"))


def tumbling(df: DataFrame, ts: str, size: str, *by: str) -> DataFrame:
    """n and mean of ws for each window; works on streams with a watermark."""
    out = df.groupBy(F.window(ts, size), *by).agg(F.count(F.lit(1)).alias("n"), F.avg("ws").alias("mean_ws"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "mean_ws")


def sliding(df: DataFrame, ts: str, size: str, step: str) -> DataFrame:
    out = df.groupBy(F.window(ts, size, step)).agg(F.count(F.lit(1)).alias("n"), F.avg("ws").alias("mean_ws"))
    return out.select(F.col("window.start").alias("start"), "n", "mean_ws")


def sessions(df: DataFrame, ts: str, by: str, gap: str) -> DataFrame:
    out = df.groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def dedup_overlap(parts: DataFrame, keys: list[str], priority: str, value: str) -> DataFrame:
    """Historical and recent rows of one key and time: the row of the highest priority."""
    return parts.groupBy(*keys).agg(F.max_by(value, priority).alias(value), F.count(F.lit(1)).alias("copies"))
