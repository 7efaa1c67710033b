"""Station series: wind summaries, shares, roses, days and windows of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiq.functions import circular
from stratiq.functions.numeric import r6, sector
from stratiq.functions.spectral import mask_classes
from stratiq.operators import relational as R, temporal as T

from .registry import query
from .views import table, twin, v_ts, whole

_WD = "degrees(atan2(avg(sin(radians(wd))), avg(cos(radians(wd)))))"


def _circ(round_: int = 6, expr: str = _WD) -> str:
    return f"round(CASE WHEN {expr} < 0 THEN {expr} + 360 ELSE {expr} END, {round_})"


@query(twin(f"SELECT count(*) AS n, round(avg(ws), 6) AS mean_ws, {_circ()} AS mean_wd, max(ws) AS max_ws FROM v_ts"))
def wind_overall_summary(spark, sf_dir):
    return T.wind_overall(v_ts(spark, sf_dir)).select("n", r6("mean_ws").alias("mean_ws"), r6("mean_wd").alias("mean_wd"), "max_ws")


@query(twin(f"SELECT station, count(*) AS n, round(avg(ws), 6) AS mean_ws, {_circ()} AS mean_wd, min(ts) AS first_ts, max(ts) AS last_ts FROM v_ts GROUP BY station"))
def wind_station_summary(spark, sf_dir):
    return T.wind_by_station(v_ts(spark, sf_dir)).select("station", "n", r6("mean_ws").alias("mean_ws"), r6("mean_wd").alias("mean_wd"), "first_ts", "last_ts")


@query(twin(f"SELECT CAST(hour(ts) AS INTEGER) AS hour, {_circ()} AS mean_wd FROM v_ts GROUP BY hour(ts)"))
def circular_mean(spark, sf_dir):
    return v_ts(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(r6(circular.circular_mean("wd")).alias("mean_wd"))


_ORDERS = "SELECT o_orderdate AS ts, o_totalprice AS ws, CAST((o_orderkey * 37) % 360 AS DOUBLE) AS wd FROM orders"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("ws"), ((F.col("o_orderkey") * 37) % 360).cast("double").alias("wd"))


@query(twin(
    f"SELECT coalesce(period, 'Annual') AS period, round(avg(ws), 4) AS mean_ws, {_circ(4)} AS mean_wd FROM (SELECT *, CASE WHEN month(ts) BETWEEN 4 AND 9 THEN 'Summer' ELSE 'Winter' END AS period FROM p) GROUP BY ROLLUP (period)",
    o=_ORDERS, p=f"SELECT ts, avg(ws) AS ws, CASE WHEN {_WD} < 0 THEN {_WD} + 360 ELSE {_WD} END AS wd FROM o GROUP BY ts"))
def mean_of_means_season(spark, sf_dir):
    return T.mean_of_means(_orders(spark, sf_dir)).select("period", F.round("mean_ws", 4).alias("mean_ws"), F.round("mean_wd", 4).alias("mean_wd"))


@query(twin("SELECT station, ts, CAST(CASE WHEN wd >= 0 AND wd <= 360 THEN least(floor(wd / 30), 11) END AS INTEGER) AS sector FROM v_ts"))
def sector_bins(spark, sf_dir):
    return v_ts(spark, sf_dir).select("station", "ts", sector("wd").alias("sector"))


_SECTOR = "SELECT station, ws, CAST(least(floor(wd / 30), 11) AS INTEGER) AS sector FROM v_ts"


@query(twin("SELECT sector, count(*) AS n, round(count(*) / sum(CAST(count(*) AS DOUBLE)) OVER (), 6) AS share FROM s GROUP BY sector", s=_SECTOR))
def dir_freq_overall(spark, sf_dir):
    return T.direction_shares(v_ts(spark, sf_dir), False).select("sector", "n", r6("share").alias("share"))


@query(twin("SELECT station, sector, count(*) AS n, round(count(*) / sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY station), 6) AS share FROM s GROUP BY station, sector", s=_SECTOR))
def dir_freq_by_station(spark, sf_dir):
    return T.direction_shares(v_ts(spark, sf_dir), True).select("station", "sector", "n", r6("share").alias("share"))


@query(twin("SELECT CAST(least(floor(wd / 10), 35) AS INTEGER) AS sector, CAST((ws >= 2) AS INTEGER) + CAST((ws >= 5) AS INTEGER) + CAST((ws >= 20) AS INTEGER) AS speed_class, count(*) AS n FROM v_ts WHERE ws IS NOT NULL GROUP BY 1, 2"))
def windrose_bins(spark, sf_dir):
    return T.wind_rose(v_ts(spark, sf_dir), 10.0, [2.0, 5.0, 20.0])


@query(twin("SELECT coalesce(CAST(station AS VARCHAR), 'All stations') AS station, count(*) AS n, round(avg(ws), 6) AS mean_ws FROM v_ts GROUP BY ROLLUP (station)"))
def rollup_panels(spark, sf_dir):
    return R.panels(v_ts(spark, sf_dir), "station", "All stations", n=F.count(F.lit(1)), mean_ws=F.avg("ws")).select("station", "n", r6("mean_ws").alias("mean_ws"))


@query(twin(
    "SELECT segment_id, round(avg(cos(radians(aspect - s.wd))), 6) AS summer, round(avg(cos(radians(aspect - w.wd))), 6) AS winter FROM (SELECT l_partkey AS segment_id, CAST(l_orderkey % 360 AS DOUBLE) AS aspect FROM lineitem), "
    f"(SELECT {_circ(9)} AS wd FROM o WHERE month(ts) BETWEEN 4 AND 9) s, (SELECT {_circ(9)} AS wd FROM o WHERE month(ts) NOT BETWEEN 4 AND 9) w GROUP BY segment_id", o=_ORDERS))  # fmt: skip
def windwardness(spark, sf_dir):
    means = _orders(spark, sf_dir).groupBy(circular.season(F.month("ts")).alias("season")).agg(F.round(circular.circular_mean("wd"), 9).alias("wd"))
    one = means.agg(*[F.max(F.when(F.col("season") == s, F.col("wd"))).alias(s.lower()) for s in ("Summer", "Winter")])
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("segment_id"), (F.col("l_orderkey") % 360).cast("double").alias("aspect")).crossJoin(F.broadcast(one))
    return cells.groupBy("segment_id").agg(*[r6(F.avg(circular.windwardness("aspect", s))).alias(s) for s in ("summer", "winter")])


@query(twin("SELECT c_custkey, round((cos(radians(a) - pi()) + 1) / 2, 6) + 0e0 AS southness FROM (SELECT c_custkey, CAST(c_custkey * 13 % 360 AS DOUBLE) AS a FROM customer)"))
def southness(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", (r6(circular.southness((F.col("c_custkey") * 13 % 360).cast("double"))) + 0.0).alias("southness"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, count(*) AS n_scenes, avg(round(o_totalprice * 100)) / 100 AS mean_cloud FROM orders GROUP BY 1, 2")
def agg_day_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n_scenes"), (F.avg(whole("o_totalprice")) / 100).alias("mean_cloud"))


@query("SELECT year, date, mean_cloud FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY mean_cloud, date) AS r FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, avg(round(o_totalprice * 100)) / 100 AS mean_cloud FROM orders GROUP BY 1, 2)) WHERE r = 1")
def best_day_per_period(spark, sf_dir):
    return R.top_n(agg_day_stats(spark, sf_dir), 1, ["year"], [F.col("mean_cloud"), F.col("date")]).select("year", "date", "mean_cloud")


@query("SELECT l_suppkey AS cell, date_trunc('month', l_shipdate) AS month, round(quantile_cont(l_extendedprice, 0.5), 6) AS value FROM lineitem GROUP BY 1, 2")
def monthly_median(spark, sf_dir):
    cube = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month"), "l_extendedprice")
    return cube.groupBy("cell", "month").agg(r6(F.percentile("l_extendedprice", F.lit(0.5))).alias("value"))


@query("SELECT l_suppkey AS cell, round(avg(CASE WHEN l_returnflag <> 'A' THEN l_discount - l_tax END), 6) AS mean FROM lineitem GROUP BY 1")
def time_mean_index(spark, sf_dir):
    cube = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), mask_classes(F.col("l_discount") - F.col("l_tax"), "l_returnflag", ("A",)).alias("v"))
    return cube.groupBy("cell").agg(r6(F.avg("v")).alias("mean"))


@query(twin("SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(avg(ws), 6) AS mean_ws FROM v_ts GROUP BY 1"))
def tumbling_hour_stats(spark, sf_dir):
    return T.tumbling(v_ts(spark, sf_dir), "ts", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", r6("mean_ws").alias("mean_ws"))


@query(twin("SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS start, count(*) AS n, round(avg(ws), 6) AS mean_ws FROM v_ts, (VALUES (0), (1), (2)) s(k) GROUP BY 1"))
def sliding_window_stats(spark, sf_dir):
    return T.sliding(v_ts(spark, sf_dir), "ts", "3 hours", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", r6("mean_ws").alias("mean_ws"))


@query(twin(
    'SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", station, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY ts) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY station ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM v_ts)) GROUP BY station, g'
))
def session_windows(spark, sf_dir):
    return T.sessions(v_ts(spark, sf_dir), "ts", "station", "2 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "station", "n")


@query(twin("SELECT station, ts, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS ws, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS copies FROM (SELECT user_id AS station, * FROM events)"))
def dedup_overlap(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", "event_id", "value")
    old = e.select("station", "ts", F.col("value").alias("ws"), F.lit(0).alias("priority"))
    recent = e.filter("event_id % 3 = 0").select("station", "ts", (F.col("value") + 1).alias("ws"), F.lit(1).alias("priority"))
    return T.dedup_overlap(old.union(recent), ["station", "ts"], "priority", "ws").withColumn("copies", F.col("copies").cast("int"))


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean_ws FROM events GROUP BY 1")
def hourly_stream(spark, sf_dir):
    """The tumbling summary over a stream of the same files, driven to its end."""
    from stratiq import streaming
    from stratiq.sources.scratch import removed_at_end, scratch_path

    path = scratch_path(spark, "hourly")
    removed_at_end(spark, path)
    hours = streaming.run_once(streaming.hourly(streaming.event_stream(spark, sf_dir)), ["start"], path)
    return hours.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", r6("mean_ws").alias("mean_ws"))
