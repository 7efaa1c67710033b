"""Geometry: spatial filters and joins, distances, areas, thinning."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiq.functions.numeric import r6
from stratiq.operators import geometry as G

from .registry import query
from .views import twin, v_grid, v_pt, v_rect

RING = ((1000.0, 1000.0), (7000.0, 2000.0), (8000.0, 7000.0), (3000.0, 9000.0))
_INSIDE = " + ".join(
    f"CASE WHEN (({y1}e0 > y) <> ({y2}e0 > y)) AND x < (y - {y1}e0) * ({x2 - x1}e0) / ({y2 - y1}e0) + {x1}e0 THEN 1 ELSE 0 END"
    for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]], strict=True)
)


@query(twin(f"SELECT id, x, y FROM v_pt WHERE ({_INSIDE}) % 2 = 1"))
def spatial_within_filter(spark, sf_dir):
    return G.within_filter(v_pt(spark, sf_dir), RING).select("id", "x", "y")


@query(twin("SELECT id, rect_id FROM v_pt JOIN v_rect ON x >= x0 AND x < x1 AND y >= y0 AND y < y1"))
def spatial_join_within(spark, sf_dir):
    return G.join_rectangles(v_pt(spark, sf_dir), v_rect(spark, sf_dir), 2000.0).select("id", "rect_id")


@query(twin("SELECT id, rect_id FROM v_pt LEFT JOIN (SELECT * FROM v_rect WHERE rect_id % 2 = 0) ON x >= x0 AND x < x1 AND y >= y0 AND y < y1"))
def spatial_join_left(spark, sf_dir):
    return G.join_rectangles(v_pt(spark, sf_dir), v_rect(spark, sf_dir).filter("rect_id % 2 = 0"), 2000.0, "left").select("id", "rect_id")


_NEAR = "SELECT a.id AS a, b.id AS b, sqrt(CAST((a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS DOUBLE)) AS d FROM v_pt a JOIN v_pt b ON a.id < b.id AND b.x BETWEEN a.x - 300 AND a.x + 300 AND b.y BETWEEN a.y - 300 AND a.y + 300"


@query(twin("SELECT a, b, round(d, 6) AS distance FROM n WHERE d <= 300", n=_NEAR))
def distance_self_join(spark, sf_dir):
    return G.within_distance(v_pt(spark, sf_dir), "id", 300.0, shown=r6).select("a", "b", "distance")


@query(twin("SELECT rect_id, round((x1 - x0) * (y1 - y0) * 0.75e0, 6) AS area FROM v_rect"))
def polygon_area(spark, sf_dir):
    """Rectangles with two opposite corners cut off through the middles of their sides: an eighth each."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(mx, y0), p(x1, y0), p(x1, my), p(mx, y1), p(x0, y1), p(x0, my))
    return v_rect(spark, sf_dir).select("rect_id", r6(G.ring_area(ring)).alias("area"))


@query(twin("SELECT lab, cls, round(avg(col), 6) AS cx, round(avg(row), 6) AS cy, count(*) AS cells FROM v_grid GROUP BY lab, cls"))
def segment_centroid(spark, sf_dir):
    g = v_grid(spark, sf_dir).withColumn("seg", F.struct("lab", "cls"))
    return G.cell_centroids(g, "seg", "col", "row").select("seg.lab", "seg.cls", r6("cx").alias("cx"), r6("cy").alias("cy"), "cells")


@query(twin(
    "SELECT cls, CAST(col AS DOUBLE) AS x, CAST(row AS DOUBLE) AS y FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round((col - cx) ** 2 + (row - cy) ** 2, 6), col, row) AS r FROM v_grid JOIN (SELECT cls, avg(col) AS cx, avg(row) AS cy FROM v_grid GROUP BY cls) USING (cls)) WHERE r = 1"
))
def point_on_surface(spark, sf_dir):
    return G.point_on_surface(v_grid(spark, sf_dir), "cls", "col", "row")


@query(twin("SELECT grp, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM v_pt GROUP BY grp"))
def bbox_by_group(spark, sf_dir):
    return G.boxes(v_pt(spark, sf_dir), "grp")


@query()
def greedy_thinning(spark, sf_dir):
    """Points kept in id order at 150 apart; a test holds them against the sequential rule."""
    return G.thin(v_pt(spark, sf_dir), "id", ["id"], 150.0).select("id", "x", "y")


@query(twin("SELECT id, round(min(d), 6) AS nearest FROM (SELECT a AS id, d FROM n WHERE d <= 300 UNION ALL SELECT b, d FROM n WHERE d <= 300) GROUP BY id", n=_NEAR))
def validation_spacing(spark, sf_dir):
    return G.nearest_gap(v_pt(spark, sf_dir), "id", 300.0).select("id", r6("nearest").alias("nearest"))


@query()
def hull_by_group(spark, sf_dir):
    """Convex hulls; a test checks that all points lie inside."""
    return G.convex_hulls(v_pt(spark, sf_dir), "grp", "x", "y")


@query(twin("SELECT id, round(radians(lon) * 6378137e0, 4) AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137e0, 4) + 0e0 AS my FROM (SELECT id, x / 1000e0 AS lon, y / 200e0 AS lat FROM v_pt)"))
def web_mercator(spark, sf_dir):
    mx, my = G.mercator(F.col("x") / 1000, F.col("y") / 200)
    return v_pt(spark, sf_dir).select("id", F.round(mx, 4).alias("mx"), (F.round(my, 4) + 0.0).alias("my"))
