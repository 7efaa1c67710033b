"""Areas with holes and several parts: joins, clipping, repair, coverage of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiq.functions.numeric import r6
from stratiq.operators import areas as A, overlay, polygons as P, relational as R

from .registry import query
from .views import twin, v_grid, v_pt, v_rect, whole

#: U-shaped features over every place, three widths wide, with a notch from above; every eleventh lies far away.
_W = "(120 + 40 * (id % 5))"
_U = f"SELECT id, x + 0.5e0 + CASE WHEN id % 11 = 0 THEN 20000 ELSE 0 END AS x, y + 0.5e0 AS y, {_W} AS w FROM v_pt"
_BOXES = "SELECT id, x AS a, y + w AS b, x + w AS c, y + 3 * w AS d FROM u UNION ALL SELECT id, x + 2 * w, y + w, x + 3 * w, y + 3 * w FROM u UNION ALL SELECT id, x, y, x + 3 * w, y + w FROM u"
#: Square frames: rectangles with a square hole.
_FRAMES = "SELECT rect_id, x0, y0, x1, y1, x0 + 500 AS h0, y0 + 500 AS k0, x1 - 500 AS h1, y1 - 500 AS k1 FROM v_rect"
_MEET = "least(c, x1) >= greatest(a, x0) AND least(d, y1) >= greatest(b, y0) AND NOT (greatest(a, x0) > h0 AND least(c, x1) < h1 AND greatest(b, y0) > k0 AND least(d, y1) < k1)"
_BOTH = "greatest(least(c, x1) - greatest(a, x0), 0) * greatest(least(d, y1) - greatest(b, y0), 0) - greatest(least(c, h1) - greatest(a, h0), 0) * greatest(least(d, k1) - greatest(b, k0), 0)"
_CELLS = (
    "SELECT id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, a, b, c, d FROM (SELECT *, unnest(range(CAST(floor(b / 100) AS BIGINT), CAST(floor(d / 100) AS BIGINT) + 1)) AS row FROM "
    "(SELECT *, unnest(range(CAST(floor(a / 100) AS BIGINT), CAST(floor(c / 100) AS BIGINT) + 1)) AS col FROM boxes))"
)
_SHARE = "sum((least(c, (col + 1) * 100) - greatest(a, col * 100)) * (least(d, (row + 1) * 100) - greatest(b, row * 100)))"
_WINDOW = {"x0": 1500, "y0": 900, "x1": 6200, "y1": 7300, "h0": 3000, "k0": 2000, "h1": 5000, "k1": 6000}


def _shapes(spark, sf_dir):
    x, y, w = F.col("x") + 0.5 + F.when(F.col("id") % 11 == 0, 20000).otherwise(0), F.col("y") + 0.5, 120 + 40 * (F.col("id") % 5)
    corners = [(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)]
    return v_pt(spark, sf_dir).select("id", w.alias("w"), A.area_of(F.array(*[P.point(x + i * w, y + j * w) for i, j in corners])).alias("shape"))


def _frame(x0, y0, x1, y1, h0, k0, h1, k1):
    return A.area_of(P.box(x0, y0, x1, y1), P.box(h0, k0, h1, k1))


def _frames(spark, sf_dir):
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return v_rect(spark, sf_dir).select("rect_id", _frame(x0, y0, x1, y1, x0 + 500, y0 + 500, x1 - 500, y1 - 500).alias("frame"))


def _window():
    return _frame(*[F.lit(v) for v in _WINDOW.values()])


@query(twin("SELECT u.id, m.rect_id FROM u LEFT JOIN m ON u.id = m.id", u=_U, boxes=_BOXES, frames=_FRAMES, m=f"SELECT DISTINCT id, rect_id FROM boxes JOIN frames ON {_MEET}"))
def areas_intersect_left(spark, sf_dir):
    """Features with every frame that they meet; those that meet none are kept."""
    out = A.join_areas_left(_shapes(spark, sf_dir), _frames(spark, sf_dir), "id", "shape", "frame", 1000.0)
    return out.select("id", "rect_id")


@query(twin(f"SELECT DISTINCT id FROM boxes, (SELECT {', '.join(f'{v} AS {k}' for k, v in _WINDOW.items())}) WHERE {_MEET}", u=_U, boxes=_BOXES))
def areas_intersect_filter(spark, sf_dir):
    """Features that meet one area with a hole."""
    return A.filter_areas(_shapes(spark, sf_dir), "shape", _window()).select("id")


@query(twin("SELECT p.id, f.rect_id FROM v_pt p JOIN frames f ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND NOT (x >= h0 AND x < h1 AND y >= k0 AND y < k1)", frames=_FRAMES))
def points_in_frames(spark, sf_dir):
    """Points in areas with holes: a point in a hole is outside."""
    return A.points_in_areas(v_pt(spark, sf_dir), _frames(spark, sf_dir), "frame", 1000.0).select("id", "rect_id")


@query(twin(
    "SELECT id, rect_id FROM u, frames WHERE x >= x0 AND x + 3 * w < x1 AND y >= y0 AND y + 3 * w < y1 AND NOT EXISTS (SELECT 1 FROM over WHERE over.id = u.id AND over.rect_id = frames.rect_id)",
    u=_U, boxes=_BOXES, frames=_FRAMES, over="SELECT id, rect_id FROM boxes JOIN frames ON least(c, h1) > greatest(a, h0) AND least(d, k1) > greatest(b, k0)"))
def areas_within(spark, sf_dir):
    """Features that lie wholly within a frame, none of them over its hole."""
    return A.join_areas(_shapes(spark, sf_dir), _frames(spark, sf_dir), "shape", "frame", 1000.0, A.within).select("id", "rect_id")


@query(twin(f"SELECT id, rect_id, sum({_BOTH}) AS area FROM boxes, frames WHERE {_MEET} GROUP BY id, rect_id HAVING sum({_BOTH}) > 0", u=_U, boxes=_BOXES, frames=_FRAMES))
def areas_clip(spark, sf_dir):
    """What each feature has in common with each frame that it meets: concave by concave, with a hole."""
    pairs = A.join_areas(_shapes(spark, sf_dir), _frames(spark, sf_dir), "shape", "frame", 1000.0)
    out = pairs.select("id", "rect_id", overlay.intersection(F.col("shape"), F.col("frame")).alias("part"))
    return out.select("id", "rect_id", A.measure(F.col("part")).alias("area")).filter("area > 0")


@query(twin("SELECT rect_id, (x1 - x0) * (y1 - y0) * 1e0 - (h1 - h0) * (k1 - k0) AS area, (x0 + x1) / 2e0 AS x, (y0 + y1) / 2e0 AS y, 2e0 * (x1 - x0 + y1 - y0 + h1 - h0 + k1 - k0) AS perimeter FROM frames", frames=_FRAMES))
def areas_measure(spark, sf_dir):
    """Area, centre and outline of frames."""
    f = F.col("frame")
    return _frames(spark, sf_dir).select("rect_id", A.measure(f).alias("area"), A.centroid(f).alias("c"), A.perimeter(f).alias("perimeter")).select("rect_id", "area", r6("c.x").alias("x"), r6("c.y").alias("y"), "perimeter")


@query(twin(f"SELECT id, 2 AS rings, {_W} * {_W} / 2e0 AS area FROM v_pt"))
def areas_repair(spark, sf_dir):
    """Bow-ties over every place: each becomes two triangles, half of its square in all."""
    x, y, w = F.col("x"), F.col("y"), 120 + 40 * (F.col("id") % 5)
    bow = F.array(P.point(x, y), P.point(x + w, y + w), P.point(x + w, y), P.point(x, y + w))
    out = R.spread(v_pt(spark, sf_dir), 5_000).select("id", overlay.made_valid(A.area_of(bow)).alias("area"))
    return out.select("id", F.size("area").alias("rings"), A.measure(F.col("area")).alias("area"))


@query(twin(f"SELECT id, row, col, round({_SHARE} / 10000, 6) AS fraction FROM cells GROUP BY id, row, col HAVING {_SHARE} > 0", u=_U, boxes=_BOXES, cells=_CELLS))
def coverage_fractions(spark, sf_dir):
    """The exact share of each cell that each feature covers."""
    return A.coverage(_shapes(spark, sf_dir), "id", "shape", 100.0).select("id", "row", "col", r6("fraction").alias("fraction"))


@query(twin("SELECT DISTINCT id, row, col FROM cells", u=_U, boxes=_BOXES, cells=_CELLS))
def touched_cells(spark, sf_dir):
    """All cells that a feature covers or its outline meets."""
    return A.rasterise(_shapes(spark, sf_dir), "id", "shape", 100.0, touches=True)


@query(twin(
    "SELECT f.rect_id, CAST(floor(y / 100) AS BIGINT) AS row, CAST(floor(x / 100) AS BIGINT) AS col FROM frames f JOIN (SELECT c * 100 + 50e0 AS x, r * 100 + 50e0 AS y FROM range(0, 100) a(c), range(0, 100) b(r)) ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND NOT (x >= h0 AND x < h1 AND y >= k0 AND y < k1)", frames=_FRAMES))
def rasterize_frames(spark, sf_dir):
    """Cells whose middle an area with a hole holds."""
    return A.rasterise(_frames(spark, sf_dir), "rect_id", "frame", 100.0)


@query(twin(
    f"SELECT id, count(*) AS cells, sum(s * v) / sum(s) / 100 AS mean, sum(s) / 10000 AS area FROM (SELECT id, row, col, round({_SHARE}) AS s FROM cells GROUP BY id, row, col) JOIN (SELECT row, col, round(z * 100) AS v FROM v_grid) USING (row, col) GROUP BY id HAVING sum(s) > 0",
    u=_U, boxes=_BOXES, cells=_CELLS))
def zonal_coverage(spark, sf_dir):
    """Weighted zonal means of the grid from features alone: weights are the shares of cells, in whole ten-thousandths."""
    rows = A.covered_values(_shapes(spark, sf_dir), "id", "shape", v_grid(spark, sf_dir).select("row", "col", whole("z").alias("v")), 100.0)
    s = F.round(F.col("fraction") * 10_000)
    out = rows.groupBy("id").agg(F.count(F.lit(1)).alias("cells"), F.sum(s * F.col("v")).alias("t"), F.sum(s).alias("s")).filter("s > 0")
    return out.select("id", "cells", (F.col("t") / F.col("s") / 100).alias("mean"), (F.col("s") / 10_000).alias("area"))
