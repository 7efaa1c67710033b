"""Polygons: joins with points, containment, clipping, outlines of labels, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiq.functions import projection
from stratiq.functions.numeric import r6
from stratiq.operators import polygons as P
from stratiq.sources import features

from .places import RING
from .registry import query
from .views import twin, v_grid, v_pt, v_rect

#: Rectangles with two opposite corners cut off: x and y of six corners over x0, y0, x1, y1.
_CORNERS = [("(x0 + x1) / 2e0", "y0"), ("x1", "y0"), ("x1", "(y0 + y1) / 2e0"), ("(x0 + x1) / 2e0", "y1"), ("x0", "y1"), ("x0", "(y0 + y1) / 2e0")]
_EDGES = " UNION ALL ".join(
    f"SELECT rect_id, CAST({ax} AS DOUBLE) AS ax, CAST({ay} AS DOUBLE) AS ay, CAST({bx} AS DOUBLE) AS bx, CAST({by} AS DOUBLE) AS by FROM v_rect" for (ax, ay), (bx, by) in zip(_CORNERS, [*_CORNERS[1:], _CORNERS[0]], strict=True)
)
_HIT = "((e.ay > p.y) <> (e.by > p.y)) AND p.x < (e.bx - e.ax) * (p.y - e.ay) / (e.by - e.ay) + e.ax"


def _shapes(spark, sf_dir):
    ring = F.array(*[P.point(F.expr(x.replace("e0", ".0")), F.expr(y.replace("e0", ".0"))) for x, y in _CORNERS])
    return v_rect(spark, sf_dir).select("rect_id", ring.alias("ring"))


def _boxes(spark, sf_dir):
    return v_rect(spark, sf_dir).withColumn("ring", P.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


@query(twin(f"SELECT p.id, e.rect_id FROM v_pt p JOIN e ON {_HIT} GROUP BY p.id, e.rect_id HAVING count(*) % 2 = 1", e=_EDGES))
def points_in_polygons(spark, sf_dir):
    return P.points_in_polygons(v_pt(spark, sf_dir), _shapes(spark, sf_dir), "ring", 1000.0).select("id", "rect_id")


@query(twin(
    f"SELECT CAST(p.y / 100 - 0.5e0 AS BIGINT) AS row, CAST(p.x / 100 - 0.5e0 AS BIGINT) AS col, e.rect_id FROM p JOIN e ON {_HIT} GROUP BY p.x, p.y, e.rect_id HAVING count(*) % 2 = 1", e=_EDGES,
    p="SELECT (x + 0.5e0) * 100 AS x, (y + 0.5e0) * 100 AS y FROM range(0, 100) a(x), range(0, 100) b(y)"))
def rasterize_polygons(spark, sf_dir):
    return P.rasterise(_shapes(spark, sf_dir), "ring", 100.0).select("row", "col", "rect_id")


_OUTER = " + ".join(
    f"CASE WHEN (({y1}e0 > y) <> ({y2}e0 > y)) AND x < (y - {y1}e0) * ({x2 - x1}e0) / ({y2 - y1}e0) + {x1}e0 THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]], strict=True)
)


@query(twin(f"SELECT rect_id FROM (SELECT rect_id, x0 AS x, y0 AS y FROM v_rect UNION ALL SELECT rect_id, x1, y0 FROM v_rect UNION ALL SELECT rect_id, x1, y1 FROM v_rect UNION ALL SELECT rect_id, x0, y1 FROM v_rect) WHERE ({_OUTER}) % 2 = 1 GROUP BY rect_id HAVING count(*) = 4"))
def polygons_within(spark, sf_dir):
    """Rectangles wholly within a convex polygon: there, those whose corners all are."""
    outer = F.array(*[P.point(F.lit(x), F.lit(y)) for x, y in RING])
    return _boxes(spark, sf_dir).filter(P.within(F.col("ring"), outer)).select("rect_id")


@query(twin("SELECT rect_id, greatest(least(x1, 6200) - greatest(x0, 1500), 0) * greatest(least(y1, 7300) - greatest(y0, 900), 0) * 1e0 AS area FROM v_rect"))
def polygon_clip(spark, sf_dir):
    """What a window leaves of each rectangle."""
    return _boxes(spark, sf_dir).select("rect_id", P.signed_area(P.clip(F.col("ring"), 1500.0, 900.0, 6200.0, 7300.0)).alias("area"))


@query(twin("SELECT rect_id, (x0 + x1) / 2e0 AS x, (y0 + y1) / 2e0 AS y FROM v_rect"))
def polygon_centroid(spark, sf_dir):
    """Of rectangles with two opposite corners cut off: the rectangle's middle, by symmetry."""
    return _shapes(spark, sf_dir).select("rect_id", P.centroid(F.col("ring")).alias("c")).select("rect_id", r6("c.x").alias("x"), r6("c.y").alias("y"))


@query(twin("SELECT rect_id, rect_id % 3 = 0 AS valid, rect_id % 3 = 2 AS empty, CASE WHEN rect_id % 3 <> 2 THEN (x1 - x0) * (y1 - y0) * 1e0 END AS area FROM v_rect"))
def polygon_validity(spark, sf_dir):
    """Every third ring has its edges crossed, every third is a line; those that can be are made valid."""
    c = F.col("ring")
    bent = F.when(F.col("rect_id") % 3 == 1, F.array(c[0], c[2], c[1], c[3])).when(F.col("rect_id") % 3 == 2, F.array(c[0], c[1], c[0])).otherwise(c)
    out = _boxes(spark, sf_dir).select("rect_id", bent.alias("ring"))
    return out.select("rect_id", P.is_valid(F.col("ring")).alias("valid"), P.is_empty(F.col("ring")).alias("empty"), F.abs(P.signed_area(P.made_valid(F.col("ring")))).alias("area"))


_BORDERS = "SELECT a.lab, count(*) AS cells, sum(4 - n)::BIGINT AS border FROM (SELECT a.row, a.col, a.lab, count(b.row) AS n FROM v_grid a LEFT JOIN (SELECT row + dr AS row, col + dc AS col, lab FROM v_grid, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dr, dc)) b ON a.row = b.row AND a.col = b.col AND a.lab = b.lab GROUP BY a.row, a.col, a.lab) a GROUP BY a.lab"


@query(twin(f"SELECT lab, cells * 1e0 AS area, border * 1e0 AS perimeter FROM ({_BORDERS})"))
def polygonise_labels(spark, sf_dir):
    """Outlines of the grid's labels, dissolved: areas less holes are the cells, lengths the sides towards other labels."""
    rings = P.collected(P.polygonise(v_grid(spark, sf_dir), "lab", 100))
    return rings.groupBy(F.col("label").alias("lab")).agg(F.sum(P.signed_area(F.col("points"))).alias("area"), F.sum(P.perimeter(F.col("points"))).alias("perimeter"))


_LON, _LAT = "(6 + x / 2000e0)", "(47 + y / 1300e0)"
_EN = projection.forward(_LON, _LAT, "32")


@query(twin(f"SELECT id, round({_EN[0]}, 4) AS east, round({_EN[1]}, 4) AS north FROM v_pt"))
def transverse_mercator(spark, sf_dir):
    """Zone 32: a test holds the series against known lengths and its inverse."""
    east, north = (F.expr(x.replace("e0", ".0D")) for x in projection.forward(_LON, _LAT, "32"))
    return v_pt(spark, sf_dir).select("id", F.round(east, 4).alias("east"), F.round(north, 4).alias("north"))


@query()
def bbox_buffer(spark, sf_dir):
    """Boxes of groups of places in degrees, widened by 500 metres in zone 32 and taken back to degrees."""
    at = v_pt(spark, sf_dir).groupBy("grp").agg(*[f(k).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c, k in (("x", F.expr("6 + x / 2000.0D")), ("y", F.expr("47 + y / 1300.0D")))])
    for n, sign in (("lo", "-"), ("hi", "+")):
        east, north = projection.forward(f"{n}_x", f"{n}_y", "32")
        at = at.withColumn("_e", F.expr(f"{east} {sign} 500")).withColumn("_n", F.expr(f"{north} {sign} 500"))
        lon, lat = projection.backward("_e", "_n", "32")
        at = at.withColumn(f"{n}_lon", F.expr(lon)).withColumn(f"{n}_lat", F.expr(lat)).drop("_e", "_n")
    return at.drop("lo_x", "lo_y", "hi_x", "hi_y")


@query(twin("SELECT rect_id, 'polygon' AS kind, (x1 - x0) * (y1 - y0) * 0.75e0 AS area FROM v_rect"))
def features_binary(spark, sf_dir):
    """Polygons written as well-known binary and read again: the same rings."""
    stored = _shapes(spark, sf_dir).select("rect_id", features.to_wkb(F.array("ring")).alias("geometry"))
    return features.read_features(stored).select("rect_id", "kind", P.signed_area(F.col("ring")).alias("area"))


_WIDE = "greatest(least(x1, 6200) - greatest(x0, 1500), 0)"
_HIGH = "greatest(least(y1, 7300) - greatest(y0, 900), 0)"
_WALK = f"CASE WHEN y0 BETWEEN 900 AND 7300 THEN {_WIDE} ELSE 0 END + CASE WHEN x1 BETWEEN 1500 AND 6200 THEN {_HIGH} ELSE 0 END"


@query(twin(
    "SELECT id, 'place' AS key, grp AS value, 'point' AS kind, 0e0 AS measure FROM v_pt WHERE x BETWEEN 1500 AND 6200 AND y BETWEEN 900 AND 7300 "
    f"UNION ALL SELECT rect_id, 'landuse', 'r' || rect_id, 'polygon', {_WIDE} * {_HIGH} * 1e0 FROM v_rect WHERE {_WIDE} * {_HIGH} > 0 "
    f"UNION ALL SELECT rect_id, 'highway', 'r' || rect_id, 'line', ({_WALK}) * 1e0 FROM v_rect WHERE {_WALK} > 0"))  # fmt: skip
def features_by_key(spark, sf_dir):
    """Points, polygons and lines of three keys clipped to a window, with areas and lengths."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    tag = lambda k, v: F.create_map(F.lit(k), v, F.lit("name"), F.lit("-"))
    row = lambda k, kind, tags, ring: [F.col(k).alias("id"), tags.alias("tags"), F.lit(kind).alias("kind"), ring.alias("ring")]
    name = F.concat(F.lit("r"), F.col("rect_id").cast("string"))
    rects = v_rect(spark, sf_dir)
    found = v_pt(spark, sf_dir).select(*row("id", "point", tag("place", F.col("grp")), F.array(P.point(F.col("x"), F.col("y")))))
    found = found.unionByName(rects.select(*row("rect_id", "polygon", tag("landuse", name), P.box(x0, y0, x1, y1))))
    found = found.unionByName(rects.select(*row("rect_id", "line", tag("highway", name), F.array(P.point(x0, y0), P.point(x1, y0), P.point(x1, y1)))))
    out = features.features_by_key(found, ("place", "landuse", "highway"), (1500.0, 900.0, 6200.0, 7300.0))
    measure = F.when(F.col("kind") == "polygon", P.signed_area(F.col("ring"))).when(F.col("kind") == "line", P.length(F.col("segments"))).otherwise(0.0)
    return out.withColumn("measure", measure).filter("kind = 'point' or measure > 0").select("id", "key", "value", "kind", "measure")
