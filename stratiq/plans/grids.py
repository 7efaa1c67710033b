"""Raster operators on the order grid."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from stratiq.functions import leaf_area, projection, spectral
from stratiq.functions.numeric import r6
from stratiq.operators import geometry as G, hydrology, raster, relational as R, stats
from stratiq.operators.reproject import Lattice, reproject
from stratiq.sources.scratch import saved

from .registry import query
from .views import table, twin, v_cell, v_grid, whole

WIDTH = 100


@query(twin("SELECT CAST(floor(row / 5e0) AS BIGINT) AS block_row, CAST(floor(col / 5e0) AS BIGINT) AS block_col, round(avg(z), 6) AS mean, round(quantile_cont(z, 0.95), 6) AS p95, round(stddev_samp(z), 4) AS sd, round(avg(CASE WHEN z > 200000 THEN 1e0 ELSE 0e0 END), 6) AS fraction, max(z) AS max FROM v_grid GROUP BY 1, 2"))
def block_aggregate(spark, sf_dir):
    out = raster.block_aggregate(v_grid(spark, sf_dir), 5, "z", 200000.0)
    return out.select("block_row", "block_col", r6("mean").alias("mean"), r6("p95").alias("p95"), F.round("sd", 4).alias("sd"), r6("fraction").alias("fraction"), "max")


@query(twin("SELECT row, col, z FROM v_grid WHERE row % 4 = 0 AND col % 4 = 0"))
def grid_downsample(spark, sf_dir):
    return raster.downsample(v_grid(spark, sf_dir), 4).select("row", "col", "z")


@query(twin("SELECT a.row, a.col, round(greatest(a.z - b.z, 0e0), 6) AS height FROM v_grid a JOIN (SELECT row, col - 1 AS col, z FROM v_grid) b ON a.row = b.row AND a.col = b.col"))
def clamp_difference(spark, sf_dir):
    g = v_grid(spark, sf_dir)
    return raster.height_above(g, g.select("row", (F.col("col") - 1).alias("col"), "z"), "z").select("row", "col", r6("height").alias("height"))


_CENTS = "SELECT row, col, round(z * 100) AS v FROM v_grid"


def _cents(spark, sf_dir):
    return v_grid(spark, sf_dir).select("row", "col", whole("z").alias("v"))


@query(twin("SELECT a.row, a.col, (min(a.v) - avg(b.v)) / 100 AS deviation FROM g a JOIN (SELECT row + dr AS row, col + dc AS col, v FROM g, (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc)) b ON a.row = b.row AND a.col = b.col GROUP BY a.row, a.col", g=_CENTS))
def focal_mean_deviation(spark, sf_dir):
    return raster.focal_deviation(_cents(spark, sf_dir), "v", 1).select("row", "col", (F.col("deviation") / 100).alias("deviation"))


_RADII = (3, 5, 10)
_FOCAL = (
    "SELECT row, col, v, " + ", ".join(f"sum(s{r}) OVER (PARTITION BY col ORDER BY row RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) / sum(n{r}) OVER (PARTITION BY col ORDER BY row RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS m{r}" for r in _RADII)
    + " FROM (SELECT row, col, v, " + ", ".join(f"sum(v) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS s{r}, count(v) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS n{r}" for r in _RADII) + " FROM d)"
)


@query(twin(
    "SELECT row, col, " + ", ".join(f"(v - m{r}) / 100 AS position_{10 * r}" for r in _RADII) + " FROM f WHERE v IS NOT NULL",
    g=_CENTS, d="SELECT r.row, c.col, g.v FROM (SELECT DISTINCT row FROM g) r CROSS JOIN (SELECT DISTINCT col FROM g) c LEFT JOIN g ON g.row = r.row AND g.col = c.col", f=_FOCAL))
def topographic_position(spark, sf_dir):
    """At radii of 30, 50 and 100 metres on cells of 10."""
    grid = _cents(spark, sf_dir)
    out = grid
    for r in _RADII:
        near = raster.focal_deviation(grid, "v", r).select("row", "col", (F.col("deviation") / 100).alias(f"position_{10 * r}"))
        out = out.join(near, ["row", "col"])
    return out.drop("v")


_NINE = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "c": (0, 0), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}
_CURVED = {
    "general": "-(r + t)", "profile": "-(p * p * r + 2 * p * q * s + q * q * t) / ((p * p + q * q) * (1 + p * p + q * q) ** 1.5)", "plan": "-(q * q * r - 2 * p * q * s + p * p * t) / (p * p + q * q) ** 1.5",
    "tangential": "-(q * q * r - 2 * p * q * s + p * p * t) / ((p * p + q * q) * sqrt(1 + p * p + q * q))", "longitudinal": "-(p * p * r + 2 * p * q * s + q * q * t) / (p * p + q * q)", "cross": "-(q * q * r - 2 * p * q * s + p * p * t) / (p * p + q * q)",
    "minimal": "-(r + t) / 2 - sqrt(((r - t) / 2) ** 2 + s * s)", "maximal": "-(r + t) / 2 + sqrt(((r - t) / 2) ** 2 + s * s)", "total": "r * r + 2 * s * s + t * t", "rotor": "((p * p - q * q) * s - p * q * (r - t)) / (p * p + q * q) ** 1.5",
}


@query(twin(
    "SELECT row, col, " + ", ".join(f'round({sql}, 8) + 0e0 AS "{name}"' for name, sql in _CURVED.items()) + " FROM f",
    h="SELECT row, col, z / 1000 AS z FROM v_grid",
    n="SELECT row - dr AS row, col - dc AS col, " + ", ".join(f"max(CASE WHEN dr = {i} AND dc = {j} THEN z END) AS {k}" for k, (i, j) in _NINE.items()) + " FROM h, (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc) GROUP BY 1, 2 HAVING count(*) = 9",
    f="SELECT row, col, (e - w) / 20 AS p, (n - s) / 20 AS q, (e - 2 * c + w) / 100 AS r, (n - 2 * c + s) / 100 AS t, (ne - nw - se + sw) / 400 AS s FROM n"))
def terrain_curvatures(spark, sf_dir):
    heights = v_grid(spark, sf_dir).select("row", "col", (F.col("z") / 1000).alias("z"))
    out = raster.curvatures(heights, "z", 10.0)
    return out.select("row", "col", *[(F.round(c, 8) + 0.0).alias(c) for c in _CURVED])


@query(twin(
    "SELECT c.row, c.col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope, round(CASE WHEN degrees(atan2(-dx, -dy)) < 0 THEN degrees(atan2(-dx, -dy)) + 360 ELSE degrees(atan2(-dx, -dy)) END, 6) + 0e0 AS aspect FROM "
    "(SELECT c.row, c.col, (e.z - w.z) / 20e0 AS dx, (n.z - s.z) / 20e0 AS dy FROM v_grid c JOIN v_grid e ON e.row = c.row AND e.col = c.col + 1 JOIN v_grid w ON w.row = c.row AND w.col = c.col - 1 JOIN v_grid n ON n.row = c.row - 1 AND n.col = c.col JOIN v_grid s ON s.row = c.row + 1 AND s.col = c.col) c"
))
def terrain_slope_aspect(spark, sf_dir):
    out = raster.slope_aspect(v_grid(spark, sf_dir), "z", 10.0)
    return out.select("row", "col", r6("slope").alias("slope"), (r6("aspect") + 0.0).alias("aspect"))


@query(twin("SELECT lab, count(*) AS n FROM v_grid GROUP BY lab"))
def label_freq(spark, sf_dir):
    return raster.label_sizes(v_grid(spark, sf_dir), "lab")


_LABEL = "user_id * 100 + CAST(day(ts) AS BIGINT)"
_SIZES = f"SELECT {_LABEL} AS label, count(*) AS n FROM events GROUP BY 1"


def _labelled(spark, sf_dir):
    """Events labelled by user and day."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("label"))


def _sizes(spark, sf_dir):
    return raster.label_sizes(_labelled(spark, sf_dir), "label")


@query(twin("SELECT count(*) AS labels, " + ", ".join(f"round(quantile_cont(n, {p}), 6) AS q{round(100 * p):03d}" for p in (0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1)) + ", " + ", ".join(f"round(avg(CASE WHEN n < {t} THEN 1e0 ELSE 0e0 END), 6) AS under_{t}" for t in (2, 5, 10, 20)) + " FROM s", s=_SIZES))
def label_size_stats(spark, sf_dir):
    out = raster.size_stats(_sizes(spark, sf_dir))
    return out.select("labels", *[r6(c).alias(c) for c in out.columns if c != "labels"])


@query(twin(f"SELECT event_id, CASE WHEN n >= 3 THEN label END AS label FROM (SELECT event_id, {_LABEL} AS label FROM events) JOIN s USING (label)", s=_SIZES))
def mask_small_labels(spark, sf_dir):
    return raster.mask_small(_labelled(spark, sf_dir), "label", 3).select("event_id", "label")


@query(twin("SELECT row, col, min(z) AS z_min, max(z) AS z_max FROM (SELECT row, col, z FROM v_grid WHERE col < 60 UNION ALL SELECT row, col, z + 5 FROM v_grid WHERE col >= 40) GROUP BY row, col"))
def mosaic_min_max(spark, sf_dir):
    g = v_grid(spark, sf_dir).select("row", "col", "z")
    return raster.mosaic([g.filter("col < 60"), g.filter("col >= 40").withColumn("z", F.col("z") + 5)], "z")


@query(twin("SELECT CAST(floor(row / 25e0) * 4 + floor(col / 25e0) AS BIGINT) AS tile, count(*) AS cells, round(avg(z), 6) AS mean, round(avg(CASE WHEN cls = '1-URGENT' THEN 1e0 ELSE 0e0 END), 6) AS share FROM v_grid GROUP BY 1"))
def tile_grid_features(spark, sf_dir):
    tiles = G.tile_ids(v_grid(spark, sf_dir), "col", "row", 25.0, 4)
    return tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("cells"), r6(F.avg("z")).alias("mean"), r6(F.avg(F.when(F.col("cls") == "1-URGENT", 1.0).otherwise(0.0))).alias("share"))


@query(twin("SELECT p.id, g.z, g.cls FROM (SELECT id, CAST(floor(x / 100e0) AS BIGINT) AS col, CAST(floor(y / 1000e0) AS BIGINT) AS row FROM v_pt) p JOIN v_grid g ON p.row = g.row AND p.col = g.col"))
def point_extract(spark, sf_dir):
    from .views import v_pt

    p = v_pt(spark, sf_dir).select("id", F.floor(F.col("x") / 100).alias("col"), F.floor(F.col("y") / 1000).alias("row"))
    return p.join(v_grid(spark, sf_dir), ["row", "col"]).select("id", "z", "cls")


@query()
def connected_components(spark, sf_dir):
    """Patches of equal label over the whole grid, whose background (O) is not labelled; a test holds them against union-find."""
    g = v_grid(spark, sf_dir)
    labelled = raster.patches(g.filter("lab <> 'O'"), "lab", WIDTH).select((F.col("row") * WIDTH + F.col("col")).alias("id"), "component")
    rest = g.filter("lab = 'O'").select((F.col("row") * WIDTH + F.col("col")).alias("id")).withColumn("component", F.col("id"))
    return labelled.union(rest)


@query(twin("SELECT lab, count(*) AS cells, CAST(sum(CASE WHEN n >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS joined FROM (SELECT a.row, a.col, a.lab, count(b.row) AS n FROM v_grid a LEFT JOIN (SELECT row + dr AS row, col + dc AS col, lab FROM v_grid, (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc) WHERE dr <> 0 OR dc <> 0) b ON a.row = b.row AND a.col = b.col AND a.lab = b.lab GROUP BY a.row, a.col, a.lab) GROUP BY lab"))
def patch_cells_joined(spark, sf_dir):
    """Of each label its cells, and those in a patch of more than one cell, by the patches of the whole grid."""
    found = raster.patches(v_grid(spark, sf_dir), "lab", WIDTH)
    sizes = found.groupBy("lab", "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("lab").agg(F.sum("n").alias("cells"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("joined"))


_NIR = "CAST(l_quantity / 50e0 AS DOUBLE) AS nir, l_tax * 5 AS red, l_discount * 3 AS blue"


@query(
    f"SELECT l_orderkey, l_linenumber, round((nir - red) / nullif(nir + red, 0), 6) + 0e0 AS ndvi, round(tanh(((nir - red) / nullif(nir + red, 0)) ** 2), 6) + 0e0 AS kndvi, round((nir - red) * 1.5e0 / nullif(nir + red + 0.5e0, 0), 6) + 0e0 AS savi, round(2.5e0 * (nir - red) / nullif(nir + 6e0 * red - 7.5e0 * blue + 1e0, 0), 4) + 0e0 AS evi FROM (SELECT l_orderkey, l_linenumber, {_NIR} FROM lineitem)"
)
def veg_indices(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("nir"), (F.col("l_tax") * 5).alias("red"), (F.col("l_discount") * 3).alias("blue"))
    return b.select("l_orderkey", "l_linenumber", (r6(spectral.ndvi("nir", "red")) + 0.0).alias("ndvi"), (r6(spectral.kndvi("nir", "red")) + 0.0).alias("kndvi"), (r6(spectral.savi("nir", "red")) + 0.0).alias("savi"), (F.round(spectral.evi("nir", "red", "blue"), 4) + 0.0).alias("evi"))


_BANDS = [f"(p_partkey * {k} % 97) / 250e0" for k in (3, 5, 7, 11, 13, 17, 19, 23)]
_ANGLES = [f"cos(radians(CAST(p_partkey * {k} % {m} AS DOUBLE)))" for k, m in ((3, 12), (5, 60), (7, 180))]


@query(f"SELECT p_partkey, round({leaf_area.sql([*_BANDS, *_ANGLES[:2]], _ANGLES[2])}, 5) AS lai FROM part")
def lai_network(spark, sf_dir):
    k = F.col("p_partkey")
    bands = [(k * m % 97) / 250 for m in (3, 5, 7, 11, 13, 17, 19, 23)]
    lai = leaf_area.leaf_area(bands, k * 3 % 12, k * 5 % 60, k * 7 % 180)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(lai, 5).alias("lai"))


_FLOW = "SELECT k AS src, k * 3 % 7 + k // 2 AS dst FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey >= 14)"


def _network(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter("c_custkey >= 14").select(k.alias("src"), (k * 3 % 7 + F.floor(k / 2)).alias("dst"))


@query()
def strahler_order(spark, sf_dir):
    """Stream orders of a made network; a test holds them against a recursive definition."""
    return hydrology.strahler(_network(spark, sf_dir)).select("id", "strahler")


@query(twin("SELECT id, count(*) AS accumulation FROM r GROUP BY id", recursive=True, f=_FLOW, n="SELECT src AS id FROM f UNION SELECT dst FROM f", r="SELECT id, id AS origin FROM n UNION ALL SELECT f.dst, r.origin FROM r JOIN f ON r.id = f.src"))
def flow_accumulation(spark, sf_dir):
    e = _network(spark, sf_dir)
    return hydrology.flow_accumulation(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), e)


_DRAINS = dict(f=_FLOW, n="SELECT src AS id FROM f UNION SELECT dst FROM f", r="SELECT id, id AS origin FROM n UNION ALL SELECT f.dst, r.origin FROM r JOIN f ON r.id = f.src")


@query(twin("SELECT origin AS id, id AS basin FROM r WHERE id NOT IN (SELECT src FROM f)", recursive=True, **_DRAINS))
def drainage_basins(spark, sf_dir):
    return hydrology.basins(_network(spark, sf_dir))


@query(twin("SELECT src, dst FROM f WHERE src IN (SELECT id FROM r GROUP BY id HAVING count(*) >= 5)", recursive=True, **_DRAINS))
def channel_network(spark, sf_dir):
    """Edges from cells that five or more drain through."""
    e = _network(spark, sf_dir)
    cells = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return hydrology.channels(e, hydrology.flow_accumulation(cells, e), 5).select("src", "dst")


@query(twin("SELECT id, CAST(min(steps) AS INTEGER) AS steps FROM r GROUP BY id", recursive=True, f=_FLOW, r="SELECT DISTINCT dst AS id, 0 AS steps FROM f WHERE dst NOT IN (SELECT src FROM f) UNION ALL SELECT f.src, r.steps + 1 FROM r JOIN f ON r.id = f.dst"))
def overland_steps(spark, sf_dir):
    e = _network(spark, sf_dir)
    return hydrology.steps_downstream(e, hydrology.outlets(e))


@query(twin(
    "SELECT row * 100 + col AS src, dst FROM (SELECT a.row, a.col, a.z, b.id AS dst, b.z AS low, row_number() OVER (PARTITION BY a.row, a.col ORDER BY b.z, b.id) AS r FROM v_grid a JOIN (SELECT row + dr AS row, col + dc AS col, z, row * 100 + col AS id FROM v_grid, (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc) WHERE dr <> 0 OR dc <> 0) b ON a.row = b.row AND a.col = b.col) WHERE r = 1 AND low < z"
))
def flow_directions(spark, sf_dir):
    return raster.flow_edges(v_grid(spark, sf_dir), "z", WIDTH)


_LOWEST = "SELECT row * 100 + col AS src, dst FROM (SELECT a.row, a.col, a.z, b.id AS dst, b.z AS low, row_number() OVER (PARTITION BY a.row, a.col ORDER BY b.z, b.id) AS r FROM v_grid a JOIN (SELECT row + dr AS row, col + dc AS col, z, row * 100 + col AS id FROM v_grid, (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc) WHERE dr <> 0 OR dc <> 0) b ON a.row = b.row AND a.col = b.col) WHERE r = 1 AND low < z"


@query(twin(
    "SELECT id, round(min(d), 6) AS distance FROM r GROUP BY id", recursive=True, f=_LOWEST, n="SELECT src AS id FROM f UNION SELECT dst FROM f",
    up="SELECT id, id AS origin FROM n UNION ALL SELECT f.dst, up.origin FROM up JOIN f ON up.id = f.src", c="SELECT id FROM up GROUP BY id HAVING count(*) >= 20",
    r="SELECT id, 0e0 AS d FROM c UNION ALL SELECT f.src, r.d + CASE WHEN f.src % 100 <> f.dst % 100 AND f.src // 100 <> f.dst // 100 THEN 10 * sqrt(2e0) ELSE 10 END FROM r JOIN f ON r.id = f.dst WHERE f.src NOT IN (SELECT id FROM c)"))
def overland_distance(spark, sf_dir):
    """Metres of flow from each cell of the grid to the first channel cell, over cells of 10 metres."""
    e = saved(raster.flow_edges(v_grid(spark, sf_dir), "z", WIDTH), "flow-edges")
    cells = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    out = hydrology.overland_distance(e, hydrology.flow_accumulation(cells, e), 20, WIDTH, 10.0)
    return out.select("id", r6("distance").alias("distance"))


#: The grid as degrees around zone 32's meridian, rows running south, and cells of metres over it.
_DEGREES = dict(x0=9.0, y0=51.0, dx=0.001, dy=-0.0006, cols=100)
_METRES = dict(x0=500000.0, y0=5649700.0, dx=69.0, dy=-66.0, cols=100)
_TO_DEGREES = functools.partial(projection.backward, zone="32")


def _asked(shift: float) -> str:
    """Row and column of the target, and the fractional place in the source."""
    source, target = Lattice(rows=0, **_DEGREES), Lattice(rows=0, **_METRES)
    x, y = target.middle()
    u, v = _TO_DEGREES("x", "y")
    row, col = source.place("u", "v")
    return f"SELECT row, col, round({row} * 64) / 64 - {shift} AS r, round({col} * 64) / 64 - {shift} AS c FROM (SELECT row, col, {u} AS u, {v} AS v FROM (SELECT row, col, {x} AS x, {y} AS y FROM v_grid))"


def _reprojected(spark, sf_dir, method):
    grid = _cents(spark, sf_dir)
    rows = grid.agg(F.max("row")).first()[0] + 1
    return reproject(grid, "v", Lattice(rows=rows, **_DEGREES), Lattice(rows=rows, **_METRES), _TO_DEGREES, method, 64)


@query(twin("SELECT a.row, a.col, g.v / 100 AS z FROM a LEFT JOIN g ON CAST(floor(r) AS BIGINT) = g.row AND CAST(floor(c) AS BIGINT) = g.col", a=_asked(0.0), g=_CENTS))
def reproject_nearest(spark, sf_dir):
    """A grid of degrees on cells of metres, the source cell that holds each middle."""
    return _reprojected(spark, sf_dir, "nearest").select("row", "col", (F.col("v") / 100).alias("z"))


@query(twin(
    "SELECT row, col, CASE WHEN count(v) = 4 THEN sum(v * w) / 100 END AS z FROM (SELECT a.row, a.col, g.v, CASE WHEN i = 0 THEN 1 - (r - floor(r)) ELSE r - floor(r) END * CASE WHEN j = 0 THEN 1 - (c - floor(c)) ELSE c - floor(c) END AS w "
    "FROM a CROSS JOIN (VALUES (0), (1)) s(i) CROSS JOIN (VALUES (0), (1)) t(j) LEFT JOIN g ON CAST(floor(r) AS BIGINT) + i = g.row AND CAST(floor(c) AS BIGINT) + j = g.col) GROUP BY row, col", a=_asked(0.5), g=_CENTS))  # fmt: skip
def reproject_bilinear(spark, sf_dir):
    """A grid of degrees on cells of metres, between the four cells around each middle."""
    return _reprojected(spark, sf_dir, "bilinear").select("row", "col", (F.col("v") / 100).alias("z"))


@query(twin("SELECT row, col, band, round((v - m) / s, 6) AS z FROM (SELECT row, col, 'z' AS band, z AS v FROM v_grid), (SELECT avg(z) AS m, stddev_pop(z) AS s FROM v_grid)"))
def band_zscore(spark, sf_dir):
    out = R.band_math(v_grid(spark, sf_dir).select("row", "col", "z"), ["z"], R.zscore_text(["z"]))
    return out.select("row", "col", F.lit("z").alias("band"), r6("z_z").alias("z"))


@query(twin(
    "SELECT CAST(greatest(-max(b).s, 2) AS BIGINT) AS cutoff FROM (SELECT {'d': round(lead(m, 2) OVER w - 2 * lead(m, 1) OVER w + m, 9), 's': -lead(size, 1) OVER w} AS b, lead(m, 2) OVER w AS ok FROM "
    "(SELECT size, CASE WHEN count(*) OVER () > 2 AND lag(y, 1) OVER w IS NULL THEN list_sort([y, lead(y, 1) OVER w, 3 * lead(y, 1) OVER w - 2 * lead(y, 2) OVER w])[2] WHEN count(*) OVER () > 2 AND lead(y, 1) OVER w IS NULL THEN list_sort([y, lag(y, 1) OVER w, 3 * lag(y, 1) OVER w - 2 * lag(y, 2) OVER w])[2] ELSE y END AS m FROM "
    "(SELECT size, CASE WHEN lag(size) OVER v IS NULL OR lead(size) OVER v IS NULL THEN ln(size) ELSE list_sort([lag(ln(size)) OVER v, ln(size), lead(ln(size)) OVER v])[2] END AS y FROM (SELECT DISTINCT n AS size FROM s) WINDOW v AS (ORDER BY size)) WINDOW w AS (ORDER BY size)) WINDOW w AS (ORDER BY size)) WHERE ok IS NOT NULL", s=_SIZES))  # fmt: skip
def knee_cutoff(spark, sf_dir):
    return stats.knee(_sizes(spark, sf_dir), "n", 2, 1)


@query(twin("SELECT segment_id, count(*) AS cells, max(z) AS top FROM (SELECT c.segment_id, c.price AS z FROM v_cell c WHERE c.w >= 0.5e0) GROUP BY segment_id"))
def rasterize_majority(spark, sf_dir):
    """Cells that a segment covers by half or more."""
    return v_cell(spark, sf_dir).filter("w >= 0.5").groupBy("segment_id").agg(F.count(F.lit(1)).alias("cells"), F.max("price").alias("top"))



@query(twin("SELECT row, col, z FROM v_grid WHERE row BETWEEN 5 AND 12 AND col BETWEEN 20 AND 60"))
def crop_extent(spark, sf_dir):
    return raster.crop(v_grid(spark, sf_dir), (5, 12), (20, 60)).select("row", "col", "z")


@query(twin("SELECT row * 2 + r AS row, col * 2 + c AS col, z FROM v_grid, (VALUES (0), (1)) x(r), (VALUES (0), (1)) y(c)"))
def resample_nearest(spark, sf_dir):
    return raster.resample_nearest(v_grid(spark, sf_dir), "z", 2)


@query(twin(
    "SELECT t.id, CASE WHEN count(g.v) = 4 THEN sum(g.v * (CASE WHEN r = 0 THEN 1 - fy ELSE fy END) * (CASE WHEN c = 0 THEN 1 - fx ELSE fx END)) END / 100 AS z FROM "
    "(SELECT id, y, x, y - floor(y) AS fy, x - floor(x) AS fx FROM (SELECT id, floor(y / 125e0) / 8 AS y, floor(x / 13e0) / 8 AS x FROM v_pt)) t CROSS JOIN (VALUES (0), (1)) a(r) CROSS JOIN (VALUES (0), (1)) b(c) LEFT JOIN g ON g.row = CAST(floor(y) AS BIGINT) + r AND g.col = CAST(floor(x) AS BIGINT) + c GROUP BY t.id", g=_CENTS
))
def resample_bilinear(spark, sf_dir):
    """At places in eighths of a cell, from whole cents: exact."""
    from .views import v_pt

    places = v_pt(spark, sf_dir).select("id", (F.floor(F.col("y") / 125) / 8).alias("y"), (F.floor(F.col("x") / 13) / 8).alias("x"))
    return raster.resample_bilinear(_cents(spark, sf_dir), "v", places).select("id", (F.col("v") / 100).alias("z"))


@query("SELECT cell, value, cloud FROM (SELECT l_suppkey AS cell, l_extendedprice AS value, l_discount AS cloud, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount, l_orderkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def least_cloud_mosaic(spark, sf_dir):
    scenes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_extendedprice").alias("value"), F.col("l_discount").alias("cloud"), F.struct("l_orderkey", "l_extendedprice").alias("key"))
    return raster.least_cloud(scenes, ["cell"], "value", "cloud", "key")


@query()
def sink_fill(spark, sf_dir):
    """The whole grid, with a rise of 0.1 degrees on the way out over cells of 10; a test holds levels against relaxation."""
    return raster.fill_sinks(v_grid(spark, sf_dir).select("row", "col", "z"), "z", 10 * 0.0017453310241888004)
