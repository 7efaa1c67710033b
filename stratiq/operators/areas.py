"""Areas: arrays of rings, with holes and several parts.  A point is inside if it is in an odd number of rings.

Rings are arrays of structs (x, y), not closed, in any direction and order; a
null or empty area holds nothing.  Measures are column expressions.  Joins of two
sets of areas meet in grid buckets; coverage of grid cells is summed from the
edges, so that no area has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import polygons as P
from .relational import dealt, spread

AREA = f"array<{P.POINT}>"
#: Shares of a cell's side below this are rounding.
TINY = 1e-9
#: Areas up to which one side of a join is broadcast.
FEW_AREAS = 1_000


def area_of(ring: Column, *holes: Column) -> Column:
    return F.array(ring, *holes)


def edges(area: Column) -> Column:
    """The edges of all rings, each a struct (a, b) of its ends."""
    return F.flatten(F.transform(area, P.edges))


def contains(area: Column, x: Column, y: Column) -> Column:
    """Point in area by crossings of all rings (edges on the left and below count as inside)."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.coalesce(F.size(F.filter(edges(area), crossed)) % 2 == 1, F.lit(False))


def oriented(area: Column) -> Column:
    """Outer rings counter-clockwise, holes clockwise: a ring is a hole if an odd number of the others hold it.

    A ring's middle of its first edge stands for it, as rings may share a vertex.
    """

    def turned(ring: Column, at: Column) -> Column:
        x, y = (ring[0]["x"] + ring[1]["x"]) / 2, (ring[0]["y"] + ring[1]["y"]) / 2
        others = F.filter(area, lambda other, i: i != at)
        hole = F.size(F.filter(others, lambda other: P.contains(other, x, y))) % 2 == 1
        return F.when((P.signed_area(ring) < 0) != hole, F.reverse(ring)).otherwise(ring)

    return F.transform(F.filter(area, lambda r: F.size(r) > 2), turned)


def measure(area: Column) -> Column:
    """Area of the parts less that of their holes."""
    return F.aggregate(F.transform(oriented(area), P.signed_area), F.lit(0.0), lambda a, t: a + t)


def perimeter(area: Column) -> Column:
    return F.aggregate(F.transform(area, P.perimeter), F.lit(0.0), lambda a, t: a + t)


def centroid(area: Column) -> Column:
    """Struct (x, y) of the centre of what is inside; null for an area of measure 0."""
    each = F.transform(oriented(area), lambda r: F.struct(P.signed_area(r).alias("w"), P.centroid(r).alias("c")))
    total = F.nullif(measure(area), F.lit(0.0))
    mean = lambda k: F.aggregate(each, F.lit(0.0), lambda a, e: a + e["w"] * e["c"][k]) / total
    return F.when(total.isNotNull(), P.point(mean("x"), mean("y")))


def extent(area: Column) -> dict[str, Column]:
    return P.extent(F.flatten(area))


def _meet(e: Column, f: Column) -> Column:
    """Whether two edges have a point in common, ends included."""
    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    s1, s2, s3, s4 = P._side(a, b, c), P._side(a, b, d), P._side(c, d, a), P._side(c, d, b)
    over = lambda k: (F.least(a[k], b[k]) <= F.greatest(c[k], d[k])) & (F.least(c[k], d[k]) <= F.greatest(a[k], b[k]))
    return (s1 * s2 <= 0) & (s3 * s4 <= 0) & over("x") & over("y")


def intersects(one: Column, other: Column) -> Column:
    """Whether two areas have a point in common; touching counts."""
    mine, theirs = edges(one), edges(other)
    touch = F.exists(mine, lambda e: F.exists(theirs, lambda f: _meet(e, f)))
    # Without a common point of their edges, one is inside the other with all of a ring.
    held = F.exists(one, lambda r: contains(other, r[0]["x"], r[0]["y"])) | F.exists(other, lambda r: contains(one, r[0]["x"], r[0]["y"]))
    return F.coalesce(touch | held, F.lit(False))


def within(one: Column, other: Column) -> Column:
    """Whether an area lies wholly within another: all its vertices inside, no edges that cross, none of the other's rings inside it."""
    inside = F.forall(F.flatten(one), lambda p: contains(other, p["x"], p["y"]))
    crossing = F.exists(edges(one), lambda e: F.exists(edges(other), lambda f: P._cross(e, f)))
    hollow = F.exists(other, lambda r: contains(one, r[0]["x"], r[0]["y"]))
    return F.coalesce(inside & ~crossing & ~hollow, F.lit(False))


def _buckets(areas: DataFrame, area: str, size: float, mark: str) -> DataFrame:
    """A row for each bucket that an area's box meets, with the box."""
    at = extent(F.col(area))
    df = areas.withColumns({f"{mark}{k}": at[k] for k in ("minx", "miny", "maxx", "maxy")})
    span = lambda k: F.sequence(F.floor(F.col(f"{mark}min{k}") / size), F.floor(F.col(f"{mark}max{k}") / size))
    return df.withColumn("_bx", F.explode(span("x"))).withColumn("_by", F.explode(span("y")))


def join_areas(left: DataFrame, right: DataFrame, left_area: str, right_area: str, size: float, test=intersects) -> DataFrame:
    """Pairs of rows whose areas pass ``test`` (intersects, within): an equi-join on buckets of ``size``.

    A pair meets in every bucket that both boxes meet, and is tested in one: that
    of the lower left corner of the boxes' overlap.  Column names differ between
    the sides.  Rows without an area have no partner.  Tests, and what follows
    them, run in tasks of a bounded number of areas of ``left``.
    """
    n = left.count()
    few = right.limit(FEW_AREAS + 1).count() <= FEW_AREAS
    a, b = _buckets(spread(left, 5_000, rows=n) if few else left, left_area, size, "_a"), _buckets(right, right_area, size, "_b")
    corner = lambda k: F.greatest(F.col(f"_amin{k}"), F.col(f"_bmin{k}"))
    apart = [F.col(f"_{one}min{k}") > F.col(f"_{other}max{k}") for k in "xy" for one, other in ("ab", "ba")]
    pairs = a.join(F.broadcast(b) if few else b.hint("merge"), ["_bx", "_by"]).filter((F.floor(corner("x") / size) == F.col("_bx")) & (F.floor(corner("y") / size) == F.col("_by")))
    pairs = pairs.filter(~(apart[0] | apart[1] | apart[2] | apart[3]))
    pairs = (pairs if few else spread(pairs, 5_000, rows=n)).filter(test(F.col(left_area), F.col(right_area)))
    return pairs.select(*[F.col(f"`{c}`") for c in (*left.columns, *right.columns)])


def join_areas_left(left: DataFrame, right: DataFrame, key: str, left_area: str, right_area: str, size: float, test=intersects) -> DataFrame:
    """:func:`join_areas`, with the rows of ``left`` that have no partner kept once; ``key`` is unique in ``left``."""
    pairs = join_areas(left, right, left_area, right_area, size, test)
    matched = pairs.select(F.col(f"`{key}`").alias("_own"), *[F.col(f"`{c}`") for c in right.columns])
    return left.join(matched, left[key].eqNullSafe(F.col("_own")), "left").drop("_own")


def filter_areas(areas: DataFrame, area: str, other: Column, test=intersects) -> DataFrame:
    """The rows whose area passes ``test`` with one other area: boxes first."""
    a, b = extent(F.col(area)), extent(other)
    near = (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])
    return areas.filter(near & test(F.col(area), other))


def points_in_areas(points: DataFrame, areas: DataFrame, area: str, size: float, x: str = "x", y: str = "y", how: str = "inner") -> DataFrame:
    """Points with the areas that hold them: an equi-join on buckets of ``size``, then crossings of all rings."""
    tiles = _buckets(areas, area, size, "_b").drop("_bminx", "_bminy", "_bmaxx", "_bmaxy")
    at = points.withColumn("_px", F.floor(F.col(x) / size)).withColumn("_py", F.floor(F.col(y) / size))
    hit = (at["_px"] == tiles["_bx"]) & (at["_py"] == tiles["_by"]) & contains(F.col(area), F.col(x), F.col(y))
    return at.join(tiles, hit, how).drop("_px", "_py", "_bx", "_by")


def clip_window(area: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The part of each ring within a rectangle, rings of which nothing is left dropped: measures stay right, edges along the sides may run to and fro."""
    return F.filter(F.transform(area, lambda r: P.clip(r, x0, y0, x1, y1)), lambda r: F.size(r) > 2)


# Coverage of grid cells.


def _pieces(areas: DataFrame, key: str, area: str, size: float) -> DataFrame:
    """_key, row, col, dy, part: the edges cut at the lines of the grid; ``part`` is the signed area between a piece and its cell's right side."""
    edge = areas.select(F.col(key).alias("_key"), F.explode(edges(oriented(F.col(area)))).alias("e")).select("_key", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))

    def shares(k: str) -> Column:
        """Where along the edge it meets the lines of the grid."""
        a, b = F.col(f"a{k}"), F.col(f"b{k}")
        low, high = F.ceil(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)
        lines = F.when((a != b) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(lines, lambda i: (i * size - a) / (b - a))

    inner = F.filter(F.concat(shares("x"), shares("y")), lambda t: (t > 0) & (t < 1))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))
    steps = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    piece = edge.withColumn("p", F.explode(steps))
    middle = lambda k: F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * (F.col("p.s") + F.col("p.t")) / 2
    piece = piece.withColumns({"row": F.floor(middle("y") / size), "col": F.floor(middle("x") / size), "dy": (F.col("by") - F.col("ay")) * (F.col("p.t") - F.col("p.s")), "mx": middle("x")})
    return piece.select("_key", "row", "col", "dy", (F.col("dy") * ((F.col("col") + 1) * size - F.col("mx"))).alias("part"))


def coverage(areas: DataFrame, key: str, area: str, size: float, touches: bool = False) -> DataFrame:
    """key, row, col, fraction: the share of each cell of side ``size`` that an area covers, exact.

    Edges are cut at the grid's lines.  In a row of cells, running from the left,
    what a cell's own pieces cover is added to the full width that all pieces
    before it cover; between two cells with pieces the cover is constant, so
    that inner cells come as runs.  ``touches`` keeps cells that an edge meets
    without covering any of it (fraction 0).  ``key`` is unique.

    Pieces meet by area and row of cells in tasks that see those of about 5,000
    areas: sums and runs need no further exchange.
    """
    n = areas.count()
    pieces = spread(_pieces(dealt(areas.select(key, area), 20_000, key, rows=n), key, area, size), 5_000, "_key", "row", rows=n)
    cells = pieces.groupBy("_key", "row", "col").agg(F.sum("dy").alias("dy"), F.sum("part").alias("part"))
    run = Window.partitionBy("_key", "row").orderBy("col")
    before = F.coalesce(F.sum("dy").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cells = cells.withColumns({"_own": -(before * size + F.col("part")) / (size * size), "_behind": -(before + F.col("dy")) / size, "_next": F.lead("col").over(run)})
    own = F.array(F.struct(F.col("col").alias("from"), F.col("col").alias("to"), F.col("_own").alias("f")))
    gap = F.when((F.col("_next") > F.col("col") + 1) & (F.col("_behind") > TINY), F.array(F.struct((F.col("col") + 1).alias("from"), (F.col("_next") - 1).alias("to"), F.col("_behind").alias("f"))))
    runs = cells.select("_key", "row", F.explode(F.concat(own, F.coalesce(gap, F.array().cast("array<struct<from:bigint,to:bigint,f:double>>")))).alias("r"))
    runs = runs if touches else runs.filter(F.col("r.f") > TINY)
    return runs.select(F.col("_key").alias(key), "row", F.explode(F.sequence("r.from", "r.to")).alias("col"), F.greatest(F.least(F.col("r.f"), F.lit(1.0)), F.lit(0.0)).alias("fraction"))


def covered_values(areas: DataFrame, key: str, area: str, grid: DataFrame, size: float) -> DataFrame:
    """key, row, col, fraction and the grid's columns for each cell that an area covers and the grid has: the rows of a weighted zonal statistic."""
    # Cells outnumber the areas that a plan is estimated from: never broadcast.
    return coverage(areas, key, area, size).hint("merge").join(grid, ["row", "col"])


def rasterise(areas: DataFrame, key: str, area: str, size: float, touches: bool = False) -> DataFrame:
    """key, row, col: the cells whose middle an area holds, or with ``touches`` all that it covers or an edge meets."""
    if touches:
        return coverage(areas, key, area, size, True).select(key, "row", "col")
    # Crossings of each row's middle line, in pairs: runs of cells between them.
    edge = areas.select(F.col(key).alias("_key"), F.explode(edges(F.col(area))).alias("e")).filter("e.a.y <> e.b.y")
    low, high = F.least("e.a.y", "e.b.y"), F.greatest("e.a.y", "e.b.y")
    first, last = F.ceil(low / size - 0.5), F.ceil(high / size - 0.5) - 1
    lines = edge.withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last))))
    y = (F.col("row") + 0.5) * size
    at = (F.col("e.b.x") - F.col("e.a.x")) * (y - F.col("e.a.y")) / (F.col("e.b.y") - F.col("e.a.y")) + F.col("e.a.x")
    run = Window.partitionBy("_key", "row").orderBy("x")
    pairs = lines.select("_key", "row", at.alias("x")).withColumns({"_end": F.lead("x").over(run), "_n": F.row_number().over(run)}).filter("_n % 2 = 1")
    start, end = F.ceil(F.col("x") / size - 0.5), F.ceil(F.col("_end") / size - 0.5) - 1
    return pairs.filter(start <= end).select(F.col("_key").alias(key), "row", F.explode(F.sequence(start, end)).alias("col"))
