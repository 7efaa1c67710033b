"""Polygons as rings: arrays of structs (x, y), not closed.  Measures and clipping are column expressions; joins meet in grid buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiq.sources.scratch import saved

from .relational import spread

POINT = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x0: Column, y0: Column, x1: Column, y1: Column, by: float = 0.0) -> Column:
    """A rectangle's ring, counter-clockwise, moved outwards ``by`` so much on each side."""
    a, b, c, d = x0 - by, y0 - by, x1 + by, y1 + by
    return F.array(point(a, b), point(c, b), point(c, d), point(a, d))


def edges(ring: Column) -> Column:
    """The ring's edges, each a struct (a, b) of its ends."""
    turned = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Point in ring by crossings (edges on the left and below count as inside)."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(edges(ring), crossed)) % 2 == 1


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, t: a + t)


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive counter-clockwise."""
    return _sum(F.transform(edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def perimeter(ring: Column) -> Column:
    return _sum(F.transform(edges(ring), lambda e: F.sqrt((e["a"]["x"] - e["b"]["x"]) ** 2 + (e["a"]["y"] - e["b"]["y"]) ** 2)))


def centroid(ring: Column) -> Column:
    """Struct (x, y) of the area's centre; null for a ring without area."""
    area = F.nullif(signed_area(ring), F.lit(0.0))
    part = lambda k: _sum(F.transform(edges(ring), lambda e: (e["a"][k] + e["b"][k]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / (6 * area)
    return F.when(area.isNotNull(), point(part("x"), part("y")))


def _side(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _cross(e: Column, f: Column) -> Column:
    """Whether two edges cross in a point that is inside both."""
    return (_side(e["a"], e["b"], f["a"]) * _side(e["a"], e["b"], f["b"]) < 0) & (_side(f["a"], f["b"], e["a"]) * _side(f["a"], f["b"], e["b"]) < 0)


def is_empty(ring: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(ring)) < 3, F.lit(True))


def is_valid(ring: Column) -> Column:
    """Three different vertices, an area, no vertex twice, and no two edges that cross."""
    each = edges(ring)
    crossing = F.exists(each, lambda e: F.exists(each, lambda f: _cross(e, f)))
    return ~is_empty(ring) & (signed_area(ring) != 0) & (F.size(F.array_distinct(ring)) == F.size(ring)) & ~crossing


def made_valid(ring: Column) -> Column:
    """Without repeated vertices and the closing one; a ring whose edges cross becomes its vertices in order around their mean.

    The result of the second case is star-shaped, hence without crossings.
    """
    once = F.array_distinct(ring)
    n = F.size(once)
    mean = lambda k: _sum(F.transform(once, lambda p: p[k])) / n
    around = F.transform(F.array_sort(F.transform(once, lambda p: F.struct(F.atan2(p["y"] - mean("y"), p["x"] - mean("x")).alias("t"), p.alias("p")))), lambda s: s["p"])
    return F.when(is_empty(ring), None).when(is_valid(once), once).otherwise(around)


def _clipped(ring: Column, axis: str, bound: float, sign: float) -> Column:
    """The part of a ring on one side of a line along an axis."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: sign * (p[axis] - bound) >= 0

    def kept(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a[other] + (b[other] - a[other]) * (bound - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
        cut = point(F.lit(bound), at) if axis == "x" else point(at, F.lit(bound))
        both = F.when(inside(a) & inside(b), F.array(b)).when(inside(b), F.array(cut, b)).when(inside(a), F.array(cut))
        return F.coalesce(both, F.array().cast(POINT))

    return F.flatten(F.transform(edges(ring), kept))


def clip(ring: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The part of a ring within a rectangle, one side after another; empty where nothing is left.

    A concave ring that leaves the rectangle and returns keeps edges along its
    sides, which add no area.
    """
    for axis, bound, sign in (("x", x0, 1.0), ("x", x1, -1.0), ("y", y0, 1.0), ("y", y1, -1.0)):
        ring = _clipped(ring, axis, bound, sign)
    return ring


def clip_line(line: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The parts of a line of points within a rectangle: segments, structs (a, b), of a length above 0."""
    ends = F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def cut(e: Column) -> Column:
        # Shares of the segment at which it enters and leaves the two strips.
        low, high = [F.lit(0.0)], [F.lit(1.0)]
        for k, lo, hi in (("x", x0, x1), ("y", y0, y1)):
            a, d = e["a"][k], F.nullif(e["b"][k] - e["a"][k], F.lit(0.0))
            beside = F.when(a.between(lo, hi), F.lit(0.0)).otherwise(F.lit(2.0))
            low.append(F.coalesce(F.least((lo - a) / d, (hi - a) / d), beside))
            high.append(F.coalesce(F.greatest((lo - a) / d, (hi - a) / d), F.lit(1.0)))
        return F.struct(e.alias("e"), F.greatest(*low).alias("s"), F.least(*high).alias("t"))

    def at(c: Column, share: Column) -> Column:
        a, b = c["e"]["a"], c["e"]["b"]
        return point(a["x"] + (b["x"] - a["x"]) * share, a["y"] + (b["y"] - a["y"]) * share)

    within_ = F.filter(F.transform(ends, cut), lambda c: (c["s"] < c["t"]) & (c["e"]["a"] != c["e"]["b"]))
    return F.transform(within_, lambda c: F.struct(at(c, c["s"]).alias("a"), at(c, c["t"]).alias("b")))


def length(segments: Column) -> Column:
    return _sum(F.transform(segments, lambda e: F.sqrt((e["a"]["x"] - e["b"]["x"]) ** 2 + (e["a"]["y"] - e["b"]["y"]) ** 2)))


def within(ring: Column, outer: Column) -> Column:
    """Whether a ring lies wholly within another: all vertices inside, no edges that cross."""
    return F.forall(ring, lambda p: contains(outer, p["x"], p["y"])) & ~F.exists(edges(ring), lambda e: F.exists(edges(outer), lambda f: _cross(e, f)))


def extent(ring: Column) -> dict[str, Column]:
    each = {"x": F.transform(ring, lambda p: p["x"]), "y": F.transform(ring, lambda p: p["y"])}
    return {f"{name}{k}": f(values) for k, values in each.items() for name, f in (("min", F.array_min), ("max", F.array_max))}


def _bucketed(polygons: DataFrame, ring: str, size: float) -> DataFrame:
    """A row for each bucket that a polygon's box meets."""
    at = extent(F.col(ring))
    span = lambda k: F.sequence(F.floor(at[f"min{k}"] / size), F.floor(at[f"max{k}"] / size))
    return polygons.withColumn("_bx", F.explode(span("x"))).withColumn("_by", F.explode(span("y")))


def points_in_polygons(points: DataFrame, polygons: DataFrame, ring: str, size: float, x: str = "x", y: str = "y", how: str = "inner") -> DataFrame:
    """Points with the polygons that hold them: an equi-join on buckets of ``size``, then crossings."""
    tiles = _bucketed(polygons, ring, size)
    at = points.withColumn("_px", F.floor(F.col(x) / size)).withColumn("_py", F.floor(F.col(y) / size))
    hit = (at["_px"] == tiles["_bx"]) & (at["_py"] == tiles["_by"]) & contains(F.col(ring), F.col(x), F.col(y))
    return at.join(tiles, hit, how).drop("_px", "_py", "_bx", "_by")


def rasterise(polygons: DataFrame, ring: str, size: float) -> DataFrame:
    """row, col and the polygon's columns for each cell of side ``size`` whose middle a polygon holds."""
    at = extent(F.col(ring))
    span = lambda k: F.sequence(F.floor(at[f"min{k}"] / size), F.floor(at[f"max{k}"] / size))
    cells = polygons.withColumn("row", F.explode(span("y"))).withColumn("col", F.explode(span("x")))
    return cells.filter(contains(F.col(ring), (F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size)).drop(ring)


def polygonise(grid: DataFrame, label: str, width: int, tile: int = 128) -> DataFrame:
    """label, ring, seq, x, y: corners of the outlines of equal labels, in units of cells; areas of one label are dissolved.

    Each cell has its four sides, counter-clockwise; those towards the same label
    go.  A side's successor is the one that turns left first, so that outer rings
    run counter-clockwise, holes clockwise, and cells that touch in a corner stay
    apart.  Tiles of ``tile`` cells a side, each with its neighbours' border cells
    around it, follow the sides on their own; what leaves a tile is a piece of a
    ring.  Pieces alone are joined by pointer doubling, a round for each doubling of
    the pieces of a ring, each written out.  ``width`` is at least the number of
    columns; row and column are not negative.
    """
    kind = dict(grid.dtypes)
    # The two zeros of floating numbers are one label.
    value = F.col(label) + F.lit(0.0).cast(kind[label]) if kind[label] in ("float", "double") else F.col(label)
    inside = lambda c: F.pmod(F.col(c), F.lit(tile))
    # A border cell goes to the tiles beside it as well.
    beside = lambda c: F.filter(F.array(F.lit(0), F.when(inside(c) == 0, -1), F.when(inside(c) == tile - 1, 1)), lambda x: x.isNotNull())
    cells = grid.select(value.alias("label"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).withColumn("_si", F.explode(beside("row"))).withColumn("_sj", F.explode(beside("col")))
    cells = cells.select("label", "row", "col", (F.floor(F.col("row") / tile) + F.col("_si")).alias("_ti"), (F.floor(F.col("col") / tile) + F.col("_sj")).alias("_tj"))
    schema = f"label {kind[label]}, start long, next long, low long, at long, n long, x array<long>, y array<long>"
    pieces = saved(spread(cells, 200_000, "_ti", "_tj").groupBy("_ti", "_tj").applyInArrow(lambda t: _outlined(t, width, tile), schema), "pieces")
    # A piece that ends where it starts is a ring.
    parts = pieces.filter("next <> start")
    links = saved(parts.select("start", "next", F.struct("low", "start").alias("low")), "links")
    while True:
        ahead = links.select(F.col("start").alias("next"), F.col("next").alias("_next"), F.col("low").alias("_low"))
        now = saved(links.join(ahead, "next").select("start", F.col("_next").alias("next"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved")), "links")
        links = now.drop("moved")
        if now.filter("moved").isEmpty():
            break
    # Corners from a piece's start to the end of its ring's last piece, found by doubling again; the first piece holds the ring's lowest side.
    ends = links.select("start", F.col("low.low").alias("ring"), F.col("low.start").alias("first"))
    own = parts.select("start", "next", F.col("n").alias("steps"))
    ranks = saved(own.join(ends, "start").select("start", "ring", "first", F.when(F.col("next") != F.col("first"), F.col("next")).alias("next"), "steps"), "ranks")
    while not ranks.filter("next is not null").isEmpty():
        ahead = ranks.select(F.col("start").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"))
        ranks = saved(ranks.join(ahead, "next", "left").select("start", "ring", "first", F.col("_next").alias("next"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")), "ranks")
    firsts = ranks.filter("start = first").select("ring", F.col("steps").alias("total")).join(parts.select(F.col("low").alias("ring"), F.col("at").alias("turned")), "ring")
    placed = parts.join(ranks.join(firsts, "ring").select("start", "ring", (F.col("total") - F.col("steps") - F.col("turned")).alias("before"), "total"), "start")
    closed = pieces.filter("next = start").withColumns({"ring": F.col("low"), "before": -F.col("at"), "total": F.col("n")})
    corner = F.posexplode(F.arrays_zip("x", "y")).alias("_i", "_p")
    out = closed.select("label", "ring", "before", "total", corner).unionByName(placed.select("label", "ring", "before", "total", corner))
    seq = (F.pmod(F.col("before") + F.col("_i"), F.col("total")) + 1).cast("int")
    return out.select("label", "ring", seq.alias("seq"), F.col("_p.x").cast(kind["col"]).alias("x"), F.col("_p.y").cast(kind["row"]).alias("y"))


def _outlined(cells: pa.Table, width: int, tile: int) -> pa.Table:
    """One tile's rings and pieces of rings: label, numbers of the first side and of the one that follows, the lowest, the corners before that, all corners.

    Sides have directions: 0 to the right, 1 up (rising rows), 2 to the left, 3 down; the cell is on the left.
    """
    row, col, ti, tj = (cells.column(c).to_numpy() for c in ("row", "col", "_ti", "_tj"))
    top, left, wide = int(ti[0]) * tile - 1, int(tj[0]) * tile - 1, tile + 2
    cell = (row - top) * wide + col - left
    at, code = np.full(wide * wide, -1), np.full(wide * wide, -1)
    at[cell] = np.arange(len(cell))
    code[cell] = cells.column("label").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    own = np.sort(cell[(row // tile == ti) & (col // tile == tj)])
    out = (-wide, 1, wide, -1)  # the cell across a side of each direction
    follow, bend = np.full(wide * wide * 4, -1), np.zeros(wide * wide * 4, bool)
    for d in range(4):
        k = own[code[own + out[d]] != code[own]]
        ahead, behind = k + out[(d + 1) % 4], k - out[(d + 1) % 4]
        other = lambda x, k=k: code[x] != code[k]
        follow[k * 4 + d] = np.where(other(ahead), k * 4 + (d + 1) % 4, np.where(other(ahead + out[d]), ahead * 4 + d, (ahead + out[d]) * 4 + (d + 3) % 4))
        bend[k * 4 + d] = other(behind) | ~other(behind + out[d])
    sides = np.flatnonzero(follow >= 0)
    entered = np.zeros(len(follow), bool)
    entered[follow[sides]] = True
    after, order, begins, following = follow.tolist(), [], [], []
    # What comes from outside first: the sides left over then are rings.
    for s in [*sides[~entered[sides]].tolist(), *sides[entered[sides]].tolist()]:
        if after[s] >= 0:
            begins.append(len(order))
            while after[s] >= 0:
                order.append(s)
                after[s], s = -1, after[s]
            following.append(s)
    order, begins = np.array(order, int), np.array(begins, int)

    def corner(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = side % 4
        return side // 4 % wide + left + ((d == 1) | (d == 2)), side // 4 // wide + top + (d >= 2)

    def number(side: np.ndarray) -> np.ndarray:
        x, y = corner(side)
        return (y * (width + 1) + x) * 4 + side % 4

    numbers, turns = number(order), bend[order]
    piece = np.repeat(np.arange(len(begins)), np.diff([*begins, len(order)]))
    low = np.minimum.reduceat(numbers, begins) if len(begins) else numbers
    passed = np.cumsum(turns) - turns
    lowest = np.flatnonzero(numbers == low[piece]) if len(begins) else order
    n = np.bincount(piece[turns], minlength=len(begins))
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    x, y = (pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int64))) for v in corner(order[turns]))
    columns = [cells.column("label").combine_chunks().take(pa.array(at[order[begins] // 4])), *map(pa.array, (numbers[begins], number(np.array(following, int)), low, passed[lowest] - passed[begins], n)), x, y]
    return pa.Table.from_arrays(columns, names=["label", "start", "next", "low", "at", "n", "x", "y"])


def collected(corners: DataFrame) -> DataFrame:
    """label, ring, points: the rings of :func:`polygonise` as arrays, one outline each."""
    order = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    return corners.groupBy("label", "ring").agg(order.alias("_p")).select("label", "ring", F.transform("_p", lambda p: point(p["x"], p["y"])).alias("points"))
