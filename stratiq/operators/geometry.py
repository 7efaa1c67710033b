"""Points, rectangles and rings.  Spatial joins meet in grid buckets, so that only near rows are compared."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiq.sources.scratch import dropped, saved

from .relational import small, spread

Ring = Sequence[tuple[float, float]]


def in_ring(x: Column, y: Column, ring: Ring) -> Column:
    """Point in polygon by crossings of a fixed ring, as one expression (edges on the left and below count as inside)."""
    inside = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            at = (y - y1) * (x2 - x1) / (y2 - y1) + x1
            inside = inside + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at), 1).otherwise(0)
    return inside % 2 == 1


def within_filter(points: DataFrame, ring: Ring, x: str = "x", y: str = "y") -> DataFrame:
    """Points within one polygon: its box first, then the crossings."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return points.filter(F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys)) & in_ring(F.col(x), F.col(y), ring))


def join_rectangles(points: DataFrame, rectangles: DataFrame, size: float, how: str = "inner") -> DataFrame:
    """Points with the half-open rectangles (x0, y0, x1, y1) that hold them, by buckets of ``size``: an equi-join."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    tiles = rectangles.withColumn("_bx", F.explode(span("x0", "x1"))).withColumn("_by", F.explode(span("y0", "y1")))
    at = points.withColumn("_bx", F.floor(F.col("x") / size)).withColumn("_by", F.floor(F.col("y") / size))
    hit = (at["_bx"] == tiles["_bx"]) & (at["_by"] == tiles["_by"]) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return at.join(tiles, hit, how).drop("_bx", "_by")


def _around(reach: int) -> Column:
    """The steps (x, y) to a bucket and those around it."""
    return F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])


def _placed(x: str, y: str) -> Column:
    """Whether a row has a place: neither null nor nan nor infinite."""
    return F.coalesce((F.abs(F.col(x).cast("double")) < float("inf")) & (F.abs(F.col(y).cast("double")) < float("inf")), F.lit(False))


#: Points of one place that are packed together, and points of a bucket whose pairs one task makes.
PACKED, MET = 32, 2_000


def within_distance(points: DataFrame, key: str, d: float, x: str = "x", y: str = "y", shown: Callable[[Column], Column] = lambda gap: gap) -> DataFrame:
    """Pairs a < b of points within d.

    Points of one place are packed, at most about ``PACKED`` together.  Packs meet,
    not points: a distance, and what ``shown`` makes of it, is worked out once for
    two of them, and only then their points are paired.  A pack meets its own
    bucket of side d and four of the eight around it, so that two buckets meet
    once.  Tasks see the buckets of a bounded number of points, or a part of one
    that holds more: their pairs outnumber them, and no side is broadcast.
    """
    at = points.select(F.col(key).alias("_id"), F.col(x).alias("ax"), F.col(y).alias("ay")).filter(_placed("ax", "ay"))
    full = at.groupBy("ax", "ay").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PACKED)
    parted = at.join(small(saved(full, "full-places")), ["ax", "ay"], "left").withColumn("_pa", F.pmod(F.xxhash64("_id"), F.coalesce(F.ceil(F.col("_n") / PACKED), F.lit(1))))
    packs = saved(parted.groupBy("ax", "ay", "_pa").agg(F.collect_list("_id").alias("_ia")), "packs")
    packs = packs.withColumn("_bx", F.floor(F.col("ax") / d)).withColumn("_by", F.floor(F.col("ay") / d))
    n = packs.agg(F.sum(F.size("_ia"))).first()[0] or 0
    full = packs.groupBy("_bx", "_by").agg(F.sum(F.size("_ia")).alias("_n")).filter(F.col("_n") > MET)
    full = small(saved(full.select("_bx", "_by", F.ceil(F.col("_n") / MET).cast("int").alias("_parts")), "full-buckets"))
    one = packs.join(full, ["_bx", "_by"], "left").withColumn("_part", F.pmod(F.xxhash64("ax", "ay", "_pa"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))]))
    near = packs.withColumnsRenamed({"_ia": "_ib", "ax": "bx", "ay": "by", "_pa": "_pb"}).withColumn("_s", ahead)
    near = near.select("_ib", "bx", "by", "_pb", (F.col("_bx") + F.col("_s.x")).alias("_bx"), (F.col("_by") + F.col("_s.y")).alias("_by"), ((F.col("_s.x") == 0) & (F.col("_s.y") == 0)).alias("_same"))
    near = near.join(full, ["_bx", "_by"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    gap = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    met = ["_bx", "_by", "_part"]
    pairs = spread(one, MET, *met, rows=n).join(spread(near, MET, *met, rows=n).hint("merge"), met)
    # Two packs of a bucket meet twice, and each meets itself.
    mine, other = F.struct("ax", "ay", "_pa"), F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("_pb").alias("_pa"))
    pairs = pairs.filter(~F.col("_same") | (mine <= other)).filter(gap <= d)
    pairs = pairs.select(F.explode("_ia").alias("_a"), "_ib", shown(gap).alias("distance"), (mine == other).alias("_own")).select("_a", F.explode("_ib").alias("_b"), "distance", "_own")
    first = F.col("_a") < F.col("_b")
    pairs = pairs.filter(first | ((F.col("_a") > F.col("_b")) & ~F.col("_own")))
    return pairs.select(F.when(first, F.col("_a")).otherwise(F.col("_b")).alias("a"), F.when(first, F.col("_b")).otherwise(F.col("_a")).alias("b"), "distance")


def thin(points: DataFrame, key: str, order: Sequence[str], d: float, x: str = "x", y: str = "y") -> DataFrame:
    """Greedy thinning: in order, a point stays if no point that stays before it is within d.

    Decided in rounds that are written out, without the pairs within d.  Two
    points of a bucket whose diagonal is under d exclude each other, so that only
    its earliest point can be next to stay: it does if no undecided earlier point
    is within d, and all points within d of it are decided.  A point meets at most
    25 such candidates a round.  The result is that of the sequential rule.  Rows
    without a place stay.
    """
    points = saved(points, "thin-points")
    side = d / 1.4143  # just over the root of 2
    placed = _placed(x, y)
    rank = F.struct(*order, F.col(key).alias("_key"))
    bucket = lambda c: F.floor(F.col(c).cast("double") / side)
    left = points.filter(placed).select(F.col(key).alias("id"), rank.alias("rank"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), bucket(x).alias("_bx"), bucket(y).alias("_by"))
    left = saved(left, "thin-left")

    def seen(found: DataFrame) -> DataFrame:
        """For each bucket the candidates around it, at most 25."""
        near = found.withColumn("_s", F.explode(_around(2))).groupBy((F.col("_bx") + F.col("_s.x")).alias("_bx"), (F.col("_by") + F.col("_s.y")).alias("_by"))
        near = near.agg(F.collect_list(F.struct("id", "rank", "x", "y")).alias("_near"))
        return F.broadcast(near) if found.limit(20_001).count() <= 20_000 else near.hint("merge")

    gap = lambda c: F.sqrt((F.col("x") - c["x"]) ** 2 + (F.col("y") - c["y"]) ** 2)
    kept = None
    while not left.isEmpty():
        first = left.groupBy("_bx", "_by").agg(F.min(F.struct("rank", "id", "x", "y")).alias("c")).select("_bx", "_by", "c.*")
        first = saved(first, "thin-first")
        beaten = left.join(seen(first), ["_bx", "_by"]).select(F.explode(F.filter("_near", lambda c: (F.col("rank") < c["rank"]) & (gap(c) <= d))).alias("c")).select("c.id").distinct()
        stay = saved(first.join(beaten.hint("merge"), "id", "left_anti"), "thin-stay")
        kept = stay.select("id") if kept is None else kept.union(stay.select("id"))
        open_ = left.join(seen(stay), ["_bx", "_by"], "left").filter(F.col("_near").isNull() | ~F.exists("_near", lambda c: gap(c) <= d))
        after = saved(open_.select(*left.columns), "thin-left")
        dropped(left)
        dropped(first)
        left = after
    if kept is None:
        return points
    own = points.filter(placed).join(kept.withColumnRenamed("id", key).hint("merge"), key, "left_semi")
    return own.select(*points.columns).union(points.filter(~placed))


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of structs (x, y), closed or not."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(ring, i)["x"] * F.element_at(ring, i % n + 1)["y"] - F.element_at(ring, i % n + 1)["x"] * F.element_at(ring, i)["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def boxes(df: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    return df.groupBy(by).agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def cell_centroids(cells: DataFrame, by: str, x: str, y: str) -> DataFrame:
    return cells.groupBy(by).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count(F.lit(1)).alias("cells"))


def point_on_surface(cells: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """The member cell nearest to the segment's centroid, the first in (x, y) of ties."""
    c = cell_centroids(cells, by, x, y)
    gap = (F.col(x) - F.col("cx")) ** 2 + (F.col(y) - F.col("cy")) ** 2
    best = F.min(F.struct(F.round(gap, 6).alias("d"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("p")
    return cells.join(c, by).groupBy(by).agg(best).select(by, F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def _hull(pdf: pd.DataFrame) -> pd.DataFrame:
    """Monotone chain over one group's points."""
    points = sorted(set(zip(pdf["x"], pdf["y"], strict=True)))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    hull: list = []
    for run in (points, points[::-1]):
        base = len(hull)
        for p in run:
            while len(hull) - base >= 2 and turn(hull[-2], hull[-1], p) <= 0:
                hull.pop()
            hull.append(p)
        hull.pop()
    hull = hull or points
    return pd.DataFrame({"grp": [pdf["grp"].iloc[0]] * len(hull), "i": range(1, len(hull) + 1), "x": [p[0] for p in hull], "y": [p[1] for p in hull]})


def convex_hulls(points: DataFrame, by: str, x: str, y: str, directions: int = 64) -> DataFrame:
    """Hull vertices of each group, counter-clockwise: grp, i, x, y.

    First, by partial aggregates, each group gets its extreme points in
    ``directions`` directions.  Points strictly inside the polygon of these can't be
    vertices; one task for each group sees the others.
    """
    from math import cos, pi, sin

    rows = points.select(F.col(by).cast("string").alias("grp"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).distinct()
    # Points strictly inside the polygon of extremes can't be vertices.
    at = [(cos(2 * pi * i / directions), sin(2 * pi * i / directions)) for i in range(directions)]
    tops = rows.groupBy("grp").agg(*[F.max(F.col("x") * a + F.col("y") * b).alias(f"t{i}") for i, (a, b) in enumerate(at)], *[F.max_by(F.struct("x", "y"), F.col("x") * a + F.col("y") * b).alias(f"p{i}") for i, (a, b) in enumerate(at)])
    inside = F.lit(True)
    for i in range(directions):
        p, q = F.col(f"p{i}"), F.col(f"p{(i + 1) % directions}")
        same = (p["x"] == q["x"]) & (p["y"] == q["y"])
        inside = inside & (same | ((q["x"] - p["x"]) * (F.col("y") - p["y"]) - (q["y"] - p["y"]) * (F.col("x") - p["x"]) > 1e-9))
    outer = rows.join(small(tops, 10_000), "grp").filter(~inside).select("grp", "x", "y")
    return outer.groupBy("grp").applyInPandas(_hull, "grp string, i int, x double, y double")


def tile_ids(df: DataFrame, x: str, y: str, size: float, columns: int) -> DataFrame:
    """Number of the regular tile that holds each row."""
    return df.withColumn("tile", (F.floor(F.col(y) / size) * columns + F.floor(F.col(x) / size)).cast("long"))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lon/lat degrees to spherical Mercator metres."""
    r = 6378137.0
    return F.radians(lon) * r, F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * r


def nearest_gap(points: DataFrame, key: str, d: float, most: int = 64) -> DataFrame:
    """Each point's distance to its nearest neighbour within d.

    Points of one place are neighbours at 0.  The other places look around within
    a radius at which no bucket holds more than ``most`` places; those that find
    none within it look twice as far, up to d.  Places that still look are apart
    by more than the last radius, so that a bucket holds few of them.
    """
    at = points.filter(_placed("x", "y")).select(F.col(key), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    places = saved(at.groupBy("x", "y").agg((F.min(key) < F.max(key)).alias("_shared")), "places")
    bucket = lambda c, r: F.floor(F.col(c) / r)
    r, n = d, places.count()
    for _ in range(40):
        if (places.groupBy(bucket("x", r).alias("_bx"), bucket("y", r).alias("_by")).count().agg(F.max("count")).first()[0] or 0) <= most:
            break
        r /= 2
    found = places.filter("_shared").select("x", "y", F.lit(0.0).alias("nearest"))
    open_ = places.filter("not _shared").select("x", "y")
    while True:
        asked = open_.withColumn("_s", F.explode(_around(1))).select("x", "y", (bucket("x", r) + F.col("_s.x")).alias("_bx"), (bucket("y", r) + F.col("_s.y")).alias("_by"))
        other = places.select(F.col("x").alias("_x"), F.col("y").alias("_y"), bucket("x", r).alias("_bx"), bucket("y", r).alias("_by"))
        pairs = spread(asked, 5_000, "_bx", "_by", rows=n).join(spread(other, 5_000, "_bx", "_by", rows=n).hint("merge"), ["_bx", "_by"]).filter((F.col("x") != F.col("_x")) | (F.col("y") != F.col("_y")))
        gap = F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2)
        hits = saved(pairs.groupBy("x", "y").agg(F.min(gap).alias("nearest")).filter(F.col("nearest") <= r), "near")
        found = found.unionByName(hits)
        if r >= d:
            return at.join(found.hint("merge"), ["x", "y"]).select(key, "nearest")
        open_ = saved(open_.join(hits.hint("merge"), ["x", "y"], "left_anti"), "looking")
        r *= 2
