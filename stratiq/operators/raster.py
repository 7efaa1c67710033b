"""Grids as cell tables: (row, col, bands).  Neighbours meet by equi-joins on shifted indices."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiq.sources.scratch import dropped, saved

from .relational import MOST_TASKS, looked_up, quantiles, spread, with_totals


def block(df: DataFrame, k: int, row: str = "row", col: str = "col") -> tuple[Column, Column]:
    return F.floor(F.col(row) / k).alias("block_row"), F.floor(F.col(col) / k).alias("block_col")


def block_aggregate(grid: DataFrame, k: int, z: str, threshold: float) -> DataFrame:
    """mean, p95, sd (sample) and share above a threshold of each k by k block."""
    return grid.groupBy(*block(grid, k)).agg(
        F.avg(z).alias("mean"), F.percentile(z, F.lit(0.95)).alias("p95"), F.stddev_samp(z).alias("sd"), F.avg(F.when(F.col(z) > threshold, 1.0).otherwise(0.0)).alias("fraction"), F.max(z).alias("max")
    )


def downsample(grid: DataFrame, k: int) -> DataFrame:
    return grid.filter((F.col("row") % k == 0) & (F.col("col") % k == 0))


def halo(grid: DataFrame, values: Sequence[str], radius: int) -> DataFrame:
    """Every cell with its neighbours within a square radius: row, col, dr, dc, values of the neighbour."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    spread = grid.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
    return spread.select((F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), "dr", "dc", *values)


def focal_sums(grid: DataFrame, z: str, radius: int) -> DataFrame:
    """row, col, focal_sum, focal_n of the square of 2 radius + 1 cells around each cell.

    Running sums along rows, then along columns: two exchanges of one row per
    place, whatever the radius.  Places without a cell, within the grid's columns,
    are filled in for the sums and count nothing.
    """
    along = lambda by, order: Window.partitionBy(by).orderBy(order).rangeBetween(-radius, radius)
    line = Window.partitionBy("row").orderBy("col")
    rows = with_totals(grid.select("row", "col", F.col(z).alias("_z")), _first=F.min("col"), _last=F.max("col"))
    start = F.when(F.lag("col").over(line).isNull(), F.col("_first")).otherwise(F.col("col"))
    stop = F.coalesce(F.lead("col").over(line) - 1, F.col("_last"))
    places = rows.withColumn("_at", F.sequence(start, stop)).withColumn("_at", F.explode("_at"))
    places = places.select("row", F.col("_at").alias("col"), (F.col("_at") == F.col("col")).alias("_real"), F.when(F.col("_at") == F.col("col"), F.col("_z")).alias("_z"))
    sums = places.select("row", "col", "_real", F.sum("_z").over(along("row", "col")).alias("_s"), F.count("_z").over(along("row", "col")).alias("_n"))
    out = sums.select("row", "col", "_real", F.sum("_s").over(along("col", "row")).alias("focal_sum"), F.sum("_n").over(along("col", "row")).alias("focal_n"))
    return out.filter("_real").drop("_real")


def focal_deviation(grid: DataFrame, z: str, radius: int) -> DataFrame:
    """Topographic position: the cell less the mean of its square neighbourhood, itself included."""
    near = focal_sums(grid, z, radius).withColumn("focal_mean", F.col("focal_sum") / F.col("focal_n")).drop("focal_sum", "focal_n")
    return grid.join(near, ["row", "col"]).withColumn("deviation", F.col(z) - F.col("focal_mean"))


#: Names of the nine cells, by rows from the north-west.
NINE = ("nw", "n", "ne", "w", "c", "e", "sw", "s", "se")


def nine(grid: DataFrame, z: str) -> DataFrame:
    """row, col, near: the 3 by 3 neighbourhood as an array in the order of ``NINE`` (null where a cell is missing).

    Neighbours are found along rows, then along columns: two exchanges.
    """

    def beside(df: DataFrame, by: str, at: str, value: str) -> tuple[Column, Column]:
        w = Window.partitionBy(by).orderBy(at)
        before = F.when(F.lag(at).over(w) == F.col(at) - 1, F.lag(value).over(w))
        after = F.when(F.lead(at).over(w) == F.col(at) + 1, F.lead(value).over(w))
        return before, after

    west, east = beside(grid, "row", "col", z)
    rows = grid.select("row", "col", F.struct(west.alias("w"), F.col(z).alias("c"), east.alias("e")).alias("_t"))
    north, south = beside(rows, "col", "row", "_t")
    three = rows.select("row", "col", north.alias("_n"), "_t", south.alias("_s"))
    return three.select("row", "col", F.array(*[F.col(f"{line}.{k}") for line in ("_n", "_t", "_s") for k in ("w", "c", "e")]).alias("near"))


def slope_aspect(grid: DataFrame, z: str, size: float) -> DataFrame:
    """Slope and aspect (degrees) of inner cells from the four neighbours' central differences, as the nine-cell fit has them too."""
    at = {k: F.col("near")[i] for i, k in enumerate(NINE)}
    wide = nine(grid.select("row", "col", z), z).filter(F.forall(F.array(*[at[k] for k in "nescw"]), lambda x: x.isNotNull()))
    dx, dy = (at["e"] - at["w"]) / (2 * size), (at["n"] - at["s"]) / (2 * size)
    aspect = F.degrees(F.atan2(-dx, -dy))
    return wide.select("row", "col", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"), F.when(aspect < 0, aspect + 360).otherwise(aspect).alias("aspect"))


def curvatures(grid: DataFrame, z: str, size: float) -> DataFrame:
    """Ten curvatures of cells with all nine neighbours, from the second-order fit of Zevenbergen and Thorne (1987).

    With p, q the first and r, t, s the second derivatives (xx, yy, xy):
    general, profile, plan, tangential, longitudinal, cross-sectional, minimal,
    maximal, total, rotor; null where a flat cell leaves them undefined.
    """
    wide = nine(grid.select("row", "col", z), z).filter(F.forall("near", lambda x: x.isNotNull()))
    at = {k: F.col("near")[i] for i, k in enumerate(NINE)}
    p, q = (at["e"] - at["w"]) / (2 * size), (at["n"] - at["s"]) / (2 * size)
    r, t = (at["e"] - 2 * at["c"] + at["w"]) / size**2, (at["n"] - 2 * at["c"] + at["s"]) / size**2
    s = (at["ne"] - at["nw"] - at["se"] + at["sw"]) / (4 * size**2)
    fit = wide.select("row", "col", F.struct(p.alias("p"), q.alias("q"), r.alias("r"), s.alias("s"), t.alias("t")).alias("fit"))
    p, q, r, s, t = (F.col(f"fit.{c}") for c in "pqrst")
    steep = p * p + q * q
    flat = F.nullif(steep, F.lit(0.0))
    down, across = p * p * r + 2 * p * q * s + q * q * t, q * q * r - 2 * p * q * s + p * p * t
    mean, half = -(r + t) / 2, F.sqrt(((r - t) / 2) ** 2 + s * s)
    found = {
        "general": -(r + t), "profile": -down / (flat * (1 + steep) ** 1.5), "plan": -across / flat**1.5, "tangential": -across / (flat * F.sqrt(1 + steep)),
        "longitudinal": -down / flat, "cross": -across / flat, "minimal": mean - half, "maximal": mean + half,
        "total": r * r + 2 * s * s + t * t, "rotor": ((p * p - q * q) * s - p * q * (r - t)) / flat**1.5,
    }
    return fit.select("row", "col", *[c.alias(n) for n, c in found.items()])


def mosaic(tiles: Sequence[DataFrame], z: str) -> DataFrame:
    """Overlapping tiles as one grid: the lowest (terrain) and the highest (surface) value of each cell."""
    from .relational import union_fill

    return union_fill(tiles).groupBy("row", "col").agg(F.min(z).alias(f"{z}_min"), F.max(z).alias(f"{z}_max"))


def height_above(surface: DataFrame, ground: DataFrame, z: str) -> DataFrame:
    """Surface less ground, not below 0, where both have the cell."""
    g = ground.select("row", "col", F.col(z).alias("_g"))
    return surface.join(g, ["row", "col"]).select("row", "col", F.greatest(F.col(z) - F.col("_g"), F.lit(0.0)).alias("height"))


def label_sizes(cells: DataFrame, label: str) -> DataFrame:
    return cells.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def size_stats(sizes: DataFrame, n: str = "n", probs: Sequence[float] = (0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1)) -> DataFrame:
    """Labels, quantiles of their sizes, and shares of labels under 2, 5, 10 and 20 cells."""
    found = zip(probs, quantiles(sizes, n, probs), strict=True)
    under = [F.avg(F.when(F.col(n) < t, 1.0).otherwise(0.0)).alias(f"under_{t}") for t in (2, 5, 10, 20)]
    return sizes.agg(F.count(F.lit(1)).alias("labels"), *[F.lit(x).cast("double").alias(f"q{round(100 * p):03d}") for p, x in found], *under)


def mask_small(cells: DataFrame, label: str, least: int) -> DataFrame:
    """Labels of fewer cells than ``least`` become null."""
    big = label_sizes(cells, label).filter(F.col("n") >= least).select(F.col(label).alias("_big"))
    out = cells.join(big, F.col(label) == F.col("_big"), "left")
    return out.withColumn(label, F.col("_big")).drop("_big")


def connected(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """node, component (its smallest node): smallest labels travel along edges and jump, in rounds that are written out."""
    both = saved(edges.select(F.col("a"), F.col("b")).union(edges.select("b", "a")), "edges")
    labels = saved(nodes.select(F.col(node).alias("id"), F.col(node).alias("label")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("_h"))
        near = labels.join(heard, labels["id"] == heard["a"], "left").select("id", F.col("label").alias("_old"), F.least("label", "_h").alias("_near"))
        jump = labels.select(F.col("id").alias("_near"), F.col("label").alias("_far"))
        after = saved(looked_up(near, "_near", jump).select("id", "_old", F.least("_near", "_far").alias("label")), "labels")
        done = after.filter("label <> _old").isEmpty()
        dropped(labels)
        labels = after.select("id", "label")
        if done:
            return labels.select(F.col("id").alias(node), F.col("label").alias("component"))


def _united(size: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each of ``size`` places one place of its part, the same for all of them, where pairs of places hang together."""
    label = np.arange(size)
    while len(one):
        a, b = label[one], label[other]
        apart = a != b
        one, other, a, b = one[apart], other[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def _joined(codes: np.ndarray) -> np.ndarray:
    """For each cell of a tile a cell of its patch, the same one for all of them; codes below 0 stand alone."""
    label = np.arange(codes.size).reshape(codes.shape)
    near = [(np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1], np.s_[1:]), (np.s_[:-1, :-1], np.s_[1:, 1:]), (np.s_[:-1, 1:], np.s_[1:, :-1])]
    same = [(codes[a] == codes[b]) & (codes[a] >= 0) for a, b in near]
    one, other = (np.concatenate([label[s[k]][m] for s, m in zip(near, same, strict=True)]) for k in (0, 1))
    return _united(codes.size, one, other).reshape(codes.shape)


def patches(grid: DataFrame, cls: str, width: int, tile: int = 128) -> DataFrame:
    """Patches of equal class over 8 neighbours: row, col, class, component (the smallest cell number).

    Tiles of ``tile`` cells a side are joined on their own; of their patches only
    those that meet across the tiles' borders are joined in rounds.
    """
    cells = grid.select("row", "col", cls, (F.col("row") * width + F.col("col")).alias("id"))
    # Whole numbers with nulls would lose digits on the way to pandas.
    value = F.col(cls) if dict(cells.dtypes)[cls] in ("float", "double") else F.col(cls).cast("string")
    kind = dict(cells.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = (pdf[c].to_numpy() % tile for c in ("row", "col"))
        codes = np.full((tile, tile), -1)
        codes[i, j] = np.where(pdf["_null"], -1, pd.factorize(pdf["_v"], use_na_sentinel=False)[0])
        own = _joined(codes)[i, j]
        least = np.full(tile * tile, np.iinfo(np.int64).max)
        np.minimum.at(least, own, pdf["id"].to_numpy())
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "_own": least[own]})

    at = cells.select("row", "col", "id", value.alias("_v"), F.isnull(cls).alias("_null"), F.floor(F.col("row") / tile).alias("_ti"), F.floor(F.col("col") / tile).alias("_tj"))
    found = spread(at, 200_000, "_ti", "_tj").groupBy("_ti", "_tj").applyInPandas(one, f"row {kind['row']}, col {kind['col']}, _own long")
    local = saved(cells.join(found.hint("merge"), ["row", "col"]).select("row", "col", cls, "_own"), "patches")
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    border = local.filter(edge("row") | edge("col"))
    ahead = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])
    moved = border.withColumn("_d", F.explode(ahead)).select((F.col("row") + F.col("_d.dr")).alias("row"), (F.col("col") + F.col("_d.dc")).alias("col"), F.col(cls), F.col("_own").alias("a"))
    edges = saved(moved.join(border.withColumnRenamed("_own", "b").hint("merge"), ["row", "col", cls]).filter("a <> b").select("a", "b").distinct(), "patch-edges")
    if edges.isEmpty():
        return local.withColumnRenamed("_own", "component")
    whole = connected(edges, edges.select(F.col("a").alias("_own")).union(edges.select("b")).distinct(), "_own")
    return local.join(whole.hint("merge"), "_own", "left").select("row", "col", cls, F.coalesce("component", "_own").alias("component"))


def merge_small(cells: DataFrame, label: str, z: str, least: int) -> DataFrame:
    """row, col, label, z with segments of fewer cells than ``least`` merged into the neighbour (of four) of the nearest mean, ties to the smaller label.

    Segments are merged in rounds until none that is small has a neighbour; a
    merged segment takes the smallest label of its members.  Rounds work on the
    segments' sums and on what small segments touch: cells are read at the start
    and named anew at the end.
    """
    now = saved(cells.select("row", "col", label, z), "merge")
    value = F.col(z).cast("double")
    stat = saved(now.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"), F.count(value).alias("_k"), F.sum(value).alias("_s")), "merge-sizes")

    def beside(by: str, at: str) -> DataFrame:
        w = Window.partitionBy(by).orderBy(at)
        pairs = now.select(F.col(label).alias("_l"), F.lead(label).over(w).alias("_o"), (F.lead(at).over(w) - F.col(at)).alias("_step"))
        return pairs.filter("_step = 1 and _l <> _o").select("_l", "_o")

    def of_small(pairs: DataFrame, stat: DataFrame) -> DataFrame:
        return saved(pairs.join(stat.filter(F.col("_n") < least), "_l", "left_semi").distinct(), "merge-touching")

    touching = beside("row", "col").unionByName(beside("col", "row"))
    touching, named = of_small(touching.unionByName(touching.select(F.col("_o").alias("_l"), F.col("_l").alias("_o"))), stat), None
    while True:
        mean = lambda at, out: stat.select(F.col("_l").alias(at), (F.col("_s") / F.nullif(F.col("_k"), F.lit(0))).alias(out))  # noqa: E731, B023
        both = touching.join(mean("_l", "_m"), "_l").join(mean("_o", "_om"), "_o")
        pick = both.groupBy("_l").agg(F.min(F.struct(F.abs(F.col("_m") - F.col("_om")).alias("d"), "_o")).alias("_best"))
        edges = saved(pick.select(F.col("_l").alias("a"), F.col("_best._o").alias("b")), "merge-edges")
        if edges.isEmpty():
            break
        to = connected(edges, edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()).filter("id <> component")
        moved = lambda df, at: df.join(to.select(F.col("id").alias(at), "component"), at, "left").withColumn(at, F.coalesce("component", at)).drop("component")  # noqa: E731, B023
        gone = to.select(F.col("id").alias("_l"), F.col("component").alias("_to"))
        named = saved(gone if named is None else moved(named, "_to").select("_l", "_to").unionByName(gone), "merge-named")
        stat = saved(moved(stat, "_l").groupBy("_l").agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"), F.sum("_s").alias("_s")), "merge-sizes")
        touching = of_small(moved(moved(touching, "_l"), "_o").filter("_l <> _o").select("_l", "_o"), stat)
    if named is None:
        return now
    return now.join(named.withColumnRenamed("_l", label), label, "left").select("row", "col", F.coalesce("_to", label).alias(label), z)


def flow_edges(grid: DataFrame, z: str, width: int) -> DataFrame:
    """For each cell the lowest of its 8 neighbours if lower than itself: src, dst (cell numbers)."""
    number = lambda r, c: (F.col("row") + r) * width + F.col("col") + c
    around = [F.struct(F.col("near")[i].alias("v"), number(i // 3 - 1, i % 3 - 1).alias("id")) for i, k in enumerate(NINE) if k != "c"]
    low = F.array_min(F.filter(F.array(*around), lambda x: x["v"].isNotNull()))
    found = nine(grid.select("row", "col", z), z).select(number(0, 0).alias("src"), F.col("near")[NINE.index("c")].alias("_z"), low.alias("_low"))
    return found.filter(F.col("_low.v") < F.col("_z")).select("src", F.col("_low.id").alias("dst"))


def second_difference(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("second_difference", F.lead(value, 2).over(w) - 2 * F.lead(value, 1).over(w) + F.col(value))


def running_median(df: DataFrame, by: Sequence[str], order: str, value: str, half: int) -> DataFrame:
    """Median of 2 half + 1 rows around each row.

    Near an end the window shrinks evenly on both sides.  The first value is the
    median of itself, the second smoothed one, and the line through the second
    and third at the place before the first (Tukey's end rule), the last alike.
    """
    whole = Window.partitionBy(*by).orderBy(order)
    near = F.collect_list(F.col(value).cast("double")).over(whole.rowsBetween(-half, half))
    place, size = F.row_number().over(whole), F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = df.withColumns({"_near": near, "_at": place, "_n": size})
    reach = F.least(F.lit(half), F.col("_at") - 1, F.col("_n") - F.col("_at"))
    first = F.col("_at") - F.greatest(F.lit(1), F.col("_at") - half) - reach + 1
    rows = rows.withColumn("_y", F.element_at(F.sort_array(F.slice("_near", first, 2 * reach + 1)), (reach + 1).cast("int")))
    ahead, behind = (lambda k: F.lead("_y", k).over(whole)), (lambda k: F.lag("_y", k).over(whole))
    end = lambda f: F.element_at(F.sort_array(F.array(F.col("_y"), f(1), 3 * f(1) - 2 * f(2))), 2)
    ruled = F.when((F.col("_at") == 1) & (F.col("_n") > 2), end(ahead)).when((F.col("_at") == F.col("_n")) & (F.col("_n") > 2), end(behind)).otherwise(F.col("_y"))
    return rows.withColumn("running_median", ruled).drop("_near", "_at", "_n", "_y")


def crop(grid: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells of a closed range of rows and columns; both bounds reach the scan."""
    return grid.filter(F.col("row").between(*rows) & F.col("col").between(*cols))


def resample_nearest(grid: DataFrame, z: str, factor: float) -> DataFrame:
    """A grid ``factor`` times as fine (whole) from the cell that holds each new cell's middle."""
    span = F.sequence(F.lit(0), F.lit(int(factor) - 1))
    fine = grid.withColumn("_r", F.explode(span)).withColumn("_c", F.explode(span))
    return fine.select((F.col("row") * int(factor) + F.col("_r")).alias("row"), (F.col("col") * int(factor) + F.col("_c")).alias("col"), z)


def resample_bilinear(grid: DataFrame, z: str, targets: DataFrame) -> DataFrame:
    """Values at fractional places (id, y, x) from the four cells around, by distance; null where one is missing.

    Each place asks for four cells: an equi-join, and one group of four rows.
    """
    corner = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)])
    asked = targets.withColumn("_k", F.explode(corner)).withColumn("_fy", F.col("y") - F.floor("y")).withColumn("_fx", F.col("x") - F.floor("x"))
    share = F.when(F.col("_k.r") == 0, 1 - F.col("_fy")).otherwise(F.col("_fy")) * F.when(F.col("_k.c") == 0, 1 - F.col("_fx")).otherwise(F.col("_fx"))
    asked = asked.select("id", (F.floor("y") + F.col("_k.r")).alias("row"), (F.floor("x") + F.col("_k.c")).alias("col"), share.alias("_w"))
    found = asked.join(grid.select("row", "col", z), ["row", "col"], "left").groupBy("id")
    return found.agg(F.when(F.count(z) == 4, F.sum(F.col("_w") * F.col(z))).alias(z))


def least_cloud(scenes: DataFrame, by: Sequence[str], value: str, cloud: str, key: str) -> DataFrame:
    """For each cell the value of the scene of least cloud (the smallest key of ties)."""
    return scenes.groupBy(*by).agg(F.min_by(value, F.struct(cloud, key)).alias(value), F.min(cloud).alias(cloud))


def _flood(z: np.ndarray, level: np.ndarray, slope: float) -> np.ndarray:
    """Priority flood of one tile with a ring of one cell around it: levels from the seeds, those that are finite.

    A cell's level is at least its height (nan: missing), and a cell that drains
    over a neighbour lies ``slope`` times their distance above that one's level.
    """
    wide = z.shape[1] + 2
    pad = lambda a: np.pad(a, 1, constant_values=np.inf).ravel().tolist()
    # Numbers of plain lists, with a wall around them: no bounds, no single cells of arrays.
    high, out = pad(np.where(np.isnan(z), np.inf, z)), pad(level)
    steps = [(a * wide + b, slope * (1.4142135623730951 if a and b else 1.0)) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    queue = [(out[k], k) for k in np.flatnonzero(np.isfinite(np.pad(level, 1, constant_values=np.inf))).tolist()]
    heapq.heapify(queue)
    push, pop = heapq.heappush, heapq.heappop
    while queue:
        here, k = pop(queue)
        if here > out[k]:
            continue
        for by, rise in steps:
            n = k + by
            old = out[n]
            if old > here:
                up = high[n]
                if up < here + rise:
                    up = here + rise
                if up < old:
                    out[n] = up
                    push(queue, (up, n))
    return np.array(out).reshape(-1, wide)[1:-1, 1:-1]


def fill_sinks(grid: DataFrame, z: str, slope: float = 0.0, tile: int = 128) -> DataFrame:
    """row, col, z, level: the lowest level from which each cell drains over the edge.

    ``slope`` is the least rise for a step of one cell on the way out.  Cells with
    a missing neighbour are the edge, at their own height.  Tiles of ``tile``
    cells a side, each packed with its neighbours' border cells around it, are
    flooded on their own.  Rounds exchange and write the levels of border cells
    alone, and flood only tiles beside which one fell: as many rounds as the ways
    out cross tiles, not cells.  All cells are written out when no level falls.
    """
    kind, side = dict(grid.dtypes), tile + 2
    inside = lambda c: F.pmod(F.col(c), F.lit(tile))
    # A border cell goes to the tiles beside it as well.
    steps = lambda c: F.filter(F.array(F.lit(0), F.when(inside(c) == 0, -1), F.when(inside(c) == tile - 1, 1)), lambda x: x.isNotNull())

    def dealt(df: DataFrame) -> DataFrame:
        """A row for each tile that sees a cell: _ti, _tj, _at (its place there)."""
        both = df.withColumn("_si", F.explode(steps("row"))).withColumn("_sj", F.explode(steps("col")))
        both = both.withColumns({"_ti": F.floor(F.col("row") / tile) + F.col("_si"), "_tj": F.floor(F.col("col") / tile) + F.col("_sj")})
        return both.withColumn("_at", ((F.col("row") - F.col("_ti") * tile + 1) * side + F.col("col") - F.col("_tj") * tile + 1).cast("int"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        at, own = pdf["_at"].to_numpy(), ((pdf["_si"] == 0) & (pdf["_sj"] == 0)).to_numpy()
        if not own.any():
            return pd.DataFrame({"_ti": [], "_tj": [], "_high": [], "_state": []})
        high, state = np.full(side * side, np.nan), np.zeros(side * side, np.uint8)
        high[at], state[at] = pdf["_z"], np.where(pdf["_null"], 2, 1)
        return pd.DataFrame({"_ti": pdf["_ti"].iloc[:1], "_tj": pdf["_tj"].iloc[:1], "_high": [high.tobytes()], "_state": [state.tobytes()]})

    cells = dealt(grid.select("row", "col", F.col(z).cast("double").alias("_z"), F.isnull(F.col(z).cast("double")).alias("_null")))
    tiles = saved(cells.groupBy("_ti", "_tj").applyInPandas(packed, "_ti long, _tj long, _high binary, _state binary"), "fill-tiles")
    many = tiles.count()

    def flooded(pdf: pd.DataFrame, whole: bool) -> pd.DataFrame:
        own = pdf[pdf["_high"].notna()]
        if not len(own):
            return pd.DataFrame({"row": [], "col": [], "_z": [], "level": [], "moved": []})
        high, state = (np.frombuffer(own[c].iloc[0], t).reshape(side, side) for c, t in (("_high", float), ("_state", np.uint8)))
        gap = np.pad(state != 1, 1, constant_values=True)
        edge = np.any([gap[1 + a : side + 1 + a, 1 + b : side + 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        middle = np.zeros((side, side), bool)
        middle[1:-1, 1:-1] = state[1:-1, 1:-1] > 0
        old = np.full((side, side), np.inf)
        heard = pdf[pdf["_high"].isna()]
        old.ravel()[heard["_at"].to_numpy(int)] = heard["level"]
        start = np.where(edge & middle, high, old)
        new = np.where(np.isnan(start), np.nan, _flood(high, np.where(np.isnan(start), np.inf, start), slope))
        if not whole:
            middle[2:-2, 2:-2] = False
            middle &= np.isfinite(new)
        i, j = np.nonzero(middle)
        return pd.DataFrame({"row": i + int(own["_ti"].iloc[0]) * tile - 1, "col": j + int(own["_tj"].iloc[0]) * tile - 1, "_z": high[i, j], "level": new[i, j], "moved": new[i, j] < old[i, j]})

    def run(tiles: DataFrame, heard: DataFrame | None, whole: bool) -> DataFrame:
        told = tiles if heard is None else tiles.unionByName(dealt(heard).select("_ti", "_tj", "_at", "level"), allowMissingColumns=True)
        told = told if heard is not None else told.withColumns({"_at": F.lit(None).cast("int"), "level": F.lit(None).cast("double")})
        schema = f"row {kind['row']}, col {kind['col']}, _z double, level double, moved boolean"
        return told.repartition(min(MOST_TASKS, -(-many // 4) or 1), "_ti", "_tj").groupBy("_ti", "_tj").applyInPandas(lambda pdf: flooded(pdf, whole), schema)

    borders = saved(run(tiles, None, False).drop("_z"), "fill")
    while True:
        woken = dealt(borders.filter("moved")).filter("_si <> 0 or _sj <> 0").select("_ti", "_tj").distinct()
        woken = saved(woken.join(tiles.select("_ti", "_tj"), ["_ti", "_tj"], "left_semi"), "fill-tiles")
        if woken.isEmpty():
            return run(tiles, borders, True).select("row", "col", F.col("_z").alias(z), "level")
        now = run(tiles.join(woken, ["_ti", "_tj"], "left_semi"), borders.drop("moved"), False).drop("_z")
        rest = borders.withColumns({"_ti": F.floor(F.col("row") / tile), "_tj": F.floor(F.col("col") / tile)}).join(woken, ["_ti", "_tj"], "left_anti").select("row", "col", "level")
        after = saved(now.unionByName(rest.withColumn("moved", F.lit(False))), "fill")
        dropped(borders)
        borders = after
