"""Mean shift segmentation: every cell climbs to its mode in place and value, cells of one mode that touch form a segment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiq.sources.scratch import saved

from .raster import _united, connected, merge_small


def climb(z: np.ndarray, rows: np.ndarray, cols: np.ndarray, radius: float, reach: float, tolerance: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Modes (row, column, value) of the cells asked, and whether they were found within the array.

    A mode moves to the mean of the cells within ``radius`` of its place whose value
    is within ``reach`` of its own, until a step is shorter than ``tolerance``, in
    units of both, or for ``rounds`` steps.  Missing cells are nan.
    """
    k = math.ceil(radius + 0.5)
    y, x, v = rows.astype(float), cols.astype(float), z[rows, cols].astype(float)
    found, active = np.ones(len(rows), bool), np.arange(len(rows))
    for _ in range(rounds):
        i, j = np.rint(y[active]).astype(int), np.rint(x[active]).astype(int)
        inside = (i >= k) & (i + k < z.shape[0]) & (j >= k) & (j + k < z.shape[1])
        found[active[~inside]] = False
        active, i, j = active[inside], i[inside], j[inside]
        if not len(active):
            break
        fy, fx, own = y[active] - i, x[active] - j, v[active]
        n, sy, sx, sv = np.zeros((4, len(active)))
        for a in range(-k, k + 1):
            for b in range(-k, k + 1):
                value = z[i + a, j + b]
                near = ((a - fy) ** 2 + (b - fx) ** 2 <= radius**2) & (np.abs(value - own) <= reach)
                n += near
                sy += a * near
                sx += b * near
                sv += np.where(near, value, 0.0)
        some = n > 0
        ny, nx, nv = (np.where(some, s / np.maximum(n, 1), old) for s, old in ((sy, fy), (sx, fx), (sv, own)))
        step = np.sqrt(((ny - fy) ** 2 + (nx - fx) ** 2) / radius**2 + ((nv - own) / reach) ** 2)
        y[active], x[active], v[active] = i + ny, j + nx, nv
        active = active[step >= tolerance]
    return y, x, v, found


def modes(grid: DataFrame, z: str, radius: float, reach: float, tolerance: float = 0.01, rounds: int = 100, tile: int = 128) -> DataFrame:
    """row, col, mode_row, mode_col, mode: where each cell that has a value climbs to.

    Tiles of ``tile`` cells a side run on their own, with a margin of their
    neighbours' cells.  Tiles from which a cell climbs out of the margin run again with
    one twice as wide: the result is that of the whole grid, whatever the tile.
    """
    cells = saved(grid.select("row", "col", F.col(z).cast("double").alias("_z")).filter("_z is not null and not isnan(_z)"), "shift-cells")
    kind = dict(cells.dtypes)
    schema = f"row {kind['row']}, col {kind['col']}, mode_row double, mode_col double, mode double, _ti long, _tj long, _found boolean"

    def run(margin: int, tiles: DataFrame | None) -> DataFrame:
        span = lambda c: F.sequence(F.floor((F.col(c) - margin) / tile), F.floor((F.col(c) + margin) / tile))
        spread = cells.withColumn("_ti", F.explode(span("row"))).withColumn("_tj", F.explode(span("col")))
        if tiles is not None:
            spread = spread.join(tiles, ["_ti", "_tj"], "left_semi")

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            ti, tj = int(pdf["_ti"].iloc[0]), int(pdf["_tj"].iloc[0])
            i, j = pdf["row"].to_numpy() - ti * tile + margin, pdf["col"].to_numpy() - tj * tile + margin
            array = np.full((tile + 2 * margin, tile + 2 * margin), np.nan)
            array[i, j] = pdf["_z"]
            own = (i >= margin) & (i < margin + tile) & (j >= margin) & (j < margin + tile)
            y, x, v, found = climb(array, i[own], j[own], radius, reach, tolerance, rounds)
            return pd.DataFrame({"row": pdf["row"][own], "col": pdf["col"][own], "mode_row": y + ti * tile - margin, "mode_col": x + tj * tile - margin, "mode": v, "_ti": ti, "_tj": tj, "_found": found})

        return saved(spread.groupBy("_ti", "_tj").applyInPandas(one, schema), "shift")

    margin = 4 * math.ceil(radius + 0.5)
    now, out = run(margin, None), None
    while True:
        open_ = saved(now.filter("not _found").select("_ti", "_tj").distinct(), "shift-open")
        closed = now.join(open_, ["_ti", "_tj"], "left_anti").drop("_ti", "_tj", "_found")
        out = closed if out is None else out.unionByName(closed)
        if open_.isEmpty():
            return out
        margin *= 2
        now = run(margin, open_)


def mean_shift(grid: DataFrame, z: str, radius: float, reach: float, width: int, minsize: int = 1, tolerance: float = 0.01, rounds: int = 100, tile: int = 128) -> DataFrame:
    """row, col, mode, segment: neighbours (of four) whose modes are within ``radius`` and ``reach`` of each other are one segment.

    A segment's name is its smallest cell number, row * width + col.  Segments of
    fewer cells than ``minsize`` are merged into the neighbour of the nearest mean mode.
    """
    found = modes(grid, z, radius, reach, tolerance, rounds, tile).withColumn("id", (F.col("row") * width + F.col("col")).cast("long"))
    kind = dict(found.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = (pdf[c].to_numpy() % tile for c in ("row", "col"))
        y, x, v = (np.full((tile, tile), np.nan) for _ in range(3))
        y[i, j], x[i, j], v[i, j] = pdf["mode_row"], pdf["mode_col"], pdf["mode"]
        label, one, other = np.arange(tile * tile).reshape(tile, tile), [], []
        for a, b in ((np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1], np.s_[1:])):
            near = ((y[a] - y[b]) ** 2 + (x[a] - x[b]) ** 2 <= radius**2) & (np.abs(v[a] - v[b]) <= reach)
            one.append(label[a][near])
            other.append(label[b][near])
        own = _united(tile * tile, np.concatenate(one), np.concatenate(other)).reshape(tile, tile)[i, j]
        least = np.full(tile * tile, np.iinfo(np.int64).max)
        np.minimum.at(least, own, pdf["id"].to_numpy())
        edge = (i == 0) | (i == tile - 1) | (j == 0) | (j == tile - 1)
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "mode": pdf["mode"], "_own": least[own], "_y": np.where(edge, pdf["mode_row"], np.nan), "_x": np.where(edge, pdf["mode_col"], np.nan)})

    at = found.withColumn("_ti", F.floor(F.col("row") / tile)).withColumn("_tj", F.floor(F.col("col") / tile))
    local = saved(at.groupBy("_ti", "_tj").applyInPandas(one, f"row {kind['row']}, col {kind['col']}, mode double, _own long, _y double, _x double"), "shift-parts")
    # Segments that meet across the borders of tiles are joined in rounds.
    border = local.filter("_y is not null")
    other = border.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("_own").alias("b"), F.col("_y").alias("_oy"), F.col("_x").alias("_ox"), F.col("mode").alias("_ov"))
    ahead = F.explode(F.array(F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")), F.struct(F.lit(1).alias("r"), F.lit(0).alias("c"))))
    pairs = border.withColumn("_d", ahead).withColumns({"_r": F.col("row") + F.col("_d.r"), "_c": F.col("col") + F.col("_d.c")}).join(other, ["_r", "_c"])
    apart = (F.col("_y") - F.col("_oy")) ** 2 + (F.col("_x") - F.col("_ox")) ** 2
    edges = saved(pairs.filter((apart <= radius**2) & (F.abs(F.col("mode") - F.col("_ov")) <= reach) & (F.col("_own") != F.col("b"))).select(F.col("_own").alias("a"), "b").distinct(), "shift-edges")
    named = local.select("row", "col", "mode", F.col("_own").alias("segment"))
    if not edges.isEmpty():
        whole = connected(edges, edges.select(F.col("a").alias("_own")).union(edges.select("b")).distinct(), "_own")
        named = local.join(whole, "_own", "left").select("row", "col", "mode", F.coalesce("component", "_own").alias("segment"))
    if minsize <= 1:
        return named
    merged = merge_small(named, "segment", "mode", minsize)
    return merged.select("row", "col", "mode", "segment")
