"""Drainage networks and reprojected grids against plain rules."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiq.functions import projection
from stratiq.operators import hydrology as H, relational as R
from stratiq.operators.reproject import Lattice, reproject


def forest(seed, n=300):
    """Each cell flows to one with a larger number, or nowhere."""
    draw = random.Random(seed)
    return {i: draw.randrange(i + 1, min(n, i + draw.choice([2, 5, 60]))) for i in range(n - 1) if draw.random() < 0.95 and i + 1 < n}


def table(spark, to):
    return spark.createDataFrame([(int(a), int(b)) for a, b in to.items()], "src long, dst long").repartition(3)


def orders(to):
    inflow = {}
    for a in sorted({*to, *to.values()}):
        tops = sorted(inflow.get(a, []), reverse=True)
        own = 1 if not tops else tops[0] + (len(tops) > 1 and tops[0] == tops[1])
        inflow[a, "own"] = own
        if a in to:
            inflow.setdefault(to[a], []).append(own)
    return {a: inflow[a, "own"] for a in {*to, *to.values()}}


@pytest.mark.parametrize("hot", [0, 100_000])
def test_forest(spark, monkeypatch, hot):
    monkeypatch.setattr(H, "looked_up", lambda rows, key, ahead: R.looked_up(rows, key, ahead, most=hot))
    to = forest(7)
    e = table(spark, to)
    nodes = {*to, *to.values()}
    mass, end, far = Counter(nodes), {}, {}
    stops = {i for i in nodes if i % 9 == 0}
    for a in sorted(nodes):
        if a in to:
            mass[to[a]] += mass[a]
    for a in sorted(nodes, reverse=True):
        end[a] = end[to[a]] if a in to else a
        far[a] = 0 if a in stops else 1 + far[to[a]] if a in to and far[to[a]] is not None else None
    cells = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    assert {r["id"]: r["accumulation"] for r in H.flow_accumulation(cells, e).collect()} == mass
    assert {r["id"]: r["basin"] for r in H.basins(e).collect()} == end
    got = H.steps_downstream(e, spark.createDataFrame([(i,) for i in stops], "id long")).collect()
    assert {r["id"]: r["steps"] for r in got} == {i: d for i, d in far.items() if d is not None}
    assert {r["id"]: r["strahler"] for r in H.strahler(e).collect()} == orders(to)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(H, "saved", lambda df, name, f=H.saved: rounds.append(name) or f(df, name))
    n = 100_000
    e = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    top = H.flow_accumulation(spark.range(n), e).agg(F.max("accumulation"), F.sum("accumulation")).first()
    assert tuple(top) == (n, n * (n + 1) // 2) and len(rounds) < 40
    rounds.clear()
    assert H.basins(e).filter(f"basin = {n - 1}").count() == n and len(rounds) < 40
    rounds.clear()
    assert H.strahler(e).filter("strahler = 1").count() == n and len(rounds) < 40


def test_orders_take_few_rounds_in_any_shape(spark, monkeypatch):
    """Chains between meetings, combs and a balanced tree: what waits for one inflow is chained, cycles are told."""
    rounds = []
    monkeypatch.setattr(H, "saved", lambda df, name, f=H.saved: rounds.append(name) or f(df, name))
    tree = {i: (i - 1) // 2 for i in range(1, 255)}
    comb = {1000 + i: 1000 + i + 1 for i in range(120)} | {2000 + i: 1000 + i + 1 for i in range(0, 120, 7)} | {3000 + i: 2000 + 7 * i for i in range(5)}
    stretched = {5000 + 4 * i + k: 5000 + 4 * i + k + 1 for i in range(40) for k in range(3)} | {5003 + 4 * i: 5000 + 4 * ((i - 1) // 2) for i in range(1, 40)}
    to = tree | comb | stretched
    e = spark.createDataFrame(list(to.items()), "src long, dst long")

    def order(i):
        above = sorted(order(j) for j, down in to.items() if down == i)
        return (above[-1] + (above[-2:-1] == above[-1:])) if above else 1

    assert {r["id"]: r["strahler"] for r in H.strahler(e).collect()} == {i: order(i) for i in {*to, *to.values()}}
    assert len(rounds) < 40
    with pytest.raises(ValueError, match="cycle"):
        H.strahler(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 1)], "src long, dst long"))


def test_one_way_down(spark):
    with pytest.raises(ValueError, match="more than one"):
        H.basins(spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long"))
    none = spark.createDataFrame([], "src long, dst long")
    assert H.basins(none).count() == 0 and H.strahler(none).count() == 0


def test_metres_to_the_channel(spark):
    """Cells of 10 metres, four in a row: one step aside, then one along the diagonal."""
    e = spark.createDataFrame([(0, 1), (1, 6), (6, 10)], "src long, dst long")
    cells = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    got = {r["id"]: r["distance"] for r in H.overland_distance(e, H.flow_accumulation(cells, e), 3, 4, 10.0).collect()}
    assert got == pytest.approx({0: 10 + 10 * 2**0.5, 1: 10 * 2**0.5, 6: 0, 10: 0})


SOURCE = Lattice(x0=8.9, y0=51.0, dx=0.002, dy=-0.001, rows=60, cols=80)
TARGET = Lattice(x0=493500.0, y0=5649000.0, dx=90.0, dy=-70.0, rows=70, cols=90)


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
def test_reprojection_of_a_plane(spark, method):
    plane = lambda x, y: 3 * x - 7 * y + 1
    rows = [(i, j, plane(SOURCE.x0 + (j + 0.5) * SOURCE.dx, SOURCE.y0 + (i + 0.5) * SOURCE.dy)) for i in range(60) for j in range(80) if (i, j) != (30, 40)]
    grid = spark.createDataFrame(rows, "row long, col long, z double").repartition(3)
    to = lambda x, y: projection.backward(x, y, "32")
    got = reproject(grid, "z", SOURCE, TARGET, to, method)
    x, y = TARGET.middle()
    lon, lat = to("_x", "_y")
    got = got.withColumns({"_x": F.expr(x), "_y": F.expr(y)}).withColumns({"lon": F.expr(lon), "lat": F.expr(lat)}).toPandas()
    assert len(got) == 70 * 90 and not got.duplicated(["row", "col"]).any()
    fy, fx = (got["lat"] - SOURCE.y0) / SOURCE.dy, (got["lon"] - SOURCE.x0) / SOURCE.dx
    shift = 0.5 if method == "bilinear" else 0.0
    i, j = np.floor(fy - shift), np.floor(fx - shift)
    reach = 1 if method == "bilinear" else 0
    inside = (i >= 0) & (i + reach < 60) & (j >= 0) & (j + reach < 80) & ~((i <= 30) & (i + reach >= 30) & (j <= 40) & (j + reach >= 40))
    assert (got["z"].notna() == inside).all() and 0 < inside.mean() < 1
    want = plane(got["lon"], got["lat"]) if reach else plane(SOURCE.x0 + (j + 0.5) * SOURCE.dx, SOURCE.y0 + (i + 0.5) * SOURCE.dy)
    assert np.allclose(got["z"][inside], want[inside], atol=1e-9)


def test_there_and_back(spark):
    """Degrees to metres and back again: the middle of the grid returns."""
    rows = [(i, j, float(np.sin(i / 9) + np.cos(j / 7))) for i in range(60) for j in range(80)]
    grid = spark.createDataFrame(rows, "row long, col long, z double")
    there = reproject(grid, "z", SOURCE, Lattice(x0=492000.0, y0=5651000.0, dx=60.0, dy=-60.0, rows=160, cols=240), lambda x, y: projection.backward(x, y, "32"))
    back = reproject(there, "z", Lattice(x0=492000.0, y0=5651000.0, dx=60.0, dy=-60.0, rows=160, cols=240), SOURCE, lambda x, y: projection.forward(x, y, "32"))
    got = back.join(grid.withColumnRenamed("z", "_z"), ["row", "col"]).filter("row between 5 and 54 and col between 5 and 74").agg(F.count("z"), F.max(F.abs(F.col("z") - F.col("_z")))).first()
    assert got[0] == 50 * 70 and got[1] < 0.02


def test_folder_names_until_distinct(spark):
    df = spark.createDataFrame([(1, "a/x", "data"), (2, "b/x", "data"), (3, "b/y", "data"), (4, "b", "raw"), (5, "c/z", "raw")], "k int, parent string, leaf string")
    assert {r["k"]: r["name"] for r in R.unique_leaves(df, "parent", "leaf").collect()} == {1: "a_x_data", 2: "b_x_data", 3: "y_data", 4: "b_raw", 5: "z_raw"}
