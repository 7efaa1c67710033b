"""Grids, polygons, quantiles and models against plain rules."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiq.functions import projection
from stratiq.operators import hydrology, models as M, polygons as P, raster, relational as R, stats


def grid(spark, values, gaps=()):
    rows = [(i, j, float(v)) for i, line in enumerate(values) for j, v in enumerate(line) if (i, j) not in gaps]
    return spark.createDataFrame(rows, "row long, col long, z double").repartition(3)


def test_quantiles_of_any_distribution(spark):
    draw = np.random.default_rng(0)
    values = [*draw.integers(0, 9, 200).tolist(), *draw.normal(size=301).tolist(), 7.5]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    probs = [0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1]
    assert R.quantiles(df, "v", probs) == pytest.approx(np.quantile(values, probs).tolist())
    assert R.quantiles(df.filter("v > 99"), "v", [0.5]) == [None] and R.quantiles(df.filter("v = 7.5"), "v", [0.2, 1]) == [7.5, 7.5]


@pytest.mark.parametrize("radius", [1, 3])
def test_focal_means_on_a_grid_with_gaps(spark, radius):
    draw = np.random.default_rng(1)
    values, gaps = draw.integers(0, 99, (9, 11)), {(0, 0), (4, 4), (4, 5), (4, 6), (8, 10), (2, 0), (3, 0)} | {(6, j) for j in range(11)}
    got = {(r["row"], r["col"]): r["focal_mean"] for r in raster.focal_deviation(grid(spark, values, gaps), "z", radius).collect()}
    for (i, j), mean in got.items():
        near = [values[a, b] for a in range(max(0, i - radius), min(9, i + radius + 1)) for b in range(max(0, j - radius), min(11, j + radius + 1)) if (a, b) not in gaps]
        assert mean == pytest.approx(np.mean(near))
    assert len(got) == 99 - len(gaps)


def test_curvatures_of_a_known_surface(spark):
    f = lambda x, y: 0.3 * x + 0.1 * y + 0.02 * x * x - 0.05 * y * y + 0.04 * x * y
    values = [[f(j, -i) for j in range(7)] for i in range(6)]  # rows run south
    for r in raster.curvatures(grid(spark, values), "z", 1.0).collect():
        x, y = r["col"], -r["row"]
        p, q, zxx, zyy, zxy = 0.3 + 0.04 * x + 0.04 * y, 0.1 - 0.1 * y + 0.04 * x, 0.04, -0.1, 0.04
        g = p * p + q * q
        assert r["general"] == pytest.approx(-(zxx + zyy)) and r["total"] == pytest.approx(zxx**2 + 2 * zxy**2 + zyy**2)
        assert r["profile"] == pytest.approx(-(p * p * zxx + 2 * p * q * zxy + q * q * zyy) / (g * (1 + g) ** 1.5))
        assert r["maximal"] + r["minimal"] == pytest.approx(-(zxx + zyy)) and r["maximal"] >= r["minimal"]
    flat = raster.curvatures(grid(spark, np.ones((3, 3))), "z", 1.0).first()
    assert flat["profile"] is None and flat["general"] == 0


@pytest.mark.parametrize("slope", [0.0, 0.7])
def test_sinks_over_tiles_equal_relaxation(spark, slope):
    draw = np.random.default_rng(2)
    z = draw.integers(0, 60, (13, 17)).astype(float)
    z[3:9, 4:12] = draw.integers(0, 9, (6, 8))
    z[6, 2:14] = [70, 1, 2, 3, 2, 1, 0, 1, 2, 3, 2, 80]
    level = np.full(z.shape, np.inf)
    level[[0, -1], :], level[:, [0, -1]] = z[[0, -1], :], z[:, [0, -1]]
    while True:
        new = level.copy()
        for i in range(1, 12):
            for j in range(1, 16):
                ways = [level[i + a, j + b] + slope * math.hypot(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
                new[i, j] = min(level[i, j], max(z[i, j], min(ways)))
        if (new == level).all():
            break
        level = new
    got = raster.fill_sinks(grid(spark, z), "z", slope, tile=5).collect()
    assert len(got) == z.size and all(r["level"] == pytest.approx(level[r["row"], r["col"]]) for r in got)


def test_components_equal_union_find(spark):
    draw = np.random.default_rng(3)
    lab = draw.integers(0, 3, (14, 12))
    parent = list(range(lab.size))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(14):
        for j in range(12):
            for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)):
                if i + a < 14 and 0 <= j + b < 12 and lab[i, j] == lab[i + a, j + b]:
                    x, y = sorted((root(i * 12 + j), root((i + a) * 12 + j + b)))
                    parent[y] = x
    got = raster.patches(grid(spark, lab), "z", 12).collect()
    assert len(got) == lab.size and all(r["component"] == root(r["row"] * 12 + r["col"]) for r in got)


def test_networks_with_cycles_are_refused(spark):
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    for f in (hydrology.strahler, hydrology.basins, lambda e: hydrology.flow_accumulation(e.select(F.col("src").alias("id")), e)):
        with pytest.raises(ValueError, match="cycle"):
            f(loop)


def test_median_ends_follow_the_rule(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([9.0, 1.0, 5.0, 2.0, 8.0, 0.0])], "g int, i int, v double")
    got = [r["running_median"] for r in raster.running_median(df, ["g"], "i", "v", 1).orderBy("i").collect()]
    inner = [5.0, 2.0, 5.0, 2.0]
    assert got == [sorted([9.0, inner[0], 3 * inner[0] - 2 * inner[1]])[1], *inner, sorted([0.0, inner[3], 3 * inner[3] - 2 * inner[2]])[1]]


def test_outlines_of_labels(spark):
    """A block with a hole, and two cells that touch in a corner."""
    rows = [(i, j, "a") for i in range(3) for j in range(3) if (i, j) != (1, 1)] + [(1, 1, "b"), (5, 5, "c"), (6, 6, "c")]
    corners = P.polygonise(spark.createDataFrame(rows, "row long, col long, lab string"), "lab", 10)
    rings = [(r["label"], [(p["x"], p["y"]) for p in r["points"]]) for r in P.collected(corners).collect()]
    turned = lambda ring: min(tuple(ring[i:] + ring[:i]) for i in range(len(ring)))
    assert sorted((k, turned(ring)) for k, ring in rings) == [
        ("a", ((0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0))), ("a", ((1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0))), ("b", ((1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0))),
        ("c", ((5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 6.0))), ("c", ((6.0, 6.0), (7.0, 6.0), (7.0, 7.0), (6.0, 7.0))),
    ]


def test_outlines_cover_their_cells(spark):
    draw = np.random.default_rng(4)
    lab = draw.integers(0, 2, (9, 10))
    rows = [(i, j, int(lab[i, j])) for i in range(9) for j in range(10)]
    rings = P.collected(P.polygonise(spark.createDataFrame(rows, "row long, col long, lab int"), "lab", 10)).select("label", P.signed_area(F.col("points")).alias("a"), P.is_valid(F.col("points")).alias("ok")).collect()
    for k in (0, 1):
        assert sum(r["a"] for r in rings if r["label"] == k) == (lab == k).sum()


def test_rings(spark):
    ring = lambda *p: F.array(*[P.point(F.lit(float(x)), F.lit(float(y))) for x, y in p])
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    ell = ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4))
    assert one(P.signed_area(ell)) == 7 and one(P.is_valid(ell)) and not one(P.is_valid(ring((0, 0), (2, 2), (2, 0), (0, 2))))
    assert tuple(one(P.centroid(ell))) == pytest.approx(((4 * 2 + 3 * 0.5) / 7, (4 * 0.5 + 3 * 2.5) / 7))
    assert one(P.signed_area(P.clip(ell, 0.5, 0.5, 9.0, 9.0))) == pytest.approx(3.5 * 0.5 + 0.5 * 3)
    assert one(F.size(P.clip(ell, 5.0, 5.0, 9.0, 9.0))) == 0
    # In the box of the corner shape, but across its inner corner.
    assert not one(P.within(ring((0.5, 0.5), (3.5, 0.5), (0.5, 3.5)), ell)) and one(P.within(ring((0.1, 0.1), (0.9, 0.1), (0.9, 3.5)), ell))
    assert one(P.signed_area(P.made_valid(ring((0, 0), (2, 2), (2, 0), (0, 2))))) == 4 and one(P.made_valid(ring((0, 0), (1, 1)))) is None


def test_transverse_mercator(spark):
    """On the central meridian the northing is the scaled length of the meridian; and the inverse leads back."""
    a, f = projection.AXIS, projection.FLATTENING
    e2 = f * (2 - f)
    lat = np.radians(np.linspace(0, 51, 200_001))
    length = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5, lat)
    df = spark.createDataFrame([(9.0, 51.0), (6.1, 47.3), (11.9, 54.9)], "lon double, lat double")
    east, north = projection.forward("lon", "lat", "32")
    out = df.withColumn("e", F.expr(east)).withColumn("n", F.expr(north))
    lon2, lat2 = projection.backward("e", "n", "32")
    rows = out.withColumn("lon2", F.expr(lon2)).withColumn("lat2", F.expr(lat2)).collect()
    assert rows[0]["e"] == pytest.approx(500000) and rows[0]["n"] == pytest.approx(0.9996 * length, abs=1e-3)
    assert all(r["lon2"] == pytest.approx(r["lon"], abs=2e-8) and r["lat2"] == pytest.approx(r["lat"], abs=2e-8) for r in rows)


def test_ward_equals_the_plain_method(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(40, 2)) + draw.integers(0, 4, (40, 1)) * 3
    clusters = [[i] for i in range(40)]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
    while len(clusters) > 5:
        _, i, j = min((cost(a, b), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        clusters[i] += clusters.pop(j)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    got = {}
    for r in M.ward(df, "id", ["a", "b"], 5).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, clusters))
    assert M.ward(df, "id", ["a", "b"], 5, centres=20).select("cluster").distinct().count() == 5


def test_hopkins_tells_clusters_from_noise(spark):
    draw = random.Random(6)
    noise = [(i, draw.random(), draw.random()) for i in range(600)]
    tight = [(i, (i % 3) * 0.4 + draw.random() * 0.02, (i % 2) * 0.9 + draw.random() * 0.02) for i in range(600)]
    found = [M.hopkins(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"]).first()[0] for rows in (noise, tight)]
    assert 0.35 < found[0] < 0.65 and found[1] > 0.9


def test_forest_and_blocks(spark):
    draw = random.Random(7)
    rows = [(i, draw.random(), draw.random(), draw.random(), float(i % 20), float(i // 20)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, x double, y double").withColumn("cls", F.when((F.col("a") > 0.5) != (F.col("b") > 0.5), "one").otherwise("two"))
    folded = M.spatial_folds(df, "x", "y", 2).cache()
    assert {r[0] for r in folded.select("fold").distinct().collect()} == {1, 2}
    assert M.block_kappa(folded, "id", "cls", ["a", "b"], "fold", [1, 2], trees=10) > 0.7 > M.block_kappa(folded, "id", "cls", ["c"], "fold", [1, 2], trees=5, mtry=1)
    chosen, kappa = M.forward_selection(folded, "id", "cls", ["a", "b", "c"], "fold", [1, 2], trees=10)
    assert {"a", "b"} <= set(chosen) and kappa > 0.7


def test_boundary_rises_as_the_level_falls():
    found = [M.mosum_boundary(level) for level in (0.1, 0.05, 0.01)]
    assert 0.5 < found[0] < found[1] < found[2] < 3


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert R.contracted(df, ["k", "v"], ["k", "v"]) is df
    for args in ((["x"],), (["k"], ["k"])):
        with pytest.raises(ValueError):
            R.contracted(df, *args)
    with pytest.raises(ValueError, match="no rows"):
        R.contracted(df.limit(0), ["k"])


def test_spaced_sample(spark):
    rows = [(i, "p" if i % 2 else "q", float(i % 10), float(i // 10)) for i in range(100)] + [(100, None, 1.0, 1.0), (101, "p", None, 1.0)]
    got = R.stratified_spaced(spark.createDataFrame(rows, "id long, g string, x double, y double"), "g", 4, F.xxhash64("id"), "id", 1.5).collect()
    assert sorted(r["g"] for r in got) == ["p"] * 4 + ["q"] * 4
    assert all(math.hypot(a["x"] - b["x"], a["y"] - b["y"]) > 1.5 for a in got for b in got if a["id"] < b["id"])


def test_linear_combinations(spark):
    draw = random.Random(8)
    rows = [(a := draw.random(), b := draw.random(), a - 2 * b + 1, draw.random(), 4.0) for _ in range(50)]
    assert stats.linear_combinations(spark.createDataFrame(rows, "a double, b double, c double, d double, e double"), list("abcde")) == ["c", "e"]


def test_small_segments_merge(spark):
    """0 and 9 are large; the 1s and 2s are small: 1 joins 0 with 2, 8 joins 9, and a lone island stays."""
    z = [[0, 0, 1, 9, 9], [0, 0, 2, 9, 9], [0, 0, 8, 9, 9]]
    names = {0: 0, 1: 10, 2: 20, 8: 30, 9: 40}
    rows = [(i, j, names[v], float(v)) for i, line in enumerate(z) for j, v in enumerate(line)] + [(9, 9, 50, 5.0)]
    got = raster.merge_small(spark.createDataFrame(rows, "row long, col long, s long, z double"), "s", "z", 3)
    want = {(i, j): 40 if v in (8, 9) else 0 for i, line in enumerate(z) for j, v in enumerate(line)} | {(9, 9): 50}
    # 8 is merged into 9 under the smaller of both labels.
    assert {(r["row"], r["col"]): r["s"] for r in got.collect()} == {at: 30 if s == 40 else s for at, s in want.items()}


def test_best_k_needs_a_stability(spark):
    columns = "k int, silhouette double, ch double, db double, wss double, stability double, score double"
    nan = float("nan")
    rows = [(2, 0.9, 9.0, 0.1, 1.0, nan, nan), (3, 0.1, 1.0, 0.9, 1.0, 0.5, -1.0), (4, 0.2, 1.0, 0.9, 1.0, 0.6, 1.0)]
    assert M.best_k(spark.createDataFrame(rows, columns)) == 4
    assert M.best_k(spark.createDataFrame([(*r[:5], nan, nan) for r in rows], columns)) == 2


def test_applicability_by_hand(spark):
    train = spark.createDataFrame([(i, float(x), "a" if i < 3 else "b") for i, x in enumerate([0, 1, 2, 10, 11])], "id long, x double, y string")
    new = spark.createDataFrame([(100, 1.5), (101, 30.0)], "id long, x double")
    mean = np.mean([abs(a - b) for a in (0, 1, 2, 10, 11) for b in (0, 1, 2, 10, 11) if a != b])
    for w in (1.0, 5.0):
        near, far = stats.applicability(new, train, "id", ["x"], {"x": w}, label="y").orderBy("id").collect()
        assert near["di"] == pytest.approx(0.5 / mean, abs=1e-8) and (near["lpd"], near["inside"], near["near_label"]) == (2, True, "a")
        assert far["di"] == pytest.approx(19 / mean, abs=1e-8) and (far["lpd"], far["inside"], far["near_label"]) == (0, False, "b")


def test_perturbations_keep_their_floors(spark):
    got = [tuple(r) for r in stats.perturbations(spark.createDataFrame([(1, 2, 0.01, 4)], 's int, spatialr int, ranger double, minsize int'), 's', most=99).drop('s').collect()]
    assert {s for s, _, _ in got} == {2} and len(got) == 8 and {r for _, r, _ in got} == {0.005, 0.01, 0.015} and {m for _, _, m in got} == {3, 4, 9}


def test_outlines_across_tiles(spark, monkeypatch):
    """Rings that cross tiles of any size are the same, null is a label of its own, and rounds see pieces of rings, not sides."""
    draw = np.random.default_rng(11)
    rows = [(i, j, [None, "a", "b"][int(k)]) for (i, j), k in np.ndenumerate(draw.choice(3, (23, 17), p=[0.2, 0.5, 0.3])) if (i * 17 + j) % 29]
    grid = spark.createDataFrame(rows, "row int, col long, lab string")
    seen, saved = [], P.saved
    monkeypatch.setattr(P, "saved", lambda df, name: seen.append((name, saved(df, name))) or seen[-1][1])
    outlines = lambda tile: sorted(((str(r["label"]), r["ring"], r["seq"], r["x"], r["y"]) for r in P.polygonise(grid, "lab", 17, tile).collect()))
    whole = outlines(128)
    assert all(df.isEmpty() for name, df in seen if name in ("links", "ranks"))
    for tile in (4, 7):
        assert outlines(tile) == whole
    # All sides towards another label or a missing cell, each once.
    at = {(i, j): k for i, j, k in rows}
    sides = sum((i + a, j + b) not in at or at[i + a, j + b] != k for (i, j), k in at.items() for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))
    rings = [[(p["x"], p["y"]) for p in r["points"]] for r in P.collected(P.polygonise(grid, "lab", 17, 4)).collect()]
    assert sum(abs(a - c) + abs(b - d) for ring in rings for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True)) == sides
