"""Areas with holes, their overlay and their coverage of cells against plain rules."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiq.operators import areas as A, overlay
from stratiq.sources import features

KIND = f"id long, area {A.AREA}"


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def inside(rings, x, y):
    out = np.zeros(np.shape(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if ay != by:
                out ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return out


def star(draw, n, x, y, r):
    """A ring without crossings around a point that is well inside."""
    turns = [2 * np.pi * (k + draw.uniform(-0.3, 0.3)) / n for k in range(n)]
    return [(x + draw.uniform(0.3, 1) * r * np.cos(t), y + draw.uniform(0.3, 1) * r * np.sin(t)) for t in turns]


def shapes(seed, n=25):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = draw.uniform(2, 8), draw.uniform(2, 8)
        ring = star(draw, draw.randrange(5, 11), x, y, 3)
        hole = [(x + 0.1 * (a - x), y + 0.1 * (b - y)) for a, b in ring]
        out.append([ring, hole[:: draw.choice([1, -1])]] if draw.random() < 0.5 else [ring])
    return out


def frame(spark, rings):
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in a] if a is not None else None) for i, a in enumerate(rings)], KIND)


def plain(area):
    return [[(p["x"], p["y"]) for p in r] for r in area]


def test_overlay_equals_points():
    draw = random.Random(4)
    x, y = (v.ravel() for v in np.meshgrid(np.linspace(0, 10, 301) + 0.00137, np.linspace(0, 10, 301) + 0.00071))
    for k in range(60):
        groups = [[[(draw.uniform(0, 10), draw.uniform(0, 10)) if k % 2 else (draw.randrange(11), draw.randrange(11)) for _ in range(draw.randrange(3, 8))] for _ in range(draw.randrange(1, 3))] for _ in range(2)]
        for rule in (lambda a, b: a & b, lambda a, b: a & ~b):
            got = overlay.traced(groups, rule)
            want = rule(*(inside(g, x, y) for g in groups))
            assert (inside(got, x, y) == want).all()
            assert sum(map(shoelace, got)) == pytest.approx(100 * want.mean(), abs=0.7)
            assert all(len(set(r)) == len(r) for r in got if k % 2)


def test_overlay_of_known_shapes(spark):
    u = [[(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9)]]
    strip, far, bow = [[(-1, 5), (10, 5), (10, 7), (-1, 7)]], [[(20, 20), (21, 20), (21, 21)]], [[(0, 0), (2, 2), (2, 0), (0, 2)]]
    row = spark.createDataFrame([tuple([[{"x": float(x), "y": float(y)} for x, y in r] for r in a] for a in (u, strip, far, bow))], f"u {A.AREA}, strip {A.AREA}, far {A.AREA}, bow {A.AREA}")
    got = row.select(
        overlay.intersection(F.col("u"), F.col("strip")).alias("two"), overlay.intersection(F.col("u"), F.col("far")).alias("none"), overlay.difference(F.col("u"), F.col("strip")).alias("three"),
        overlay.made_valid(F.col("bow")).alias("ties"), overlay.intersection(F.col("u"), F.lit(None).cast(A.AREA)).alias("null"),
    ).first()
    assert sorted(map(shoelace, plain(got["two"]))) == [6, 6] and all(len(r) == 4 for r in got["two"])  # two rings, no false edge between them
    assert got["none"] == [] and got["null"] is None and sorted(map(shoelace, plain(got["three"]))) == [6, 6, 39]
    assert sorted(map(shoelace, plain(got["ties"]))) == [1, 1]


def test_measures_of_rings_in_any_direction(spark):
    rings = shapes(1) + [[], None, [[(0, 0), (1, 1)]], [[(0, 0), (4, 0), (4, 4), (0, 4)], [(10, 0), (11, 0), (11, 1), (10, 1)], [(1, 1), (2, 1), (2, 2), (1, 2)]]]
    out = {r["id"]: r for r in frame(spark, rings).select("id", A.measure(F.col("area")).alias("m"), A.centroid(F.col("area")).alias("c"), A.contains(F.col("area"), F.lit(1.5), F.lit(1.5)).alias("has")).collect()}
    for i, a in enumerate(shapes(1)):
        assert out[i]["m"] == pytest.approx(abs(shoelace(a[0])) - sum(abs(shoelace(r)) for r in a[1:]))
    assert out[25]["m"] == 0 and out[25]["c"] is None and out[26]["m"] is None and out[27]["m"] == 0 and out[28]["m"] == 16 and not out[28]["has"]
    assert (out[28]["c"]["x"], out[28]["c"]["y"]) == pytest.approx(((32 - 1.5 + 10.5) / 16, (32 - 1.5 + 0.5) / 16))


@pytest.mark.parametrize("size", [0.7, 4.0])
def test_join_of_areas(spark, size):
    one, two = shapes(2), shapes(3) + [[[(50, 50), (51, 50), (51, 51)]], None]
    a, b = frame(spark, one), frame(spark, two).withColumnsRenamed({"id": "other", "area": "their"})
    meet = {(i, j) for i, p in enumerate(one) for j, q in enumerate(two) if q and sum(map(shoelace, overlay.traced([p, q], lambda x, y: x & y))) > 0}
    got = [(r["id"], r["other"]) for r in A.join_areas(a, b, "area", "their", size).collect()]
    assert len(got) == len(set(got)) and set(got) == meet
    left = [(r["other"], r["id"]) for r in A.join_areas_left(b, a, "other", "their", "area", size).collect()]
    assert len(left) == len(meet) + len({j for j in range(len(two))} - {j for _, j in meet}) and (len(two) - 1, None) in left
    covered = {(i, j) for i, p in enumerate(one) for j, q in enumerate(two) if q and not overlay.traced([p, q], lambda x, y: x & ~y)}
    assert {(r["id"], r["other"]) for r in A.join_areas(a, b, "area", "their", size, A.within).collect()} == covered


def test_touching_areas_meet(spark):
    box = lambda x, y: [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]]
    a, b = frame(spark, [box(0, 0)]), frame(spark, [box(1, 0), box(1, 1), box(1.01, 0), box(0.25, 0.25)]).withColumnsRenamed({"id": "other", "area": "their"})
    assert {r["other"] for r in A.join_areas(a, b, "area", "their", 0.5).collect()} == {0, 1, 3}


@pytest.mark.parametrize("size", [0.5, 1.0, 30.0])
def test_coverage_sums_to_the_area(spark, size):
    rings = shapes(5) + [[[(0.5, 0.5), (3.5, 0.5), (3.5, 2.0), (0.5, 2.0)]], [[(-3.2, -1.1), (-1, -1), (-2, 2.5)]]]
    df = frame(spark, rings)
    got = {}
    for r in A.coverage(df, "id", "area", size).collect():
        assert (r["id"], r["row"], r["col"]) not in got and 0 < r["fraction"] <= 1
        got[r["id"], r["row"], r["col"]] = r["fraction"]
    for i, a in enumerate(rings):
        want = abs(shoelace(a[0])) - sum(abs(shoelace(r)) for r in a[1:])
        assert sum(f for (k, *_), f in got.items() if k == i) * size * size == pytest.approx(want)
        for (k, row, col), f in list(got.items())[::7]:
            if k == i:
                cell = [[(col * size, row * size), ((col + 1) * size, row * size), ((col + 1) * size, (row + 1) * size), (col * size, (row + 1) * size)]]
                assert f * size * size == pytest.approx(sum(map(shoelace, overlay.traced([a, cell], lambda x, y: x & y))), abs=1e-6)
    touched = {(r["id"], r["row"], r["col"]) for r in A.rasterise(df, "id", "area", size, touches=True).collect()}
    middles = {(r["id"], r["row"], r["col"]) for r in A.rasterise(df, "id", "area", size).collect()}
    assert set(got) <= touched and middles <= touched
    for i, a in enumerate(rings):
        rows, cols = np.meshgrid(np.arange(-10, 24), np.arange(-10, 24), indexing="ij")
        held = inside(a, (cols + 0.5) * size, (rows + 0.5) * size)
        assert {(r, c) for k, r, c in middles if k == i} == set(zip(rows[held].tolist(), cols[held].tolist(), strict=True))


def test_holes_of_features_are_kept(spark):
    rings = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (4, 2), (4, 4), (2, 4)], [(8, 8), (9, 8), (9, 9), (8, 9)]]
    stored = frame(spark, [rings]).select("id", features.to_wkb(F.col("area")).alias("geometry"), F.create_map(F.lit("landuse"), F.lit("wood")).alias("tags"))
    out = features.features_by_key(features.read_features(stored), ("landuse",), (0.0, 0.0, 3.0, 10.0)).first()
    assert abs(shoelace(plain([out["ring"]])[0])) == 30 and [abs(shoelace(r)) for r in plain(out["holes"])] == [2]
