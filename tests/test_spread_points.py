"""Thinning and nearest neighbours without a table of all pairs."""

import math
import random

from stratiq.operators import geometry as G

NAN = float("nan")


def drawn(n, places):
    draw = random.Random(3)
    spots = [(draw.random() * 100, draw.random() * 100) for _ in range(places)]
    return [(i, *draw.choice(spots)) for i in draw.sample(range(10 * n), n)]


def test_thinning_makes_no_pairs(spark, monkeypatch):
    rows = drawn(600, 150)
    kept = []
    for r in sorted(rows):
        if all(math.sqrt((r[1] - k[1]) ** 2 + (r[2] - k[2]) ** 2) > 12 for k in kept):
            kept.append(r)
    monkeypatch.setattr(G, "within_distance", None)
    df = spark.createDataFrame([*rows, (-1, None, 1.0), (-2, NAN, 1.0)], "id long, x double, y double")
    got = G.thin(df, "id", ["id"], 12.0)
    assert got.columns == ["id", "x", "y"] and sorted(r["id"] for r in got.collect()) == [-2, -1, *[k[0] for k in kept]]


def test_nearest_makes_no_pairs(spark, monkeypatch):
    rows = [*drawn(60, 40), *[(10_000 + i, 300 + i / 1000, 300.0) for i in range(200)], (20_000, 304.0, 300.0), (20_001, 900.0, 900.0)]
    monkeypatch.setattr(G, "within_distance", None)
    df = spark.createDataFrame([*rows, (-1, None, 1.0), (-2, NAN, 1.0)], "id long, x double, y double")
    for d in (8.0, 25.0):
        near = {a: min(math.sqrt((x - u) ** 2 + (y - v) ** 2) for b, u, v in rows if a != b) for a, x, y in rows}
        assert {r["id"]: r["nearest"] for r in G.nearest_gap(df, "id", d, most=16).collect()} == {k: g for k, g in near.items() if g <= d}


def test_pairs_of_one_file_are_made_in_many_tasks(spark):
    df = spark.range(0, 6_000, 1, 1).selectExpr("id", "cast(id % 60 as double) * 3 as x", "cast(floor(id / 60) as double) * 3 as y")
    out = G.within_distance(df, "id", 3.0)
    assert out.rdd.getNumPartitions() == 4 and out.count() == 59 * 100 + 60 * 99
