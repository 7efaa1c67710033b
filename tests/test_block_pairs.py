"""Neighbours by blocks of rows."""

import math
import random

from stratiq.operators import stats


def test_neighbours_by_blocks(spark, monkeypatch):
    draw = random.Random(1)
    rows = [(i, float(draw.randrange(12)), float(draw.randrange(12)), i % 3) for i in range(150)]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 0)], "id long, x double, y double, lab int")
    blocks = stats._blocks
    monkeypatch.setattr(stats, "_blocks", lambda d, key, features, n, name, *more: blocks(d, key, features, 13, name, *more))
    gap = lambda a, b: math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)
    got = {r["id"]: r["knn"] for r in stats.knn_distance(df.filter("id % 5 = 0"), df, "id", ["x", "y"], 4).collect()}
    assert got == {a[0]: sorted(gap(a, b) for b in rows if a != b)[3] for a in rows if a[0] % 5 == 0} | {900: None}
    new, train = df.filter("id < 900"), df.filter("id % 4 = 0 and id < 900")
    out = {r["id"]: (r["di"], r["near_label"], r["lpd"], r["inside"]) for r in stats.applicability(new, train, "id", ["x", "y"], label="lab").collect()}
    known = [r for r in rows if r[0] % 4 == 0]
    each = [gap(a, b) for a in known for b in known if a != b]
    mean = sum(each) / len(each)
    for a in rows:
        near = min((round(gap(a, b), 9), b[0], b[3]) for b in known if a != b)
        assert abs(out[a[0]][0] - near[0] / mean) < 1e-6 and out[a[0]][1] == near[2] and out[a[0]][3] == (out[a[0]][2] > 0)
