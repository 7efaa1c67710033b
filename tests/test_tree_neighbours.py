"""Neighbours meet by leaves of a tree: blocks that cannot hold a nearer point are left out, the result is that of all pairs."""

import math
import random

from stratiq.operators import stats


def test_neighbours_by_leaves(spark, monkeypatch):
    draw = random.Random(2)
    inf = math.inf
    rows = [(i, draw.gauss(0, 1), draw.gauss(0, 1)) for i in range(900)] + [(1000 + i, 5.0, 5.0) for i in range(120)] + [(2000, inf, 0.0), (2005, 40.0, -inf), (2010, 1e200, 0.0)]
    met = []
    asked = stats._asked
    monkeypatch.setattr(stats, "_block_pairs", None)
    monkeypatch.setattr(stats, "LEAF", 10)
    monkeypatch.setattr(stats, "ASKED", 7)
    monkeypatch.setattr(stats, "_asked", lambda visits, *more: met.append(visits.count()) or asked(visits, *more))
    df = spark.createDataFrame([*rows, (3000, None, 1.0), (3005, float("nan"), 1.0)], "id long, x double, y double")
    got = {r["id"]: r["knn"] for r in stats.knn_distance(df.filter("id % 5 = 0"), df, "id", ["x", "y"], 3).collect()}

    def least(a):
        gaps = [math.sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])) for b in rows if a[0] != b[0]]
        found = sorted(g for g in gaps if not math.isnan(g))
        return found[2] if len(found) > 2 else None

    assert got == {a[0]: least(a) for a in rows if a[0] % 5 == 0} | {3000: None, 3005: None}
    # The first round meets a block for each query, the second few of the others; three queries without a bound meet all.
    assert met[0] == len(got) - 2 and met[1] < 0.3 * met[0] * len(rows) / 48


def test_neighbours_of_few_points(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 3.0)], "id string, x double")
    two = lambda k: {r["id"]: r["knn"] for r in stats.knn_distance(df, df, "id", ["x"], k).collect()}
    assert two(1) == {"a": 1.0, "b": 1.0, "c": 2.0} and two(2) == {"a": 3.0, "b": 2.0, "c": 3.0} and two(3) == {}
    assert stats.knn_distance(df, df.limit(0), "id", ["x"], 1).count() == 0
