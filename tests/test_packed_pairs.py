"""Pairs within a distance: points of one place are packed, distances worked out for packs."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from stratiq.operators import geometry as G

NAN = float("nan")


def test_pairs_of_packs(spark, monkeypatch):
    monkeypatch.setattr(G, "PACKED", 4)
    monkeypatch.setattr(G, "MET", 10)
    draw = random.Random(6)
    spots = [(draw.random() * 40 - 20, draw.random() * 40 - 20) for _ in range(30)]
    rows = [(i, *draw.choice(spots)) for i in range(150)] + [(200 + i, 0.5, 0.5) for i in range(40)] + [(3, 1.0, 1.0), (3, 4.0, 1.0), (3, -0.0, 0.0), (4, 0.0, 0.0)]
    odd = [(300, None, 1.0), (301, NAN, 1.0), (None, 0.5, 0.5), (302, math.inf, 0.5)]
    calls = []
    df = spark.createDataFrame(rows + odd, "id long, x double, y double")
    out = G.within_distance(df, "id", 6.0, shown=lambda gap: calls.append(1) or F.round(gap, 3))
    got = Counter((r["a"], r["b"], r["distance"]) for r in out.collect())
    gap = lambda p, q: math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)
    want = Counter((min(p[0], q[0]), max(p[0], q[0])) for i, p in enumerate(rows) for q in rows[:i] if p[0] != q[0] and gap(p, q) <= 6.0)
    assert calls == [1] and Counter((a, b) for a, b, _ in got.elements()) == want
    places = {}
    for p in rows:
        places.setdefault(p[0], []).append(p)
    assert all(any(abs(d - gap(p, q)) <= 0.0006 for p in places[a] for q in places[b]) for a, b, d in got)
    plain = G.within_distance(df, "id", 6.0)
    assert Counter((r["a"], r["b"], round(r["distance"], 3)) for r in plain.collect()).total() == got.total()
