"""Bootstrap stability against replicates drawn by hand, and models without a row."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiq.operators import models as M


def by_hand(hashes, x, labels, k, boots, rounds, seed):
    """Each replicate's rows repeated as often as drawn, plain k-means on them, clusters compared over the rows drawn."""
    out = {}
    for b in range(boots):
        times = M.replicate_weights(hashes, b, seed)
        drawn = np.flatnonzero(times)
        rank = M._mixed(hashes, 2 * b + 1 + 1000 * seed).astype(np.int64)
        centres = x[drawn[np.argsort(rank[drawn])][:k]].copy()
        rows = np.repeat(x, times, axis=0)
        for _ in range(rounds):
            at = ((rows[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([rows[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(k)])
        again = ((x[drawn][:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in set(labels[drawn]):
            one = labels[drawn] == c
            out[b, c] = max((one & (again == d)).sum() / (one | (again == d)).sum() for d in set(again))
    return out


def test_bootstrap_equals_a_resample_by_hand(spark):
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(m, 1.0, (60, 2)) for m in (0, 3, 9)])
    labels = np.repeat([1, 2, 3], 60)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, labels, strict=True))], "id long, a double, b double, stratum int").repartition(4)
    hashes = np.array([r["h"] for r in df.select("id", F.xxhash64("id", F.lit("bootstrap")).alias("h")).orderBy("id").collect()])
    got = {(r["replicate"], r["stratum"]): r["jaccard"] for r in M.bootstrap_jaccard(df, "id", "stratum", ["a", "b"], 3, rounds=4).collect()}
    assert {b for b, _ in got} == set(range(30)) and got == pytest.approx(by_hand(hashes, x, labels, 3, 30, 4, 1))


def test_replicate_weights_are_poisson():
    hashes = np.random.default_rng(0).integers(-(1 << 63), (1 << 63) - 1, 20_000)
    found = np.array([M.replicate_weights(hashes, b, 1) for b in range(10)])
    assert abs(found.mean() - 1) < 0.01 and abs(found.var() - 1) < 0.03 and abs(np.corrcoef(found)[0, 1]) < 0.03


def test_models_without_a_row(spark):
    none = spark.createDataFrame([], "id long, a double, b double")
    gaps = spark.createDataFrame([(1, None, 1.0), (2, None, 2.0)], "id long, a double, b double")
    report = M.k_report(none, "id", ["a", "b"], [2, 3])
    assert report.count() == 0 and M.choose_k(report, 2, 5) is None
    assert M.ward(none, "id", ["a", "b"], 3).count() == 0
    assert [r["stratum"] for r in M.strata(gaps, "id", ["a", "b"], 2, 1).collect()] == [None, None]
    hull = ((-1.0, -1.0), (9.0, -1.0), (9.0, 9.0))
    places = gaps.withColumns({"x": F.lit(1.0), "y": F.lit(1.0)})
    assert [r["candidate"] for r in M.domain_strata(places, "id", ["a", "b"], hull, [2, 3], 1).collect()] == [None, None]


def test_report_of_every_k(spark):
    draw = np.random.default_rng(2)
    rows = [(i, float(draw.normal(20 * (i % 3), 1)), float(draw.normal(9 * (i % 3), 1))) for i in range(300)]
    report = {r["k"]: r for r in M.k_report(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], [2, 3, 5], boots=6, restarts=3).collect()}
    assert max(report.values(), key=lambda r: r["score"])["k"] == 3 and report[3]["silhouette"] > 0.8
    assert report[3]["stability"] > report[5]["stability"] and all(0 < r["stability"] <= 1 for r in report.values())
