"""Medoids against plain ones, and suggestions of k on groups that are far apart."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from stratiq.operators import medoids as M


def table(spark, x):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, " + ", ".join(f"f{j} double" for j in range(x.shape[1]))).repartition(3)


def plain(d, k):
    """Partitioning around medoids by trying everything in turn."""
    cost = lambda m: d[:, m].min(axis=1).sum()
    chosen = []
    for _ in range(k):
        chosen.append(min((i for i in range(len(d)) if i not in chosen), key=lambda i: (round(cost([*chosen, i]), 9), i)))
    while True:
        tries = [(round(cost([*chosen[:j], i, *chosen[j + 1 :]]), 9), j, i) for j in range(k) for i in range(len(d)) if i not in chosen]
        top, j, i = min(tries)
        if top >= round(cost(chosen), 9):
            return sorted(chosen), cost(chosen)
        chosen[j] = i


@pytest.mark.parametrize("k", [1, 2, 4])
def test_medoids_equal_plain_ones(spark, k):
    x = np.random.default_rng(k).normal(size=(60, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    labelled, keys, cost = M.medoids(table(spark, x), "id", ["f0", "f1"], k)
    want, least = plain(d, k)
    assert keys == want and cost == pytest.approx(least)
    assert {r["id"]: r["cluster"] for r in labelled.collect()} == {i: int(d[i, want].argmin()) + 1 for i in range(60)}


def test_swaps_reach_the_least_sum(spark):
    """The greedy start takes the middle of a line, which no best pair holds."""
    x = np.array([[0.0], [1.0], [2.0], [10.0], [11.0], [12.0], [6.0]])
    d = np.abs(x - x.T)
    best = min(d[:, list(m)].min(axis=1).sum() for m in itertools.combinations(range(7), 2))
    assert M.medoids(table(spark, x), "id", ["f0"], 2)[2] == pytest.approx(best)


def test_medoids_of_odd_rows(spark):
    kind = "id long, f0 double"
    assert M.medoids(spark.createDataFrame([], kind), "id", ["f0"], 3)[1:] == ([], 0.0)
    same = spark.createDataFrame([(i, 5.0) for i in range(9)] + [(9, None)], kind)
    labelled, keys, cost = M.medoids(same, "id", ["f0"], 3)
    assert keys == [0] and cost == 0.0 and {(r["id"], r["cluster"]) for r in labelled.collect()} == {(i, 1) for i in range(9)}


def test_medoids_among_fewer_candidates(spark):
    """All rows count though few may be medoids: no group is lost, and the sum is near that of all candidates."""
    x = np.random.default_rng(5).normal(size=(400, 2)) + np.repeat([[0, 0], [30, 0], [0, 30], [30, 30]], [310, 30, 30, 30], axis=0)
    labelled, keys, cost = M.medoids(table(spark, x), "id", ["f0", "f1"], 4, candidates=120)
    assert len({0 if i < 310 else 1 + (i - 310) // 30 for i in keys}) == 4
    assert cost < 1.1 * M.medoids(table(spark, x), "id", ["f0", "f1"], 4)[2] and labelled.count() == 400


def test_suggestions_agree_on_clear_groups(spark):
    x = np.random.default_rng(7).normal(size=(90, 2)) * 0.3 + np.repeat([[0, 0], [9, 0], [4, 8]], 30, axis=0)
    found = {r["method"]: r["k"] for r in M.k_suggestions(table(spark, x), "id", ["f0", "f1"], [2, 3, 4], restarts=2, boots=3).collect()}
    assert found == {"pam": 3, "kmeans": 3, "ward": 3, "bootstrap": 3, "vote": 3}
    assert M.k_suggestions(table(spark, x).filter("id < 0"), "id", ["f0", "f1"], [2, 3]).count() == 0


def test_bend_of_the_index():
    x = np.concatenate([np.random.default_rng(i).normal(size=(20, 2)) * 0.2 + 10 * np.array(p) for i, p in enumerate([(0, 0), (1, 0), (0, 1), (1, 1)])])
    assert M.dindex_k(x, np.ones(80), 2, 7) == 4
    assert M.dindex_k(x[:2], np.ones(2), 2, 3) is None
