"""Forests kept and applied: round trips, gaps, ties, numbers of classes, and candidates at their places."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from stratiq.operators import models
from stratiq.operators import prediction as P
from stratiq.operators.models import forest
from stratiq.operators.reproject import Lattice
from stratiq.sources import gridfiles

CELLS = "row long, col long, a double, b double"


@pytest.fixture(scope="module")
def train(spark):
    rows = [(i, float(i % 10), float(i // 10), "low" if i % 10 < 4 else "mid" if i // 10 < 6 else "top", i % 3 + 1) for i in range(100)]
    return spark.createDataFrame(rows, "id long, a double, b double, cls string, fold int").cache()


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(r, c, float(c), None if (r, c) == (1, 1) else math.nan if (r, c) == (2, 2) else math.inf if (r, c) == (3, 3) else float(r)) for r in range(10) for c in range(10)]
    return spark.createDataFrame(rows, CELLS)


def test_saved_forest_predicts_the_same(spark, train, grid, tmp_path):
    found = P.fit_forest(train, "cls", ["a", "b"], trees=7)
    assert found.labels == ["low", "mid", "top"] and found.features == ["a", "b"]
    found.save(str(tmp_path / "model"))
    found.save(str(tmp_path / "model"))
    again = P.load_forest(str(tmp_path / "model"))
    table = lambda m: {(r["row"], r["col"]): (r["p_low"], r["p_mid"], r["p_top"]) for r in P.probabilities(grid, m).collect()}
    cells = table(found)
    assert table(again) == cells and again.labels == found.labels
    assert {k for k, v in cells.items() if v == (None, None, None)} == {(1, 1), (2, 2), (3, 3)}
    assert all(sum(v) == pytest.approx(1) for v in cells.values() if v[0] is not None)
    # The same forest as that of rows.
    new = grid.filter("b IS NOT NULL AND NOT isnan(b) AND b < 100").withColumn("id", F.col("row") * 10 + F.col("col"))
    rows = {r["id"]: (r["p_low"], r["p_mid"], r["p_top"]) for r in forest(train, new, "id", "cls", ["a", "b"], trees=7).collect()}
    assert rows == {r * 10 + c: v for (r, c), v in cells.items() if v[0] is not None}


def test_hard_classes(spark, train, grid):
    found = P.fit_forest(train, "cls", ["a", "b"], trees=7)
    p = P.probabilities(grid, found)
    ids = spark.createDataFrame([("low", 10), ("mid", 20), ("low", 10), (None, 5)], "class string, class_id int")
    rows = {(r["row"], r["col"]): (r["class"], r["class_id"]) for r in P.hard_classes(p, found, ids).collect()}
    assert rows[0, 1] == ("low", 10) and rows[1, 8] == ("mid", 20) and rows[8, 8] == ("top", None) and rows[1, 1] == (None, None) and len(rows) == 100
    assert {r["class_id"] for r in P.hard_classes(p, found).collect()} == {1, 2, 3, None}
    tie = spark.createDataFrame([(0.0, 0.5, 0.5)], "p_low double, p_mid double, p_top double")
    assert P.hard_classes(tie, found).first()["class"] == "mid"
    for bad in ([("low", 1), ("low", 2)], [("low", 1), ("mid", 1)]):
        with pytest.raises(ValueError, match="one to one"):
            P.hard_classes(p, found, spark.createDataFrame(bad, "class string, class_id int"))


def test_probabilities_to_a_file_and_back(spark, train, grid, tmp_path):
    found = P.fit_forest(train, "cls", ["a", "b"], trees=3)
    names = [f"p_{c}" for c in found.labels]
    p = P.probabilities(grid, found)
    assert gridfiles.write_tiffs(p, names, str(tmp_path), Lattice(0.0, 0.0, 1.0, 1.0, 10, 10), 4) == 9
    back = {(int(r["y"]), int(r["x"])): (r["b1"], r["b2"], r["b3"]) for r in gridfiles.read_files(spark, "geotiff", str(tmp_path)).collect()}
    assert back == {(r["row"], r["col"]): tuple(r[n] for n in names) for r in p.collect()}


def test_refit_of_the_best(train):
    found, sweep = P.tuned_forest(train, "id", "cls", ["a", "b"], "fold", (1, 2, 3), trees=(3, 5), depth=4)
    rows = {(r["trees"], r["mtry"]): r for r in sweep.collect()}
    best = next(r for r in rows.values() if r["best"])
    assert set(rows) == {(3, 2), (5, 2)} and best["kappa"] == max(r["kappa"] for r in rows.values()) > 0.7
    assert found.pipeline.stages[2].getNumTrees == best["trees"]
    with pytest.raises(ValueError, match="no row"):
        P.fit_forest(train.filter("id < 0"), "cls", ["a"])


def test_candidates_at_their_places(spark):
    units = spark.createDataFrame([(i,) for i in range(12)], "id long")
    one = spark.createDataFrame([(i, float(i // 6 * 100 + i % 6)) for i in range(11)] + [(11, None)], "id long, u double")
    two = spark.createDataFrame([(i, float(i % 2 * 50 + i)) for i in range(12)], "id long, v double")
    cells = spark.createDataFrame([(i, float(10 * i + d), 1.0 + d) for i in range(12) for d in (0, 2)], "id long, x double, y double")
    rows = P.candidates_as_points(units, "id", cells, {"first": (one, ["u"]), "second": (two, ["v"])}, {"first": 2, "second": 2}, 2).collect()
    kinds = {(r["candidate_type"], r["stratum"]): 0 for r in rows}
    assert len(kinds) == 4 and len(rows) == 8
    assert all(r["x"] == 10 * r["id"] + 1 and r["y"] == 2.0 for r in rows) and ("first", 11) not in {(r["candidate_type"], r["id"]) for r in rows}


def test_candidates_without_a_broadcast_of_units(spark, monkeypatch):
    """Beyond a checked number of units no join by their key is a broadcast, however small their files; cells meet the few candidates by one."""
    plans, kept = [], P.saved
    monkeypatch.setattr(P.R, "FEW_ROWS", 30)
    for module in (P, models):
        monkeypatch.setattr(module, "saved", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or kept(df, name))
    units = spark.range(40).selectExpr("id", "cast(id * id % 17 as double) as u")
    cells = units.selectExpr("id", "cast(id as double) as x", "1.0D as y")
    out = P.candidates_as_points(units.select("id"), "id", cells, {"one": (units, ["u"])}, {"one": 2}, 2)
    plans = dict(plans)
    assert "SortMergeJoin" in plans["strata-rows"] and "BroadcastHashJoin" not in plans["strata-rows"] and "SortMergeJoin" in plans["candidates"]
    last = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftSemi" in line]
    assert out.count() == 4 and last and all("BroadcastHashJoin" in line for line in last)
