"""Work on areas is dealt to tasks by their number, whatever the size of the file they come from."""

from pyspark.sql import functions as F

from stratiq.operators import areas as A
from stratiq.operators import overlay
from stratiq.operators import polygons as P
from stratiq.operators import relational as R


def some(spark, n):
    """Squares of half a side, a hundred places in turn."""
    x = F.col("id") % 100
    return spark.range(0, n, 1, 1).withColumn("area", A.area_of(P.box(x, F.lit(0.0), x + 0.5, F.lit(0.5))))


def test_pairs_of_one_file_are_tested_in_many_tasks(spark):
    frames = spark.range(3).select(F.col("id").alias("rect"), A.area_of(P.box(F.col("id") * 10, F.lit(-1.0), F.col("id") * 10 + 5, F.lit(5.0))).alias("frame"))
    out = A.join_areas(some(spark, 12_000), frames, "area", "frame", 10.0, A.within)
    assert out.rdd.getNumPartitions() == 3 and out.count() == 12_000 // 100 * 15


def test_coverage_of_one_file_is_summed_in_many_tasks(spark):
    out = A.coverage(some(spark, 30_000), "id", "area", 1.0, touches=True)
    assert out.rdd.getNumPartitions() == 6
    assert out.filter("fraction = 0.25").count() == 30_000


def test_areas_of_one_file_are_passed_on_unsorted(spark, monkeypatch):
    """A round-robin exchange sorts all that a task reads: areas are dealt by their key instead."""
    plan = A.coverage(some(spark, 60_000), "id", "area", 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan and plan.count("hashpartitioning(id") == 1
    monkeypatch.setattr(R, "PASSED_ON", 2)
    out = R.dealt(some(spark, 500), 100, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.rdd.getNumPartitions() == 5 and plan.count("REPARTITION_BY_NUM") == 2
    assert sorted(r[0] for r in out.select("id").collect()) == list(range(500))


def test_covered_cells_are_not_broadcast(spark):
    grid = spark.range(100).select(F.lit(0).cast("long").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("z"))
    out = A.covered_values(some(spark, 500), "id", "area", grid, 1.0)
    plan = out._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and out.count() == 500


def test_cases_are_traced_together(monkeypatch):
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    cases = [[[square(0.5 * k, 0.25 * k, 3.0)], [square(1.0, 1.0, 4.0), square(2.0, 2.0, 1.0)]] for k in range(30)] + [[[], [square(0.0, 0.0, 1.0)]], [[], []]]
    both = lambda a, b: a & b
    alone = [overlay.traced(c, both) for c in cases]
    for room in (1, 500, 10**6):
        monkeypatch.setattr(overlay, "AT_ONCE", room)
        assert overlay.traced_all(cases, both) == alone
    assert alone[-1] == alone[-2] == [] and alone[0] == [[(1.0, 1.0), (3.0, 1.0), (3.0, 2.0), (2.0, 2.0), (2.0, 3.0), (1.0, 3.0)]]


def test_an_overlay_is_evaluated_once(spark):
    two = some(spark, 300).withColumn("other", F.col("area"))
    parts = two.select(overlay.intersection(F.col("area"), F.col("other")).alias("part"))
    out = parts.select(A.measure(F.col("part")).alias("m")).filter("m > 0")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and out.count() == 300
