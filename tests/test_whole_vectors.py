"""Neighbours by all components of the vectors, against the SQL."""

import random

import duckdb

from stratiq import plans
from stratiq.operators import stats


def test_all_components_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stats, "LEAF", 10)
    draw = random.Random(4)
    rows = [(i, [0.5] * 8 + [draw.gauss(0, 1) for _ in range(12)], i % 3) for i in range(120)]
    rows += [(200, None, 0), (220, [1.0] * 8 + [None] * 12, 1), (240, [0.5] * 8, 2), (241, [0.5] * 19, 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r["knn"] for r in plans.queries()["knn_distance"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == dict(con.execute(plans.oracle_sql()["knn_distance"]).fetchall())
    assert len(got) == 9 and all(got[i] > 0 for i in range(0, 120, 20)) and got[200] is got[220] is got[240] is None


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert plans.queries()["knn_distance"](spark, str(tmp_path)).count() == 0
