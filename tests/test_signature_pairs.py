"""Divergences by blocks: equal signatures are worked out once, pairs are those of all rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from stratiq.operators import signatures as S


def test_divergences_by_blocks(spark, monkeypatch):
    draw = random.Random(8)
    kinds = []
    for _ in range(9):
        n = [draw.randrange(1, 5) if draw.random() < 0.5 else 0 for _ in range(6)]
        n[draw.randrange(6)] += 1
        kinds.append({(f"c{k // 3}", k % 3): v / sum(n) for k, v in enumerate(n) if v})
    # One kind fills more than a block.
    held = {f"t{i:03d}": kinds[0 if i % 2 else i % 9] for i in range(90)}
    df = spark.createDataFrame([(t, *k, p) for t, m in held.items() for k, p in m.items()], "tile string, low string, high int, p double")
    made = []
    plain = S._divergences
    monkeypatch.setattr(S, "_divergences", lambda asked, others: made.append(1) or plain(asked, others))
    asked = df.filter("substring(tile, 4, 1) in ('0', '5')")
    out = S.jensen_shannon(asked, df, "tile", ["low", "high"], "p", block=8, digits=6)
    got = {(r["a"], r["b"]): r["js"] for r in out.collect()}

    def js(p, q):
        return math.log(2) + sum(0.5 * (p[k] * math.log(p[k] / (p[k] + q[k])) + q[k] * math.log(q[k] / (p[k] + q[k]))) for k in p if k in q)

    want = {(a, b): js(held[a], held[b]) for a in held if a[-1] in "05" for b in held if a != b}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 6e-7 for k in want)
    assert all(math.copysign(1, x) == 1 for x in got.values())


def test_equal_signatures_are_one():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("_id", pa.int64()), ("_m", pa.list_(pa.struct([("_k", pa.string()), ("_p", pa.float64())])))]))
    rows = lambda ids: pa.array([[{"_id": i, "_m": [{"_k": "u", "_p": 0.25 if i % 2 else 0.5}, {"_k": "v", "_p": 0.75 if i % 2 else 0.5}]} for i in ids]], kind)[0].values
    x, y, js = S._divergences(rows(range(100)), rows(range(1, 300, 2)))
    assert js.shape == (2, 1) and x.tolist() == [0, 1] * 50 and set(y.tolist()) == {0} and abs(js[1, 0]) < 1e-12


def test_rounded_as_sql(spark):
    draw = random.Random(1)
    values = [draw.random() for _ in range(500)] + [0.0000005, 0.1234565, 0.4999995, 2.5e-6, -1e-17, 1e-17, 0.6931471805599453, -0.0000005]
    spark_ = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert S._half_up(np.array(values), 6).tolist() == spark_
