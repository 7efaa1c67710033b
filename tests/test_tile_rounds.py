"""Iterative operators on grids exchange what lies at the borders of tiles, not all cells."""

import random

from stratiq.operators import raster, segmentation


def recorded(monkeypatch, module):
    sizes = []
    saved = module.saved

    def noted(df, name):
        out = saved(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(module, "saved", noted)
    return sizes


def test_sinks_exchange_borders_alone(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(r, c, None if (r, c) == (7, 7) else float(draw.randrange(100))) for r in range(40) for c in range(40)]
    df = spark.createDataFrame(rows, "row long, col long, z double")
    want = {(r["row"], r["col"]): r["level"] for r in raster.fill_sinks(df, "z", 0.5, tile=64).collect()}
    sizes = recorded(monkeypatch, raster)
    got = {(r["row"], r["col"]): r["level"] for r in raster.fill_sinks(df, "z", 0.5, tile=10).collect()}
    assert got == want and len(got) == 1600 and got[7, 7] is None
    assert max(n for name, n in sizes if name == "fill") <= 16 * 36


def test_segments_of_tiles_meet_across_borders(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(r, c, float(draw.randrange(4))) for r in range(24) for c in range(24)]
    df = spark.createDataFrame(rows, "row long, col long, z double")
    each = lambda tile: {(r["row"], r["col"]): (r["segment"], r["mode"]) for r in segmentation.mean_shift(df, "z", 1.0, 1.0, 24, minsize=3, tile=tile).collect()}
    want = each(64)
    sizes = recorded(monkeypatch, raster)
    assert each(7) == want and len(want) == 576
    assert max(n for name, n in sizes if name in ("edges", "labels")) < 576
