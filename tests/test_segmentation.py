"""Mean shift over tiles against a plain one over the whole grid."""

from __future__ import annotations

import numpy as np
import pytest

from stratiq.operators import segmentation as S


def plain(z, radius, reach, tolerance=0.01, rounds=100):
    """One cell after another, over the whole grid."""
    rows, cols = z.shape
    yy, xx = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
    out = {}
    for i in range(rows):
        for j in range(cols):
            if np.isnan(z[i, j]):
                continue
            y, x, v = float(i), float(j), z[i, j]
            for _ in range(rounds):
                near = ((yy - y) ** 2 + (xx - x) ** 2 <= radius**2) & (np.abs(z - v) <= reach)
                if not near.any():
                    break
                new = yy[near].mean(), xx[near].mean(), z[near].mean()
                step = (((new[0] - y) ** 2 + (new[1] - x) ** 2) / radius**2 + ((new[2] - v) / reach) ** 2) ** 0.5
                y, x, v = new
                if step < tolerance:
                    break
            out[i, j] = (y, x, v)
    return out


def segments(found, radius, reach):
    """Smallest cell of each set of four-neighbours with near modes."""
    label = {c: c for c in found}

    def root(c):
        while label[c] != c:
            c = label[c]
        return c

    for (i, j), a in found.items():
        for other in ((i, j + 1), (i + 1, j)):
            b = found.get(other)
            if b and (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= radius**2 and abs(a[2] - b[2]) <= reach:
                x, y = sorted((root((i, j)), root(other)))
                label[y] = x
    return {c: root(c) for c in found}


def field(seed):
    draw = np.random.default_rng(seed)
    z = np.where(np.add.outer(np.arange(22), np.arange(27)) < 24, 10.0, 40.0) + draw.normal(0, 2.0, (22, 27)) + np.linspace(0, 12, 27)
    z[4:7, 5] = np.nan
    z[15:17, 20:22] = 90.0  # a small segment
    return z


@pytest.mark.parametrize("tile", [3, 8, 64])
def test_tiles_leave_no_mark(spark, tile):
    z, radius, reach = field(1), 2.5, 6.0
    cells = spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for i, line in enumerate(z) for j, v in enumerate(line)], "row long, col long, z double").repartition(3)
    want = plain(z, radius, reach)
    got = {(r["row"], r["col"]): (r["mode_row"], r["mode_col"], r["mode"]) for r in S.modes(cells, "z", radius, reach, tile=tile).collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)
    assert max(abs(m[0] - i) + abs(m[1] - j) for (i, j), m in want.items()) > 4  # some climb far
    if tile == 8:
        named = {(r["row"], r["col"]): divmod(r["segment"], 27) for r in S.mean_shift(cells, "z", radius, reach, 27, tile=tile).collect()}
        assert named == segments(want, radius, reach)
        least = S.mean_shift(cells, "z", radius, reach, 27, minsize=12, tile=tile).groupBy("segment").count().collect()
        assert len(least) < len(set(named.values())) and min(r["count"] for r in least) >= 12


def test_no_cells(spark):
    none = spark.createDataFrame([], "row long, col long, z double")
    assert S.mean_shift(none, "z", 2, 5.0, 10).count() == 0
