"""Patches joined in tiles and then across their borders."""

import numpy as np
import pytest

from stratiq.operators import raster


@pytest.mark.parametrize("tile", [3, 5, 64])
def test_patches_across_tiles(spark, tile, monkeypatch):
    draw = np.random.default_rng(2)
    lab = draw.integers(0, 3, (23, 17))
    cells = {(i - 7, j): "ab"[lab[i, j]] if lab[i, j] < 2 else None for i in range(23) for j in range(17) if (i + j) % 11}
    want = {}
    for at in sorted(cells):
        if at not in want:
            group, todo = {at}, [at]
            while todo and cells[at] is not None:
                r, c = todo.pop()
                for near in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if near not in group and cells.get(near) == cells[at]:
                        group.add(near)
                        todo.append(near)
            want |= dict.fromkeys(group, min(r * 17 + c for r, c in group))
    seen, connected = [], raster.connected
    monkeypatch.setattr(raster, "connected", lambda edges, nodes, node: (seen.append(nodes.count()), connected(edges, nodes, node))[1])
    df = spark.createDataFrame([(*at, v) for at, v in cells.items()], "row long, col long, c string")
    got = raster.patches(df, "c", 17, tile=tile)
    assert got.columns == ["row", "col", "c", "component"]
    assert {(r["row"], r["col"]): r["component"] for r in got.collect()} == want
    # Only patches at the tiles' borders are joined in rounds.
    assert sum(seen) < len(cells) / 2
