"""Raster and cube files: written and read back, other layouts, and windows that leave the rest unread."""

from __future__ import annotations

import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiq.operators.reproject import Lattice
from stratiq.sources import gridfiles as G


def grid(spark, rows, cols):
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    return cells.withColumns({"a": (F.col("row") * 100 + F.col("col")).cast("double"), "b": F.when(F.col("col") != 3, F.col("row").cast("double"))})


@pytest.mark.parametrize("tile", [4, 5, 100])
def test_tiff_round_trip(spark, tmp_path, tile):
    at, lattice = str(tmp_path / "tiles"), Lattice(1000.0, 5000.0, 10.0, -20.0, 9, 7)
    cells = grid(spark, 9, 7).filter("NOT (row = 2 AND col = 2)")
    assert G.write_tiffs(cells, ["a", "b"], at, lattice, tile) == len(list((tmp_path / "tiles").glob("*.tif")))
    found = {(r["x"], r["y"]): (r["b1"], r["b2"]) for r in G.read_files(spark, "geotiff", at).collect()}
    want = {(1000.0 + 10 * (c + 0.5), 5000.0 - 20 * (r + 0.5)): (None, None) if (r, c) == (2, 2) else (100.0 * r + c, None if c == 3 else float(r)) for r in range(9) for c in range(7)}
    assert found == want
    # A tile without a cell has no file; cells outside of the lattice go.
    assert G.write_tiffs(cells.filter("row < 4 AND col < 4"), ["a"], at + "-some", Lattice(0.0, 0.0, 1.0, 1.0, 3, 3), 4) == 1
    assert G.read_files(spark, "geotiff", at + "-some").count() == 9


def tiff(order, values, kind, extra, blocks, packed):
    """A TIFF by hand: values (bands, rows, columns) are only in ``blocks``, bytes each."""
    bands, height, width = values
    data = [zlib.compress(b) if packed else b for b in blocks]
    offsets = np.cumsum([8, *map(len, data)]).tolist()
    code = {"u": 1, "i": 2, "f": 3}[kind[0]]
    where, counts = (324, 325) if 322 in extra else (273, 279)
    tags = {256: width, 257: height, 258: [int(kind[1]) * 8] * bands, 259: 8 if packed else 1, 277: bands, 339: [code] * bands, where: offsets[:-1], counts: [len(d) for d in data]} | extra
    at = offsets[-1]
    after, entries, more = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag in sorted(tags):
        v = tags[tag] if isinstance(tags[tag], list) else [tags[tag]]
        raw = struct.pack(f"{order}{len(v)}I", *v)
        entries += struct.pack(f"{order}HHI", tag, 4, len(v)) + (raw if len(raw) == 4 else struct.pack(f"{order}I", after + len(more)))
        more += raw if len(raw) > 4 else b""
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at) + b"".join(data) + struct.pack(f"{order}H", len(tags)) + entries + bytes(4) + more


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_tiff_tiles_bands_apart_and_differences(spark, tmp_path, order, packed):
    values = np.arange(2 * 5 * 6).reshape(2, 5, 6).astype("u2") * 7
    blocks = []
    for band in values:
        wide = np.zeros((8, 8), "u2")
        wide[:5, :6] = band
        for r in (0, 4):
            for c in (0, 4):
                one = wide[r : r + 4, c : c + 4]
                blocks.append(np.diff(one, axis=1, prepend=np.zeros((4, 1), "u2")).astype("u2").astype(f"{order}u2").tobytes())
    (tmp_path / "t.tif").write_bytes(tiff(order, values.shape, "u2", {284: 2, 317: 2, 322: 4, 323: 4}, blocks, packed))
    rows = G.read_files(spark, "geotiff", str(tmp_path / "t.tif")).collect()
    assert {(r["row"], r["col"]): (r["b1"], r["b2"]) for r in rows} == {(r, c): (float(values[0, r, c]), float(values[1, r, c])) for r in range(5) for c in range(6)}


def test_tiff_window_leaves_other_strips_unread(spark, tmp_path):
    strips = [np.full((2, 3), i, "<f4").tobytes() for i in range(4)]
    data = bytearray(tiff("<", (1, 8, 3), "f4", {278: 2}, strips, True))
    header = G.tiff_header(_saved(tmp_path, data))
    for i in (0, 1, 3):
        at, n = header.places[i]
        data[at : at + n] = b"\xff" * n
    at, read = _saved(tmp_path, data), lambda **window: G.read_files(spark, "geotiff", _saved(tmp_path, data), cells_at_once=1, **window)
    part = read(row=(4, 5))
    assert [r["b1"] for r in part.collect()] == [2.0] * 6 and part.rdd.getNumPartitions() == 1
    assert [r["b1"] for r in read(y=(4.2, 5.0), x=(0, 1.5)).collect()] == [2.0] * 2
    assert read(row=(100, 200)).count() == 0
    assert read().rdd.getNumPartitions() == 4 and G.tiff_header(at).places == header.places
    with pytest.raises(Exception, match="zlib|decompress|incorrect"):
        read().agg(F.sum("b1")).collect()


def test_queries_of_one_read_keep_apart(spark, tmp_path):
    """A filter of one query narrows no other query of the same read."""
    cells = G.read_files(spark, "geotiff", _saved(tmp_path, G.tiff_bytes(np.arange(24.0).reshape(1, 8, 3), 0, 0, 1, 1, strip=2)), cells_at_once=1)
    assert (cells.filter("row = 4").count(), cells.count(), cells.filter("row = 1").count()) == (3, 24, 3)


def _saved(tmp_path, data):
    (tmp_path / "w.tif").write_bytes(data)
    return str(tmp_path / "w.tif")


def test_tiff_refuses_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "w.tif").write_bytes(tiff("<", (1, 2, 2), "f4", {259: 5}, [bytes(16)], False))
    with pytest.raises(ValueError, match="compression 5"):
        G.tiff_header(str(tmp_path / "w.tif"))
    (tmp_path / "x.tif").write_bytes(b"nothing of that kind")
    with pytest.raises(ValueError, match="no TIFF"):
        G.tiff_header(str(tmp_path / "x.tif"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="no TIFF below"):
        G.read_files(spark, "geotiff", str(tmp_path / "empty")).columns


def test_cube_round_trip_and_window(spark, tmp_path):
    at, lattice = str(tmp_path / "cube"), Lattice(0.0, 0.0, 2.0, 2.0, 3, 5)
    df = spark.range(3 * 5 * 4).select((F.col("id") % 3).alias("row"), (F.floor(F.col("id") / 3) % 5).alias("col"), F.floor(F.col("id") / 15).alias("t"))
    df = df.select("row", "col", (F.expr("timestamp_ntz'2020-01-01 00:00:00'") + F.expr("make_dt_interval(0, t * 13)")).alias("ts"), F.when(F.col("row") != 1, F.col("row") * 1000 + F.col("col") * 10 + F.col("t")).cast("double").alias("v"))
    assert G.write_cubes(df, "v", at, lattice, tile=4) == 2 * 2
    found = G.read_files(spark, "netcdf", at, cells_at_once=1)
    want = {(r["ts"], 2.0 * r["col"] + 1, 2.0 * r["row"] + 1): r["v"] for r in df.collect()}
    assert {(r["ts"], r["x"], r["y"]): r["v"] for r in found.collect()} == want
    late = G.read_files(spark, "netcdf", at, cells_at_once=1, ts=("2020-01-02", "2030-01-01"))
    assert found.rdd.getNumPartitions() == 8 and late.rdd.getNumPartitions() == 4
    assert {r["ts"] for r in late.collect()} == {datetime(2020, 1, 2, 2), datetime(2020, 1, 2, 15)}


def test_cube_records_and_scaling(spark, tmp_path):
    """Two record variables of short numbers, padded by record, with scale, offset and fill value; time in hours."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    units = struct.pack(">ii", 12, 1) + text("units") + struct.pack(">i", 2) + text("hours since 2001-02-03")
    scaled = struct.pack(">ii", 12, 3) + text("scale_factor") + struct.pack(">iid", 6, 1, 0.5) + text("add_offset") + struct.pack(">iid", 6, 1, 10.0) + text("_FillValue") + struct.pack(">iihh", 3, 1, -1, 0)
    dims = struct.pack(">ii", 10, 3) + text("time") + struct.pack(">i", 0) + text("lat") + struct.pack(">i", 1) + text("lon") + struct.pack(">i", 3)

    def build(begin):
        own = struct.pack(">ii", 11, 2)
        own += text("time") + struct.pack(">ii", 1, 0) + units + struct.pack(">iii", 4, 4, begin)
        own += text("v") + struct.pack(">iiii", 3, 0, 1, 2) + scaled + struct.pack(">iii", 3, 8, begin + 4)
        return b"CDF\x01" + struct.pack(">i", 2) + dims + bytes(8) + own

    begin = len(build(0))
    body = struct.pack(">i3hh", 5, 2, -1, 4, 0) + struct.pack(">i3hh", 29, 6, 8, -1, 0)
    (tmp_path / "r.nc").write_bytes(build(begin) + body)
    rows = G.read_files(spark, "netcdf", str(tmp_path / "r.nc")).orderBy("ts", "col").collect()
    assert [(r["ts"], r["v"]) for r in rows] == [(datetime(2001, 2, 3, 5), v) for v in (11.0, None, 12.0)] + [(datetime(2001, 2, 4, 5), v) for v in (13.0, 14.0, None)]


def test_queries_of_empty_tables(spark, tmp_path):
    from stratiq.plans import queries

    spark.createDataFrame([], "o_orderkey long, o_totalprice double, o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([], "user_id long, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("tiff_cells", "netcdf_cells"):
        assert queries()[name](spark, str(tmp_path)).collect() == []
