"""Features, archives, layers, cubes and grids: what is written is read again."""

from __future__ import annotations

import datetime as dt
import struct
import zipfile

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from stratiq.operators import polygons as P, relational as R
from stratiq.sources import features, sinks, stations

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOLE = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0)]


def coordinates(points, order="<", dims=2):
    return b"".join(struct.pack(f"{order}{dims}d", *p, *[9.0] * (dims - 2)) for p in points)


def polygon(rings, order="<", code=3, dims=2):
    body = b"".join(struct.pack(f"{order}I", len(r) + 1) + coordinates([*r, r[0]], order, dims) for r in rings)
    return struct.pack(f"{order}BII", order == "<", code, len(rings)) + body


def test_well_known_binary(spark):
    line = struct.pack("<BII", 1, 2, 2) + coordinates([(0, 0), (1, 2)])
    packed = b"GP\x00\x03" + b"\0" * 4 + b"\0" * 32 + polygon([SQUARE])
    rows = [
        (1, struct.pack("<BI", 1, 1) + coordinates([(3, 4)])), (2, line), (3, polygon([SQUARE, HOLE])), (4, polygon([SQUARE], ">")), (5, polygon([SQUARE], code=1003, dims=3)),
        (6, struct.pack("<BII", 1, 6, 2) + polygon([SQUARE]) + polygon([HOLE])), (7, packed), (8, None), (9, struct.pack("<BII", 1, 3, 0)),
    ]
    got = {}
    for r in features.read_features(spark.createDataFrame(rows, "id int, geometry binary")).orderBy("id", "part").collect():
        got.setdefault(r["id"], []).append((r["kind"], r["ring"] and [tuple(p) for p in r["ring"]], [[tuple(p) for p in h] for h in r["holes"] or []]))
    square = ("polygon", SQUARE, [])
    assert got == {
        1: [("point", [(3, 4)], [])], 2: [("line", [(0, 0), (1, 2)], [])], 3: [("polygon", SQUARE, [HOLE])], 4: [square], 5: [square], 6: [square, ("polygon", HOLE, [])], 7: [square], 8: [(None, None, [])], 9: [(None, None, [])],
    }
    bad = spark.createDataFrame([(1, struct.pack("<BII", 1, 99, 0))], "id int, geometry binary")
    with pytest.raises(PythonException, match="unknown geometry"):
        features.read_features(bad).collect()


def test_written_rings_are_read(spark):
    df = spark.createDataFrame([(1, [SQUARE, HOLE]), (2, None)], f"id int, rings array<{P.POINT}>")
    got = df.select("id", features.from_wkb(features.to_wkb(F.col("rings"))).alias("p")).orderBy("id").collect()
    assert [[tuple(p) for p in r] for r in got[0]["p"][0]["rings"]] == [SQUARE, HOLE] and got[1]["p"] is None


def test_lines_are_clipped(spark):
    df = spark.createDataFrame([(1, [(-1.0, 1.0), (3.0, 1.0), (3.0, 9.0)]), (2, [(-2.0, 0.0), (0.0, 4.0)]), (3, [(0.0, 0.0)]), (4, [(1.0, 1.0), (1.0, 1.0)])], f"id int, line {P.POINT}")
    got = {r["id"]: [tuple(map(tuple, s)) for s in r["s"]] for r in df.select("id", P.clip_line(F.col("line"), 0.0, 0.0, 4.0, 4.0).alias("s")).collect()}
    assert got == {1: [((0, 1), (3, 1)), ((3, 1), (3, 4))], 2: [], 3: [], 4: []}


def test_archives(spark, tmp_path):
    for name, members in (("wind_00044.zip", {"produkt_a.txt": "ID;T;F\n44; 2024; 1.5\n\n44;2025;-999\n", "meta.txt": "x\n"}), ("wind_00071.zip", {"produkt_b.txt": "ID;T;F\n71;2024;ü\n"}), ("wind_00099.zip", {"produkt_c.txt": "ID;T;F\n99;1;1\n"})):
        (tmp_path / name[:7]).mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / name[:7] / name, "w") as z:
            for member, text in members.items():
                z.writestr(member, text.encode("latin-1"))
    lines = stations.read_zip_members(spark, str(tmp_path), "produkt_*", stations.files_of(["00044", "00071"]), lines_at_once=2)
    assert lines.count() == 6
    got = stations.split_semicolon(lines, ["id", "t", "f"]).orderBy("id", "t").collect()
    assert [(r["member"], r["t"], r["f"]) for r in got] == [("produkt_a.txt", "2024", "1.5"), ("produkt_a.txt", "2025", None), ("produkt_b.txt", "2024", "ü")]
    with pytest.raises(ValueError, match="no ids"):
        stations.files_of([])


def test_composites(spark):
    df = spark.createDataFrame([("/r/raa01-rw_10000-2401020350-dwd.bin",), ("/r/raa01-rw_10000-2401020450-dwd.bin",), ("/r/readme",)], "path string")
    got = stations.composites(df, "2024-01-02 03:50:00", "2024-01-02 04:00:00", pattern=r"-(\d{10})-").collect()
    assert [r["ts"] for r in got] == [dt.datetime(2024, 1, 2, 3, 50)]


def test_layers_and_guards(spark, tmp_path):
    path, made = str(tmp_path / "l"), []
    points, none = spark.createDataFrame([(1, 2.0)], "id int, x double"), spark.createDataFrame([], "id int")
    sinks.write_layers({"points": points, "lines": none}, path)
    sinks.write_layers({"polygons": points.drop("x")}, path)
    assert sinks.read_layer(spark, path, "points").columns == ["id", "x"] and sinks.read_layer(spark, path, "polygons").count() == 1
    build = lambda: made.append(1) or points
    for _ in range(2):
        assert sinks.unless_present(spark, str(tmp_path / "step"), build).count() == 1
    (tmp_path / "step" / "_SUCCESS").unlink()
    sinks.unless_present(spark, str(tmp_path / "step"), build)
    assert len(made) == 2


def test_cubes_and_grids(spark, tmp_path):
    cube = spark.createDataFrame([(1, dt.datetime(2024, 1, d, h), float(d)) for d in (1, 2, 3) for h in (0, 12)], "cell int, ts timestamp_ntz, v double")
    sinks.write_cube(cube, str(tmp_path / "c"), "ts")
    part = sinks.read_cube(spark, str(tmp_path / "c"), "ts", "2024-01-01 12:00:00", "2024-01-02 00:00:00")
    assert sorted(r["v"] for r in part.collect()) == [1.0, 2.0] and part.columns == ["cell", "ts", "v"]
    assert "PartitionFilters: [isnotnull(_day" in part._jdf.queryExecution().executedPlan().toString()
    grid = spark.createDataFrame([(0, 0, 1.0, None), (0, 1, float("nan"), 2)], "row int, col int, a double, b int")
    sinks.write_grids(grid, ["a", "b"], str(tmp_path / "g"), -1.0)
    assert [tuple(r) for r in sinks.read_grids(spark, str(tmp_path / "g"), -1.0).orderBy("col").collect()] == [(0, 0, 1.0, None), (0, 1, None, 2.0)]


def test_columns_by_name(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert R.any_of(df, ["b", "c", "b"]) == ["b"] and R.all_of(df, ["a"]) == ["a"] and df.drop(*R.any_of(df, ["b", "c"])).columns == ["a"]
    with pytest.raises(ValueError, match="missing"):
        R.all_of(df, ["c"])
