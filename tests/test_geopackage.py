"""Layers of GeoPackage files that the tests write."""

from __future__ import annotations

import sqlite3
import struct

import pytest

from stratiq.sources import features, geopackage as G


def square(x, y, box=True):
    """A unit square in the format's binary form, with or without its box."""
    ring = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]
    head = b"GP\0" + bytes([0b011 if box else 0b001]) + struct.pack("<i", 4326) + (struct.pack("<4d", x, x + 1, y, y + 1) if box else b"")
    return head + struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<2d", *p) for p in ring)


def package(path, layers=("plots",), index=False, box=True):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        for name in layers:
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", (name,))
            db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY, geom POLYGON, name TEXT(20), "a size" DOUBLE, n MEDIUMINT, raw BLOB)')
            rows = [(i, square(float(i % 5), float(i // 5), box), f"p{i}", i / 2, i if i % 2 else None, b"\1") for i in range(20)]
            db.executemany(f'INSERT INTO "{name}" VALUES (?, ?, ?, ?, ?, ?)', [*rows, (30, None, None, None, None, None)])
            if index:
                db.execute(f'CREATE VIRTUAL TABLE "rtree_{name}_geom" USING rtree(id, minx, maxx, miny, maxy)')
                db.executemany(f'INSERT INTO "rtree_{name}_geom" VALUES (?, ?, ?, ?, ?)', [(i, i % 5, i % 5 + 1, i // 5, i // 5 + 1) for i in range(20)])
    db.close()
    return str(path)


def test_layer_by_ranges_of_ids(spark, tmp_path):
    df = G.read_geopackage(spark, package(tmp_path / "a #1.gpkg"), ids_at_once=8)
    assert dict(df.dtypes) == {"fid": "bigint", "geom": "binary", "name": "string", "a size": "double", "n": "bigint", "raw": "binary"}
    assert df.rdd.getNumPartitions() == 4
    rows = {r["fid"]: (r["name"], r["a size"], r["n"]) for r in df.collect()}
    assert rows == {i: (f"p{i}", i / 2, i if i % 2 else None) for i in range(20)} | {30: (None, None, None)}
    shapes = {r["fid"]: r["ring"] for r in features.read_features(df.select("fid", "geom"), "geom").collect()}
    assert shapes[30] is None and [(p["x"], p["y"]) for p in shapes[7]] == [(2.0, 1.0), (3.0, 1.0), (3.0, 2.0), (2.0, 2.0)]


@pytest.mark.parametrize(("index", "box", "found"), [(True, True, {6, 7, 11, 12}), (False, True, {6, 7, 11, 12}), (False, False, set(range(20)))])
def test_window(spark, tmp_path, index, box, found):
    df = G.read_geopackage(spark, "file:" + package(tmp_path / "a.gpkg", index=index, box=box), window=(2.0, 2.0, 2.0, 2.0), ids_at_once=9)
    assert {r["fid"] for r in df.collect()} == found


def test_choice_of_layer(spark, tmp_path):
    path = package(tmp_path / "a.gpkg", ("one", "two"))
    assert G.read_geopackage(spark, path, "two").count() == 21
    with pytest.raises(ValueError, match="one.*two"):
        G.layer(path)
    with pytest.raises(ValueError, match="three"):
        G.layer(path, "three")
    with pytest.raises(ValueError, match="mounted"):
        G.layer("hdfs://host/a.gpkg")
