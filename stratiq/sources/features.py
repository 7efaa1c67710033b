"""Vector features: well-known binary in and out, and features chosen by tag keys within a window."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiq.operators.areas import clip_window
from stratiq.operators.polygons import POINT, clip, clip_line

#: Codes of well-known binary.
KINDS = {1: "point", 2: "line", 3: "polygon"}
MANY = {4, 5, 6, 7}
#: Bytes of the box in the header of a GeoPackage geometry, by its kind.
BOX_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
PARTS = f"array<struct<kind:string,rings:array<{POINT}>>>"
ARROW_PARTS = pa.list_(pa.struct([("kind", pa.string()), ("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))]))


def _points(data: bytes, at: int, order: str, n: int, dims: int) -> tuple[list[dict[str, float]], int]:
    values = np.frombuffer(data, f"{order}f8", n * dims, at).reshape(n, dims)
    return [{"x": float(x), "y": float(y)} for x, y in values[:, :2]], at + 8 * n * dims


def _parts(data: bytes, at: int = 0) -> tuple[list[dict], int]:
    """The simple geometries of one geometry, and where it ends."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 5 + (4 if code & 0x20000000 else 0)
    thousands, kind = divmod(code & 0x0FFFFFFF, 1000)
    dims = 2 + (thousands in (1, 3) or bool(code & 0x80000000)) + (thousands in (2, 3) or bool(code & 0x40000000))
    if kind == 1:
        points, at = _points(data, at, order, 1, dims)
        # A point of NaN is an empty one.
        return ([{"kind": "point", "rings": [points]}] if points[0]["x"] == points[0]["x"] else []), at
    if kind not in KINDS and kind not in MANY:
        raise ValueError(f"unknown geometry {code}")
    (n,) = struct.unpack_from(f"{order}I", data, at)
    at += 4
    if kind in MANY:
        found = []
        for _ in range(n):
            more, at = _parts(data, at)
            found += more
        return found, at
    if kind == 2:
        points, at = _points(data, at, order, n, dims)
        return ([{"kind": "line", "rings": [points]}] if points else []), at
    rings = []
    for _ in range(n):
        (count,) = struct.unpack_from(f"{order}I", data, at)
        ring, at = _points(data, at + 4, order, count, dims)
        rings.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
    return ([{"kind": "polygon", "rings": rings}] if rings else []), at


def _bare(data: bytes) -> bytes:
    """Well-known binary without the header of a GeoPackage, if it has one."""
    return data[8 + BOX_BYTES[data[3] >> 1 & 7] :] if data[:2] == b"GP" else data


def _polygon(rings: list[list[dict[str, float]]]) -> bytes:
    out = [struct.pack("<BII", 1, 3, len(rings))]
    for ring in rings:
        values = [v for p in [*ring, *ring[:1]] for v in (p["x"], p["y"])]
        out.append(struct.pack(f"<I{len(values)}d", len(values) // 2, *values))
    return b"".join(out)


def from_wkb(data: Column) -> Column:
    """The simple geometries of well-known binary (either byte order, further dimensions dropped, GeoPackage headers skipped).

    An array of (kind, rings); rings are not closed, a polygon's first is its
    outline.  Null stays null, an empty geometry is an empty array, and bytes of
    another kind raise ValueError: no feature is lost unseen.
    """

    @F.arrow_udf(PARTS)
    def read(batch: pa.Array) -> pa.Array:
        return pa.array([None if b is None else _parts(_bare(b))[0] for b in batch.to_pylist()], ARROW_PARTS)

    return read(data)


def to_wkb(rings: Column) -> Column:
    """A polygon's rings (the outline first) as well-known binary, little-endian and closed; null stays null."""

    @F.arrow_udf("binary")
    def write(batch: pa.Array) -> pa.Array:
        return pa.array([None if found is None else _polygon(found) for found in batch.to_pylist()], pa.binary())

    return write(rings)


def read_features(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """A row for each simple geometry of a table with well-known binary: part (from 0), kind, ring, holes.  Features without a geometry keep one row."""
    parts = df.withColumn("_parts", from_wkb(F.col(geometry))).drop(geometry)
    rows = parts.select(*[F.col(f"`{c}`") for c in parts.columns if c != "_parts"], F.posexplode_outer("_parts").alias("part", "_one"))
    rings = F.col("_one.rings")
    return rows.withColumns({"kind": F.col("_one.kind"), "ring": F.get(rings, F.lit(0)), "holes": F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))}).drop("_one")


def features_by_key(df: DataFrame, keys: Sequence[str], window: tuple[float, float, float, float], id_col: str = "id") -> DataFrame:
    """Features (id, tags: map, kind, ring) that have a tag of one of the keys, clipped to a window (x0, y0, x1, y1).

    One row for each feature and key: id, key, value, kind, ring (points and
    polygons), segments (lines), and holes if the input has them.  Features of which the window leaves nothing go;
    a null map of tags has no key.
    """
    x0, y0, x1, y1 = window
    held = ["holes"] if "holes" in df.columns else []
    tags = df.select(id_col, "kind", "ring", *held, F.explode(F.map_filter("tags", lambda k, _: k.isin(*keys))).alias("key", "value"))
    first = F.get("ring", F.lit(0))
    inside = F.when(first["x"].between(x0, x1) & first["y"].between(y0, y1), F.col("ring"))
    area = F.when(F.col("kind") == "point", inside).when(F.col("kind") == "polygon", clip(F.col("ring"), x0, y0, x1, y1))
    lines = F.when(F.col("kind") == "line", clip_line(F.col("ring"), x0, y0, x1, y1))
    out = tags.select(id_col, "key", "value", "kind", area.alias("ring"), lines.alias("segments"), *[clip_window(F.col(c), x0, y0, x1, y1).alias(c) for c in held])
    return out.filter((F.coalesce(F.size("ring"), F.lit(0)) > 0) | (F.coalesce(F.size("segments"), F.lit(0)) > 0))
