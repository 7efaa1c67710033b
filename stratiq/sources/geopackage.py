"""GeoPackage layers as a Spark data source: ranges of feature ids are partitions."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .features import BOX_BYTES

#: Fixed values of the format: declared types of numbers; all others are text, but for blobs and the geometry.
WHOLE = {"BOOLEAN", "TINYINT", "SMALLINT", "MEDIUMINT", "INT", "INTEGER"}
REAL = {"FLOAT", "DOUBLE", "REAL"}
ARROW = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
ROWS_AT_ONCE = 5000


@dataclass(frozen=True)
class Layer:
    """A layer's table, its column of ids, that of geometries, all columns with Spark's types, and the table of its spatial index."""

    path: str
    table: str
    key: str
    geometry: str
    columns: tuple[tuple[str, str], ...]
    index: str | None


@dataclass
class Ids(InputPartition):
    layer: Layer
    first: int
    last: int


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connected(path: str) -> closing:
    """Read-only, without a journal: the file lies in a folder that all executors see, and nobody writes to it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    elif "://" in path:
        raise ValueError(f"a GeoPackage is read in place, from a mounted folder: {path}")
    escaped = path.replace("%", "%25").replace("?", "%3f").replace("#", "%23")
    return closing(sqlite3.connect(f"file:{escaped}?mode=ro&immutable=1", uri=True))


def layer(path: str, name: str | None = None) -> Layer:
    """The layer of that name, or the only one; ValueError if there is none such or the choice is open."""
    with _connected(path) as db:
        found = dict(db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall())
        if name is None and len(found) != 1 or name is not None and name not in found:
            raise ValueError(f"layers {sorted(found)} in {path}, wanted {name}")
        table = name or next(iter(found))
        described = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
        keys = [r[1] for r in described if r[5]]
        if len(keys) != 1:
            raise ValueError(f"no single column of ids in {table}")
        kinds = []
        for _, column, kind, *_ in described:
            base = kind.upper().split("(")[0].strip()
            kinds.append((column, "binary" if column == found[table] or base == "BLOB" else "long" if base in WHOLE else "double" if base in REAL else "string"))
        index = f"rtree_{table}_{found[table]}"
        has = db.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", (index,)).fetchone()[0]
        return Layer(path, table, keys[0], found[table], tuple(kinds), index if has else None)


def _box(data: bytes) -> tuple[float, float, float, float] | None:
    """x0, x1, y0, y1 from a geometry's header, if it holds them."""
    if data[:2] != b"GP" or not BOX_BYTES.get(data[3] >> 1 & 7):
        return None
    return struct.unpack_from(f"{'<' if data[3] & 1 else '>'}4d", data, 8)


class LayerReader(DataSourceReader):
    def __init__(self, found: Layer, window: list[float] | None, step: int) -> None:
        self.found, self.window, self.step = found, window, step

    def partitions(self) -> list[Ids]:
        key = _quoted(self.found.key)
        with _connected(self.found.path) as db:
            low, high = db.execute(f"SELECT min({key}), max({key}) FROM {_quoted(self.found.table)}").fetchone()
        return [] if low is None else [Ids(self.found, i, min(i + self.step - 1, high)) for i in range(low, high + 1, self.step)]

    def _meets(self, data: bytes | None) -> bool:
        """Boxes that are not stored may meet the window; features without a geometry do not."""
        if data is None:
            return False
        x0, y0, x1, y1 = self.window
        box = _box(data)
        return box is None or box[0] <= x1 and box[1] >= x0 and box[2] <= y1 and box[3] >= y0

    def read(self, partition: Ids) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        own, names = partition.layer, [c for c, _ in partition.layer.columns]
        schema = pa.schema([(c, ARROW[k]) for c, k in own.columns])
        columns, key = ", ".join(f"t.{_quoted(c)}" for c in names), f"t.{_quoted(own.key)}"
        text, values = f"SELECT {columns} FROM {_quoted(own.table)} t WHERE {key} BETWEEN ? AND ?", [partition.first, partition.last]
        if self.window and own.index:
            x0, y0, x1, y1 = self.window
            text = f"SELECT {columns} FROM {_quoted(own.table)} t JOIN {_quoted(own.index)} r ON r.id = {key} WHERE {key} BETWEEN ? AND ? AND r.minx <= ? AND r.maxx >= ? AND r.miny <= ? AND r.maxy >= ?"
            values += [x1, x0, y1, y0]
        geometry = names.index(own.geometry)
        with _connected(own.path) as db:
            rows = db.execute(text, values)
            while some := rows.fetchmany(ROWS_AT_ONCE):
                if self.window and not own.index:
                    some = [r for r in some if self._meets(r[geometry])]
                # The file's types bind no value: text in a column of numbers fails the job.
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], f.type) for i, f in enumerate(schema)], schema=schema)


class LayerSource(DataSource):
    """A layer's columns, the geometry in the format's binary form, which ``features.from_wkb`` reads."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _layer(self) -> Layer:
        return layer(self.options["path"], self.options.get("layer"))

    def schema(self) -> str:
        return ", ".join(f"`{c}` {k}" for c, k in self._layer().columns)

    def reader(self, schema: Any) -> LayerReader:
        window = json.loads(self.options["window"]) if "window" in self.options else None
        return LayerReader(self._layer(), window, int(self.options.get("ids_at_once", 100_000)))


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, window: tuple[float, float, float, float] | None = None, ids_at_once: int = 100_000) -> DataFrame:
    """A layer's features; with a window (x0, y0, x1, y1), those whose box meets it, by the spatial index if the file has one."""
    spark.dataSource.register(LayerSource)
    options = ({"layer": layer} if layer else {}) | ({"window": json.dumps(window)} if window else {})
    return spark.read.format("geopackage").options(ids_at_once=ids_at_once, **options).load(path)
