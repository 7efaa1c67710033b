"""GeoTIFF and classic NetCDF files as Spark data sources, and their writers.

Partitions are runs of blocks (strips or tiles) or of time steps.  A window of
places or times is known to the source: what lies outside is never read.  Headers are
read when the plan is built, a few at a time; files may lie wherever pyarrow's
file systems reach.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratiq.operators.reproject import Lattice

#: Fixed values of the TIFF format: struct codes and bytes by field type, numpy kinds by sample format.
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q"}
SAMPLES = {1: "u", 2: "i", 3: "f"}
DEFLATE = (8, 32946)
#: Fixed values of the NetCDF format: numpy kinds by type, seconds by unit of time.
TYPES = {1: "i1", 2: "S1", 3: "i2", 4: "i4", 5: "f4", 6: "f8", 7: "u1", 8: "u2", 9: "u4", 10: "i8", 11: "u8"}
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def _files(path: str, endings: Sequence[str]) -> list[str]:
    """The file itself, or the files below a folder whose names end so and do not begin with _ or a dot."""
    system, at = _opened(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = [i.path for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File]
    front = path[: path.index(at)] if at in path else ""
    return sorted(front + f for f in found if f.lower().endswith(tuple(endings)) and f.rsplit("/", 1)[-1][0] not in "._")


def _write_file(path: str, name: str, data: bytes) -> str:
    """Written aside and moved, so that a lost or repeated task leaves no part of a file."""
    system, at = _opened(path)
    system.create_dir(at, recursive=True)
    aside = f"{at}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(data)
    system.move(aside, f"{at}/{name}")
    return f"{at}/{name}"


class Bounds:
    """Closed ranges of columns, from options named after them: ``row`` = ``[4, 5]``."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.kept = {c: json.loads(options[c]) for c in ("row", "col", "x", "y", "ts") if c in options}
        if "ts" in self.kept:
            self.kept["ts"] = [datetime.fromisoformat(t) for t in self.kept["ts"]]

    def meets(self, name: str, first: Any, last: Any) -> bool:
        """Whether a value from ``first`` to ``last``, in either order, may lie in the range."""
        low, high = self.kept.get(name, (None, None))
        return low is None or (max(first, last) >= low and min(first, last) <= high)


@dataclass(frozen=True)
class Tiff:
    """What a file's first directory says."""

    path: str
    width: int
    height: int
    bands: int
    kind: str
    packed: bool
    differences: bool
    planar: bool
    block: tuple[int, int]
    places: tuple[tuple[int, int], ...]
    across: int
    x0: float
    y0: float
    dx: float
    dy: float
    nodata: float | None

    @property
    def tiled(self) -> bool:
        return self.block[1] != self.width

    def extent(self, i: int) -> tuple[int, int, int, int]:
        """First row, rows, first column, columns of a block within the grid."""
        row, col = i // self.across * self.block[0], i % self.across * self.block[1]
        return row, min(self.block[0], self.height - row), col, min(self.block[1], self.width - col)


def tiff_header(path: str) -> Tiff:
    """The header of a TIFF or BigTIFF; ValueError where its values are stored in a way that is not read."""
    system, at = _opened(path)
    with system.open_input_file(at) as f:
        start = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        version = struct.unpack(f"{order}H", start[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError(f"no TIFF: {path}")
        big = version == 43
        where = struct.unpack(f"{order}Q", start[8:16])[0] if big else struct.unpack(f"{order}I", start[4:8])[0]
        number, entry, inline = ("Q", "HHQ8s", 8) if big else ("H", "HHI4s", 4)
        f.seek(where)
        (count,) = struct.unpack(f"{order}{number}", f.read(struct.calcsize(f"={number}")))
        size = struct.calcsize(f"={entry}")
        raw, tags = f.read(count * size), {}
        for i in range(count):
            tag, field, n, value = struct.unpack_from(f"{order}{entry}", raw, i * size)
            if field not in FIELDS:
                continue
            code, length = FIELDS[field], struct.calcsize(f"={FIELDS[field]}") * n
            if length > inline:
                f.seek(struct.unpack(f"{order}{'Q' if big else 'I'}", value)[0])
                value = f.read(length)
            tags[tag] = value[:n].rstrip(b"\0").decode("latin-1") if code == "s" else struct.unpack_from(f"{order}{n}{code}", value)
    one = lambda tag, other=None: tags[tag][0] if tag in tags else other
    width, height, bands = one(256), one(257), one(277, 1)
    bits, packing, predictor = set(tags.get(258, (1,))), one(259, 1), one(317, 1)
    kinds = set(tags.get(339, (1,)))
    if len(bits) > 1 or len(kinds) > 1 or not bits <= {8, 16, 32, 64} or not kinds <= set(SAMPLES):
        raise ValueError(f"samples of {sorted(bits)} bits, formats {sorted(kinds)}: {path}")
    if packing not in (1, *DEFLATE) or predictor not in (1, 2):
        raise ValueError(f"compression {packing} with predictor {predictor}: {path}")
    shape = (one(323), one(322)) if 322 in tags else (min(one(278, height), height), width)
    offsets, counts = tags.get(324) or tags[273], tags.get(325) or tags[279]
    scale, tie, matrix = tags.get(33550), tags.get(33922), tags.get(34264)
    if matrix and (matrix[1] or matrix[4]):
        raise ValueError(f"rotated grid: {path}")
    dx, dy = (matrix[0], matrix[5]) if matrix else (scale[0], -scale[1]) if scale else (1.0, 1.0)
    x0, y0 = (matrix[3], matrix[7]) if matrix else (tie[3] - tie[0] * dx, tie[4] - tie[1] * dy) if tie else (0.0, 0.0)
    text = tags.get(42113, "").strip()
    kind = f"{order}{SAMPLES[kinds.pop()]}{bits.pop() // 8}"
    if predictor == 2 and kind[1] == "f":
        raise ValueError(f"differences of floating numbers: {path}")
    places = tuple(zip(offsets, counts, strict=True))
    return Tiff(path, width, height, bands, kind, packing != 1, predictor == 2, one(284, 1) == 2, shape, places, math.ceil(width / shape[1]), x0, y0, dx, dy, float(text) if text else None)


def tiff_block(header: Tiff, i: int, f: Any) -> np.ndarray:
    """The values of a block: bands, rows, columns."""
    _, rows, _, cols = header.extent(i)
    each, out = math.ceil(header.height / header.block[0]) * header.across, []
    held = header.block[0] if header.tiled else rows
    for part in range(header.bands if header.planar else 1):
        offset, count = header.places[i + part * each]
        f.seek(offset)
        data = f.read(count)
        deep = 1 if header.planar else header.bands
        values = np.frombuffer(zlib.decompress(data) if header.packed else data, header.kind)
        # A tile is stored whole, also beyond the grid's edge; so may the last strip be.
        values = values.reshape(-1, header.block[1], deep)[: max(held, rows)]
        if header.differences:
            values = np.cumsum(values, axis=1, dtype=values.dtype)
        out.append(np.moveaxis(values[:rows, :cols], 2, 0))
    return np.concatenate(out)


@dataclass
class Blocks(InputPartition):
    header: Any
    blocks: tuple[int, ...]


class TiffReader(DataSourceReader):
    def __init__(self, path: str, cells_at_once: int, bounds: Bounds) -> None:
        self.path, self.cells_at_once, self.bounds = path, cells_at_once, bounds

    def _wanted(self, h: Tiff, i: int) -> bool:
        row, rows, col, cols = h.extent(i)
        b = self.bounds
        middle = lambda at, start, step: start + (at + 0.5) * step
        return (
            b.meets("row", row, row + rows - 1) and b.meets("col", col, col + cols - 1)
            and b.meets("x", middle(col, h.x0, h.dx), middle(col + cols - 1, h.x0, h.dx)) and b.meets("y", middle(row, h.y0, h.dy), middle(row + rows - 1, h.y0, h.dy))
        )

    def partitions(self) -> list[Blocks]:
        out, bands = [], None
        with ThreadPoolExecutor(16) as pool:
            for h in pool.map(tiff_header, _files(self.path, (".tif", ".tiff"))):
                if bands not in (None, h.bands):
                    raise ValueError(f"{h.bands} bands, others have {bands}: {h.path}")
                bands = h.bands
                found = [i for i in range(math.ceil(h.height / h.block[0]) * h.across) if self._wanted(h, i)]
                step = max(1, self.cells_at_once // (h.block[0] * h.block[1]))
                out += [Blocks(h, tuple(found[i : i + step])) for i in range(0, len(found), step)]
        return out

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        h = partition.header
        system, at = _opened(h.path)
        with system.open_input_file(at) as f:
            for i in partition.blocks:
                row, rows, col, cols = h.extent(i)
                r, c = np.repeat(np.arange(row, row + rows), cols), np.tile(np.arange(col, col + cols), rows)
                values = tiff_block(h, i, f).reshape(h.bands, -1).astype(float)
                lost = np.isnan(values) if h.nodata is None else np.isnan(values) | (values == h.nodata)
                arrays = [pa.array([h.path] * len(r)), pa.array(r), pa.array(c), pa.array(h.x0 + (c + 0.5) * h.dx), pa.array(h.y0 + (r + 0.5) * h.dy), *[pa.array(v, mask=m) for v, m in zip(values, lost, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "row", "col", "x", "y", *[f"b{k + 1}" for k in range(h.bands)]])


class TiffSource(DataSource):
    """Cells of GeoTIFF files: path, row, col, x, y (of the middle) and b1, b2, ... for the bands."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        found = _files(self.options["path"], (".tif", ".tiff"))
        if not found:
            raise ValueError(f"no TIFF below {self.options['path']}")
        return "path string, row long, col long, x double, y double, " + ", ".join(f"b{k + 1} double" for k in range(tiff_header(found[0]).bands))

    def reader(self, schema: Any) -> TiffReader:
        return TiffReader(self.options["path"], int(self.options.get("cells_at_once", 1 << 22)), Bounds(self.options))


def tiff_bytes(values: np.ndarray, x0: float, y0: float, dx: float, dy: float, nodata: float = -99999.0, strip: int = 64) -> bytes:
    """A little-endian GeoTIFF of doubles (bands, rows, columns), deflated by strips; NaN as ``nodata``."""
    bands, height, width = values.shape
    flat = np.moveaxis(np.where(np.isnan(values), nodata, values), 0, 2).astype("<f8")
    parts = [zlib.compress(flat[i : i + strip].tobytes()) for i in range(0, height, strip)]
    offsets = np.cumsum([8, *map(len, parts)]).tolist()
    text = f"{nodata!r}\0".encode()
    matrix = (dx, 0, 0, x0, 0, dy, 0, y0, 0, 0, 0, 0, 0, 0, 0, 1)
    # GTModelType 1, GTRasterType 1 (cells are areas): the projection itself is the caller's to know.
    keys = (1, 1, 0, 2, 1024, 0, 1, 1, 1025, 0, 1, 1)
    fields = [
        (256, "I", (width,)), (257, "I", (height,)), (258, "H", (64,) * bands), (259, "H", (8,)), (262, "H", (1,)), (273, "I", offsets[:-1]), (277, "H", (bands,)), (278, "I", (strip,)),
        (279, "I", [len(p) for p in parts]), (284, "H", (1,)), (339, "H", (3,) * bands), (34264, "d", matrix), (34735, "H", keys), (42113, "s", text),
    ]
    at, entries, more = offsets[-1], [], b""
    after = at + 2 + 12 * len(fields) + 4
    number = {"H": 3, "I": 4, "d": 12, "s": 2}
    for tag, code, content in fields:
        data = content if code == "s" else struct.pack(f"<{len(content)}{code}", *content)
        if len(data) > 4:
            entries.append(struct.pack("<HHII", tag, number[code], len(content), after + len(more)))
            more += data + b"\0" * (len(data) % 2)
        else:
            entries.append(struct.pack("<HHI4s", tag, number[code], len(content), data))
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(parts) + struct.pack("<H", len(fields)) + b"".join(entries) + b"\0\0\0\0" + more


def _square(table: pa.Table, names: Sequence[str], tile: int, rows: int, cols: int) -> tuple[int, int, np.ndarray]:
    """First row and column of a tile and its values, NaN where it has no cell."""
    r, c = table["row"].to_numpy(), table["col"].to_numpy()
    r0, c0 = int(r[0]) // tile * tile, int(c[0]) // tile * tile
    values = np.full((len(names), min(tile, rows - r0), min(tile, cols - c0)), np.nan)
    for i, n in enumerate(names):
        values[i, r - r0, c - c0] = table[n].to_numpy()
    return r0, c0, values


def write_tiffs(grid: DataFrame, names: Sequence[str], path: str, lattice: Lattice, tile: int = 512) -> int:
    """Bands of a grid (row, col, one row a cell) as GeoTIFF files of at most ``tile`` rows and columns; their number.

    Cells outside of the lattice go; tiles without a cell have no file.  A task
    holds one tile, and its file appears whole or not at all.
    """
    names = list(names)

    def write(table: pa.Table) -> pa.Table:
        r0, c0, values = _square(table, names, tile, lattice.rows, lattice.cols)
        data = tiff_bytes(values, lattice.x0 + c0 * lattice.dx, lattice.y0 + r0 * lattice.dy, lattice.dx, lattice.dy)
        return pa.table({"path": [_write_file(path, f"{r0}_{c0}.tif", data)]})

    inside = grid.filter(F.col("row").between(0, lattice.rows - 1) & F.col("col").between(0, lattice.cols - 1))
    cells = inside.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))).alias(n) for n in names])
    return cells.groupBy(F.floor(F.col("row") / tile).alias("_r"), F.floor(F.col("col") / tile).alias("_c")).applyInArrow(_without_key(write), "path string").count()


def _without_key(write: Any) -> Any:
    def one(_: Any, table: pa.Table) -> pa.Table:
        return write(table)

    return one


@dataclass(frozen=True)
class Cube:
    """What a NetCDF header says of the variables over (time, y, x)."""

    path: str
    names: tuple[str, ...]
    kinds: tuple[str, ...]
    begins: tuple[int, ...]
    strides: tuple[int, ...]
    attributes: tuple[dict[str, Any], ...]
    times: tuple[datetime, ...]
    xs: tuple[float, ...]
    ys: tuple[float, ...]


def _times(values: np.ndarray, units: str) -> tuple[datetime, ...]:
    found = re.match(r"\s*(\w+?)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+))?)?", units)
    if not found or found[1] not in SECONDS:
        raise ValueError(f"units of time: {units}")
    start = datetime(*(int(v or 0) for v in found.groups()[1:]))
    return tuple(start + timedelta(seconds=float(v) * SECONDS[found[1]]) for v in values)


def cube_header(path: str) -> Cube:
    """The header of a classic NetCDF file (64-bit forms too) and its axes; ValueError for other files, or without a cube."""
    system, at = _opened(path)
    with system.open_input_file(at) as f:
        if f.read(3) != b"CDF":
            raise ValueError(f"no classic NetCDF: {path}")
        version = f.read(1)[0]
        count, place = (">q", ">q") if version == 5 else (">i", ">q" if version == 2 else ">i")
        get = lambda code: struct.unpack(code, f.read(struct.calcsize(code)))[0]

        def padded(n: int) -> bytes:
            return f.read(n + -n % 4)[:n]

        def name() -> str:
            return padded(get(count)).decode()

        def attributes() -> dict[str, Any]:
            get(">i")
            found = {}
            for _ in range(get(count)):
                key, kind, n = name(), TYPES[get(">i")], get(count)
                data = padded(n * int(kind[1]))
                found[key] = data.decode("latin-1").rstrip("\0") if kind == "S1" else np.frombuffer(data, f">{kind}").tolist()[0] if n else None
            return found

        records = get(count)
        get(">i")
        sizes = [(name(), get(count)) for _ in range(get(count))]
        attributes()
        get(">i")
        variables, record = {}, []
        for _ in range(get(count)):
            key = name()
            dims = [get(count) for _ in range(get(count))]
            own, kind = attributes(), TYPES[get(">i")]
            get(count)
            begin = get(place)
            over_records = bool(dims) and sizes[dims[0]][1] == 0
            shape = [records if sizes[d][1] == 0 else sizes[d][1] for d in dims]
            each = math.prod(shape[1:] if dims else []) * int(kind[1])
            variables[key] = (dims, own, kind, begin, shape, each, over_records)
            if over_records:
                record.append(each)
        # Records are padded to 4 bytes, except where one variable alone makes them up.
        width = record[0] if len(record) == 1 else sum(n + -n % 4 for n in record)
        stride = lambda v: width if v[6] else v[5]

        def axis(d: int) -> np.ndarray:
            v = variables.get(sizes[d][0])
            if v is None or v[0] != [d]:
                return np.arange(records if sizes[d][1] == 0 else sizes[d][1], dtype=float)
            step = stride(v)
            out = []
            for i in range(v[4][0]) if v[6] else (0,):
                f.seek(v[3] + i * step)
                out.append(np.frombuffer(f.read(v[5] if v[6] else v[4][0] * int(v[2][1])), f">{v[2]}"))
            return np.concatenate(out).astype(float) if out else np.empty(0)

        cubes = {n: v for n, v in variables.items() if len(v[0]) == 3 and v[2] != "S1"}
        if not cubes:
            raise ValueError(f"no variable over time, y and x: {path}")
        t, y, x = next(iter(cubes.values()))[0]
        cubes = {n: v for n, v in cubes.items() if v[0] == [t, y, x]}
        times = variables.get(sizes[t][0])
        if times is None:
            raise ValueError(f"no axis of time: {path}")
        return Cube(
            path, tuple(cubes), tuple(v[2] for v in cubes.values()), tuple(v[3] for v in cubes.values()), tuple(stride(v) for v in cubes.values()), tuple(v[1] for v in cubes.values()),
            _times(axis(t), str(times[1].get("units", ""))), tuple(axis(x).tolist()), tuple(axis(y).tolist()),
        )


class CubeReader(DataSourceReader):
    def __init__(self, path: str, names: Sequence[str], cells_at_once: int, bounds: Bounds) -> None:
        self.path, self.names, self.cells_at_once, self.bounds = path, list(names), cells_at_once, bounds

    def partitions(self) -> list[Blocks]:
        out, b = [], self.bounds
        with ThreadPoolExecutor(16) as pool:
            for h in pool.map(cube_header, _files(self.path, (".nc",))):
                if list(h.names) != self.names:
                    raise ValueError(f"variables {list(h.names)}, others have {self.names}: {h.path}")
                cells = len(h.xs) * len(h.ys)
                if not cells or not (b.meets("x", min(h.xs), max(h.xs)) and b.meets("y", min(h.ys), max(h.ys))):
                    continue
                found = [i for i, t in enumerate(h.times) if b.meets("ts", t, t)]
                step = max(1, self.cells_at_once // cells)
                out += [Blocks(h, tuple(found[i : i + step])) for i in range(0, len(found), step)]
        return out

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        h = partition.header
        system, at = _opened(h.path)
        rows, cols = np.repeat(np.arange(len(h.ys)), len(h.xs)), np.tile(np.arange(len(h.xs)), len(h.ys))
        x, y = np.array(h.xs)[cols], np.array(h.ys)[rows]
        with system.open_input_file(at) as f:
            for i in partition.blocks:
                arrays = [pa.array([h.times[i]] * len(rows), pa.timestamp("us")), pa.array(rows), pa.array(cols), pa.array(x), pa.array(y)]
                for kind, begin, stride, own in zip(h.kinds, h.begins, h.strides, h.attributes, strict=True):
                    f.seek(begin + i * stride)
                    raw = np.frombuffer(f.read(len(rows) * int(kind[1])), f">{kind}").astype(float)
                    lost = np.isnan(raw)
                    for key in ("_FillValue", "missing_value"):
                        if own.get(key) is not None:
                            lost |= raw == own[key]
                    arrays.append(pa.array(raw * own.get("scale_factor", 1.0) + own.get("add_offset", 0.0), mask=lost))
                yield pa.RecordBatch.from_arrays(arrays, names=["ts", "row", "col", "x", "y", *h.names])


class CubeSource(DataSource):
    """Cells of NetCDF cubes: ts, row, col, x, y and a column for each variable over (time, y, x), scaled, fill values null."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _first(self) -> Cube:
        found = _files(self.options["path"], (".nc",))
        if not found:
            raise ValueError(f"no NetCDF below {self.options['path']}")
        return cube_header(found[0])

    def schema(self) -> str:
        return "ts timestamp_ntz, row long, col long, x double, y double, " + ", ".join(f"`{n}` double" for n in self._first().names)

    def reader(self, schema: Any) -> CubeReader:
        return CubeReader(self.options["path"], self._first().names, int(self.options.get("cells_at_once", 1 << 22)), Bounds(self.options))


def cube_bytes(values: np.ndarray, name: str, times: Sequence[int], xs: Sequence[float], ys: Sequence[float], fill: float = -9999.0) -> bytes:
    """A NetCDF file (64-bit offsets) of one variable over (time, y, x), times in seconds since 1970."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    unit = "seconds since 1970-01-01 00:00:00"
    units = struct.pack(">ii", 12, 1) + text("units") + struct.pack(">i", 2) + text(unit)
    filled = struct.pack(">ii", 12, 1) + text("_FillValue") + struct.pack(">iid", 6, 1, fill)
    nothing = struct.pack(">ii", 0, 0)
    data = [np.asarray(times, ">f8"), np.asarray(ys, ">f8"), np.asarray(xs, ">f8"), np.where(np.isnan(values), fill, values).astype(">f8")]

    def header(begins: Sequence[int]) -> bytes:
        dims = struct.pack(">ii", 10, 3) + b"".join(text(n) + struct.pack(">i", s) for n, s in zip(("time", "y", "x"), values.shape, strict=True))
        entries = [("time", (0,), units), ("y", (1,), nothing), ("x", (2,), nothing), (name, (0, 1, 2), filled)]
        own = b"".join(text(n) + struct.pack(f">i{len(d)}i", len(d), *d) + a + struct.pack(">iiq", 6, min(v.nbytes, 2**31 - 4), b) for (n, d, a), v, b in zip(entries, data, begins, strict=True))
        return b"CDF\x02" + struct.pack(">i", 0) + dims + nothing + struct.pack(">ii", 11, 4) + own

    begins = np.cumsum([len(header([0] * 4)), *[v.nbytes for v in data[:-1]]]).tolist()
    return header(begins) + b"".join(v.tobytes() for v in data)


def write_cubes(df: DataFrame, value: str, path: str, lattice: Lattice, ts: str = "ts", tile: int = 128) -> int:
    """A value of cells and times (row, col, one row each) as NetCDF files, one for each tile and day; their number.

    Times are whole seconds.  A file's times are those of its day's rows; a task
    holds one tile's day.  Cells outside of the lattice, and rows without a time, go.
    """

    def write(table: pa.Table) -> pa.Table:
        at = table["_t"].to_numpy()
        times, step = np.unique(at, return_inverse=True)
        r, c = table["row"].to_numpy(), table["col"].to_numpy()
        r0, c0 = int(r[0]) // tile * tile, int(c[0]) // tile * tile
        values = np.full((len(times), min(tile, lattice.rows - r0), min(tile, lattice.cols - c0)), np.nan)
        values[step, r - r0, c - c0] = table["_v"].to_numpy()
        ys = lattice.y0 + (r0 + np.arange(values.shape[1]) + 0.5) * lattice.dy
        xs = lattice.x0 + (c0 + np.arange(values.shape[2]) + 0.5) * lattice.dx
        return pa.table({"path": [_write_file(path, f"{int(times[0]) // 86400}_{r0}_{c0}.nc", cube_bytes(values, value, times.tolist(), xs, ys))]})

    inside = df.filter(F.col("row").between(0, lattice.rows - 1) & F.col("col").between(0, lattice.cols - 1) & F.col(ts).isNotNull())
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    cells = inside.select(seconds.alias("_t"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("_v"))
    groups = cells.groupBy(F.floor(F.col("_t") / 86400).alias("_d"), F.floor(F.col("row") / tile).alias("_r"), F.floor(F.col("col") / tile).alias("_c"))
    return groups.applyInArrow(_without_key(write), "path string").count()


def read_files(spark: SparkSession, kind: str, path: str, cells_at_once: int = 1 << 22, **window: tuple[Any, Any]) -> DataFrame:
    """``geotiff`` or ``netcdf`` files: the file at ``path``, or all below a folder.

    ``window`` names closed ranges of row, col, x, y or ts (ISO text); blocks and
    time steps outside of them are not read, and other cells are filtered out.
    The ranges are options of each read: Spark's push-down into Python sources is
    not used, as it keeps one query's filters for the next query of the same
    DataFrame (seen in 4.1: a count behind a filtered one lost rows).
    """
    for source in (TiffSource, CubeSource):
        spark.dataSource.register(source)
    options = {c: json.dumps([str(v) if c == "ts" else v for v in ends]) for c, ends in window.items()}
    found = spark.read.format(kind).options(cells_at_once=cells_at_once, **options).load(path)
    for c, ends in window.items():
        low, high = (F.lit(v).cast("timestamp_ntz") if c == "ts" else F.lit(v) for v in ends)
        found = found.filter(F.col(c).between(low, high))
    return found
