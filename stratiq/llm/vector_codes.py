"""Vector code compression: product codes found by partial-distance search over whole numbers.

Components become floor(256 * x); a vector is cut into ``parts`` equal
consecutive parts.  Each part position has a codebook, which starts as that part of
the vectors with the smallest ids and is refined in rounds: every part goes to the
nearest entry, every entry becomes the floor of its parts' mean.

The search goes through a part's dimensions in descending variance of the
codebook's entries.  The entry that is nearest in the first one is measured whole,
and its distance is the bound; then, dimension by dimension, vectorised masks drop
every entry of every vector whose accumulated distance strictly exceeds the
bound.  Ties therefore survive and go to the lower index.

Each round is one job: tasks search their rows and send partial sums of each
entry, Spark adds them.  The driver sees the codebooks alone, ``parts`` times
``entries`` entries.  All sums are exact, so results agree in any order of rows.

Defined results
---------------
* Vectors that are null, empty, or hold null or non-finite components are left out.
* So are vectors of another length than the smallest id's, and those with a
  component beyond sqrt(2^61 / length) / 256 (some 741,000 at length 64), whose
  squared distances would not fit 64 bits.
* If the length is no multiple of ``parts``, the vector counts as followed by zeros.
* Fewer vectors than ``entries``: the codebooks have as many entries as vectors.
  Equal ids start the codebooks in order of their components; null ids come last.
* Null labels are one label.  Repeated rows give equal results; an empty table
  gives an empty result.
* Further columns are ignored by ``fit`` and ``compress`` and kept by ``encode``;
  ValueError is raised if the input already has a column named like an output.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import looked_up, saved

#: Distances of points to entries that are held in one go.
CELLS = 1 << 16


@dataclass(frozen=True)
class Codebooks:
    #: int64: parts, entries, dimensions of a part.
    entries: np.ndarray
    #: Components of a vector.
    length: int

    @property
    def batch(self) -> int:
        """Vectors searched in one go."""
        return max(1, CELLS // max(1, self.entries.shape[1]))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as rows to vectors, parts, dimensions."""
        parts, _, width = self.entries.shape
        filled = np.zeros((len(vectors), parts * width), np.int64)
        filled[:, : vectors.shape[1]] = vectors
        return filled.reshape(len(vectors), parts, width)

    def search(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part of each vector: the nearest entry's index and its squared distance."""
        codes, errors = np.zeros(cut.shape[:2], np.int64), np.zeros(cut.shape[:2], np.int64)
        for p, book in enumerate(self.entries):
            codes[:, p], errors[:, p] = nearest(cut[:, p], book)
        return codes, errors


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partial-distance search: for each point the nearest entry, the lower index of equals, and the squared distance."""
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    first = points[:, order[0], None] - book[None, :, order[0]]
    first *= first
    guess = first.argmin(axis=1)
    best = ((points - book[guess]) ** 2).sum(axis=1)
    who, entry = np.nonzero(first <= best[:, None])
    so_far = first[who, entry]
    for d in order[1:]:
        so_far += (points[who, d] - book[entry, d]) ** 2
        alive = so_far <= best[who]
        who, entry, so_far = who[alive], entry[alive], so_far[alive]
    # What is left is complete: the guess at least, and all entries that are not farther.
    rank = np.lexsort((entry, so_far, who))
    lead = rank[np.searchsorted(who[rank], np.arange(len(points)))]
    return entry[lead], so_far[lead]


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component; null for vectors that have no such numbers."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    most = F.sqrt(F.lit(2.0**61) / F.greatest(F.size(vector), F.lit(1)))
    # NaN is greater than any number here.
    wrong = F.exists(numbers, lambda x: x.isNull() | (F.abs(x) * 256 > most))
    return F.when((F.size(vector) > 0) & ~F.coalesce(wrong, F.lit(True)), F.transform(numbers, lambda x: F.floor(x * 256)))


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(f"`{id_col}`").alias("_id"), whole(F.col(f"`{vector_col}`")).alias("_v")).filter("_v is not null")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """Codebooks from the vectors of the smallest ids, refined over all vectors."""
    rows = _rows(vectors, id_col, vector_col)
    order = [F.col("_id").asc_nulls_last(), "_v"]
    first = rows.orderBy(*order).first()
    if first is None:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), 0)
    length = len(first["_v"])
    rows = rows.filter(F.size("_v") == length)
    start = np.array([r["_v"] for r in rows.orderBy(*order).limit(entries).collect()], np.int64)  # ``entries`` rows at most
    width = math.ceil(length / parts)
    books = Codebooks(np.zeros((parts, len(start), width), np.int64), length)
    books = Codebooks(books.cut(start).transpose(1, 0, 2).copy(), length)
    for _ in range(rounds):
        books = _refined(rows.select("_v"), books)
    return books


def _refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry used becomes the floor of its parts' mean."""
    parts, entries, width = books.entries.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        count, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for big in batches:
            for start in range(0, big.num_rows, books.batch):
                cut = books.cut(_matrix(big.column(0).slice(start, books.batch)))
                at = (books.search(cut)[0] + np.arange(parts) * entries).ravel()
                count += np.bincount(at, minlength=len(count))
                np.add.at(sums, at, cut.reshape(-1, width))
        used = np.flatnonzero(count)
        if len(used):
            cell = np.repeat(used * width, width) + np.tile(np.arange(width), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.repeat(count[used], width)), pa.array(sums[used].ravel())], names=["cell", "n", "total"])

    exact = F.sum(F.col("total").cast("decimal(38,0)"))
    found = rows.mapInArrow(run, "cell long, n long, total long").groupBy("cell").agg(F.sum("n").alias("n"), exact.alias("total")).collect()  # a row for each component of an entry
    flat = books.entries.copy().reshape(-1)
    for r in found:
        flat[r["cell"]] = int(r["total"]) // r["n"]
    return Codebooks(flat.reshape(books.entries.shape), books.length)


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector can be coded, with code (two hex digits, or as many as the entries need, for each part) and error (squared distance to what the code stands for)."""
    if clash := {"code", "error"} & set(vectors.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    spare = "_v"
    while spare in vectors.columns:
        spare += "_"
    rows = vectors.withColumn(spare, whole(F.col(f"`{vector_col}`"))).filter(F.size(spare) == books.length)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        digits = max(2, len(f"{max(0, books.entries.shape[1] - 1):x}"))
        names = np.array([f"{i:0{digits}x}" for i in range(books.entries.shape[1])])
        for big in batches:
            for start in range(0, big.num_rows, books.batch):
                batch = big.slice(start, books.batch)
                codes, errors = books.search(books.cut(_matrix(batch.column(batch.num_columns - 1))))
                added = [pa.array(["".join(x) for x in names[codes]], pa.string()), pa.array(errors.sum(axis=1), pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "code", "error"])

    return rows.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", out_col: str = "decoded") -> DataFrame:
    """The input with the vector that each code stands for (array<double>); a null code gives null."""
    if out_col in codes.columns:
        raise ValueError(f"the input already has {out_col}")
    shared = codes.sparkSession.sparkContext.broadcast(books)
    at = codes.columns.index(code_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, entries, _ = books.entries.shape
        digits = max(2, len(f"{max(0, entries - 1):x}"))
        for batch in batches:
            out = []
            for code in batch.column(at).to_pylist():
                places = [int(code[i : i + digits], 16) for i in range(0, len(code), digits)] if code is not None else None
                # The middle of what floor() takes together.
                out.append(None if places is None else (books.entries[np.arange(parts), places].ravel()[: books.length] + 0.5) / 256)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, out_col])

    return codes.mapInArrow(run, T.StructType([*codes.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))]))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """One row per vector that can be coded: id, code, error, label_error (the errors' sum over its label), codebooks_sha256."""
    books = fit(vectors, id_col, vector_col, parts, entries, rounds)
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{label_col}`").cast("string")), F.lit(""))
    slim = vectors.select(F.col(f"`{id_col}`").alias("_id"), key.alias("_key"), F.col(f"`{vector_col}`").alias("_vector"))
    coded = saved(encode(slim, books, "_vector").drop("_vector"), "vector-codes")
    totals = saved(coded.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "vector-labels")
    found = looked_up(coded, "_key", totals, "label_error", totals)
    return found.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
