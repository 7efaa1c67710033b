"""Line deduplication: sorted line hashes, streamed once, and compressed keep bitmaps in place of texts.

A line's key is the line without ASCII white space at both ends, A-Z in lower
case.  Keys of at least ``least_chars`` code points that ``least_docs`` documents
or more hold lose their lines in all documents but the largest id.

Each such line becomes a few numbers: 128 bits of hash, the document, the
position.  They are range-partitioned by hash and document, with splitters that
Spark samples, and each partition is sorted by hash, document (largest first) and
position.  One pass over the sorted rows then numbers the documents of each hash:
the first one keeps its lines, the third and all further ones lose theirs, and the
second one's lines wait, in a buffer of bounded size, until a third turns up or the
hash ends.

A hash that very many documents hold is cut by the splitters as well, between
two documents.  A partition can't decide the first two documents of the hash it
begins with, nor the second one of the hash it ends with: such lines are emitted
as open, with one count of documents for each partition and hash, and the sum of
these counts decides them.

The dropped positions of a document become one bitmap of bits to keep, packed and
compressed.  Only documents that lose a line have one; texts are not shuffled but
by the join that applies bitmaps to texts.

Different keys share a hash with probability n^2 / 2^129 for n lines.

Defined results
---------------
* Null and empty texts are one empty line, which stays.
* Rows that share an id are one document; each row has its own bitmap.
* A null id is less than any other; such rows are one document for each text, in
  the order of the texts' 64-bit hashes.
* Repeated rows give equal results; an empty table gives an empty result.
* Further columns are ignored by ``bitmaps`` and ``digest`` and returned unchanged
  by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, shuffle_parts

BLANKS = " \t\n\x0b\x0c\r"
#: Waiting lines that a task holds at most.
HELD = 20_000
#: What a row of the pass says: a line that waits for other partitions, a line to drop, a count of documents.
OPEN, DROP, COUNT = 0, 1, 2


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _sorted(rows: DataFrame, least_chars: int) -> DataFrame:
    """_a, _b (hash), _id, _own (of rows without id: the text's hash), _t (the text's hash), _pos, sorted within ranges of hash and document."""
    lines = rows.select("_id", F.xxhash64("_text").alias("_t"), F.posexplode(lines_of(F.col("_text"))).alias("_pos", "_line"))
    lines = lines.withColumn("_key", key_of(F.col("_line"))).filter(F.length("_key") >= least_chars)
    own = F.when(F.col("_id").isNull(), F.col("_t"))
    lines = lines.select(F.xxhash64("_key").alias("_a"), F.xxhash64(F.lit("line"), "_key").alias("_b"), "_id", own.alias("_own"), "_t", "_pos")
    order = ["_a", "_b", F.col("_id").desc_nulls_last(), F.col("_own").desc_nulls_last()]
    # Written once: the sample of splitters and the sort read numbers, not texts.
    lines = saved(lines, "line-hashes")
    return lines.repartitionByRange(shuffle_parts(rows.sparkSession), *order).sortWithinPartitions(*order, "_t", "_pos")


def _differs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """For each row but the first: has it another hash, another document than the row before."""

    def changed(name: str) -> np.ndarray:
        column = batch.column(batch.schema.get_field_index(name))
        before, after = column.slice(0, len(column) - 1), column.slice(1)
        apart = pc.xor(pc.is_null(before), pc.is_null(after))
        return pc.coalesce(pc.not_equal(before, after), apart).to_numpy(zero_copy_only=False)

    key = changed("_a") | changed("_b")
    return key, key | changed("_id") | changed("_own")


class Pass:
    """One partition's rows in order; what is decided comes out batch by batch."""

    def __init__(self, part: int, least_docs: int, held: int = HELD):
        self.part, self.least, self.most = part, least_docs, held
        self.last: pa.RecordBatch | None = None  # the row before
        self.docs = 0  # documents of its hash so far
        self.head, self.opened = True, False  # is it the partition's first hash; are lines of it emitted as open
        self.held: list[tuple[pa.RecordBatch, np.ndarray]] = []

    def rows(self, batch: pa.RecordBatch, kind: int, n: np.ndarray) -> pa.RecordBatch:
        added = [pa.array(np.full(len(n), kind, np.int32)), pa.array(np.full(len(n), self.part, np.int32)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*added, *batch.columns], names=["_kind", "_part", "_n", *batch.schema.names])

    def released(self, kind: int) -> Iterator[pa.RecordBatch]:
        """The waiting lines, as open ones or as dropped ones."""
        for batch, rank in self.held:
            yield self.rows(batch, kind, rank)
        self.held = []

    def step(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = batch.num_rows
        first = self.last is None
        both = batch if first else pa.Table.from_batches([self.last, batch]).combine_chunks().to_batches()[0]
        new_key, new_doc = _differs(both)
        if first:
            new_key, new_doc = np.append(True, new_key), np.append(True, new_doc)
        run, docs, starts = np.cumsum(new_key), np.cumsum(new_doc), np.flatnonzero(new_key)
        # Runs of one hash: 0 continues the hash before (and may be empty), the last one may go on.
        rank = docs - np.concatenate([[-self.docs], docs[starts] - 1])[run]
        ends = np.append(starts, size) - 1
        total = np.where(ends >= 0, rank[ends], self.docs)
        head_run = 1 if first else 0 if self.head else -1
        at_head, all_docs, last_run = run == head_run, total[run], len(starts)

        if total[0] >= self.least:
            yield from self.released(DROP)
        elif last_run:
            self.held = []
        drop = (rank >= max(2, self.least)) | (~at_head & (rank > 1) & (all_docs >= self.least))
        for kind, mask in ((DROP, drop), (OPEN, at_head & ~drop)):
            if mask.any():
                yield self.rows(batch.filter(pa.array(mask)), kind, rank[mask])
        if last_run and not first and (self.head or self.opened):
            yield self.rows(self.last, COUNT, total[:1])
        if first and last_run > 1:
            yield self.rows(batch.slice(0, 1), COUNT, total[1:2])
        if last_run:
            self.head, self.opened = head_run == last_run, False
        wait = ~at_head & (rank > 1) & (run == last_run) & (all_docs < self.least)
        if wait.any():
            self.held.append((batch.filter(pa.array(wait)), rank[wait]))
            if sum(len(n) for _, n in self.held) > self.most:
                self.opened = True
                yield from self.released(OPEN)
        self.docs, self.last = int(total[-1]), batch.slice(size - 1, 1)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.last is not None:
            yield from self.released(OPEN)
            yield self.rows(self.last, COUNT, np.array([self.docs]))


def _dropped(rows: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """_id, _t, _pos of the lines to drop."""
    lines = _sorted(rows, least_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Pass(TaskContext.get().partitionId(), least_docs)
        for batch in batches:
            if batch.num_rows:
                yield from state.step(batch)
        yield from state.end()

    fields = [T.StructField("_kind", T.IntegerType()), T.StructField("_part", T.IntegerType()), T.StructField("_n", T.LongType())]
    found = saved(lines.mapInArrow(run, T.StructType([*fields, *lines.schema.fields])), "line-pass")
    counts = found.filter(F.col("_kind") == COUNT).groupBy("_a", "_b").agg(F.sum("_n").alias("_docs"), F.min("_part").alias("_first"))
    largest = (F.col("_n") == 1) & (F.col("_part") == F.col("_first"))
    late = found.filter(F.col("_kind") == OPEN).join(counts, ["_a", "_b"]).filter((F.col("_docs") >= least_docs) & ~largest)
    return found.filter(F.col("_kind") == DROP).select("_id", "_t", "_pos").unionByName(late.select("_id", "_t", "_pos"))


def packed(positions: Iterable[int]) -> bytes:
    """The compressed bits of the lines to keep, up to the last dropped one and filled with ones to whole bytes; lines beyond stay."""
    at = np.fromiter(positions, np.int64)
    keep = np.ones(int(at.max()) // 8 * 8 + 8, bool)
    keep[at] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little").astype(bool)
    return np.append(bits, np.ones(max(0, n_lines - len(bits)), bool))[:n_lines]


def remaining(text: str, bitmap: bytes) -> str:
    lines = text.split("\n")
    return "\n".join([lines[i] for i in np.flatnonzero(unpacked(bitmap, len(lines)))])


def _marked(docs: DataFrame, id_col: str, text_col: str, least_chars: int, least_docs: int, keep: bool) -> DataFrame:
    """_id, _row (the input row, with ``keep``), _text, _dropped, _keep (null where nothing is dropped)."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep else []
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), *kept)
    gone = _dropped(rows.select("_id", "_text"), least_chars, least_docs).groupBy("_id", "_t").agg(F.collect_set("_pos").alias("_gone"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            columns = [batch.column(0), batch.column(1), pa.array(map(len, lists), pa.int64()), pa.array(map(packed, lists), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_doc", "_t", "_dropped", "_keep"])

    kind = rows.schema["_id"].dataType
    bits = gone.mapInArrow(pack, T.StructType([T.StructField("_doc", kind), *T._parse_datatype_string("_t long, _dropped long, _keep binary").fields]))
    bits = saved(bits, "line-bits")
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    # Bitmaps are the small side, but grow with the table: the same plan at every size.
    return rows.join(bits.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_t")), "left").drop("_doc", "_t", "_hash")


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, keep (compressed bits up to the last dropped line; null where all lines stay)."""
    found = _marked(docs, id_col, text_col, least_chars, least_docs, False)
    return found.select(F.col("_id").alias(id_col), F.size(lines_of(F.col("_text"))).cast("long").alias("n_lines"), F.coalesce("_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.col("_keep").alias("keep"))


def _texts(found: DataFrame, name: str, make) -> DataFrame:
    """``found`` with a string made of the remaining text where a bitmap is, null elsewhere; other texts stay on the JVM's side."""
    touched = found.withColumn("_text", F.when(F.col("_keep").isNotNull(), F.col("_text")))
    at = [touched.columns.index(c) for c in ("_text", "_keep")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if bits is None else make(remaining(text, bits)) for text, bits in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, name])

    return touched.mapInArrow(run, T.StructType([*touched.schema.fields, T.StructField(name, T.StringType())]))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, kept_sha256."""
    found = _marked(docs, id_col, text_col, least_chars, least_docs, False)
    whole = F.when(F.col("_keep").isNull(), F.sha2(F.encode("_text", "UTF-8"), 256))
    found = found.withColumns({"_lines": F.size(lines_of(F.col("_text"))).cast("long"), "_whole": whole})
    found = _texts(found, "_sha", lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest())
    return found.select(F.col("_id").alias(id_col), F.col("_lines").alias("n_lines"), F.coalesce("_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.coalesce("_whole", "_sha").alias("kept_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """The input with the remaining lines as its texts; texts that lose no line are unchanged."""
    found = _texts(_marked(docs, id_col, text_col, least_chars, least_docs, True), "_left", str)
    text = F.coalesce("_left", F.col(f"_row.`{text_col}`"))
    return found.select(*[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
