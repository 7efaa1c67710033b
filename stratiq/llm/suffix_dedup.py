"""Removal of repeated passages by threshold-bounded interval expansion.

Every byte that lies in a ``window``-byte string which also starts earlier in
the corpus (smaller id, or same text and earlier start) is removed.

1. A window names an anchor by its bytes alone (see ``anchors``); the windows of
   one anchor in a text form a segment of under two windows' length.  Equal
   windows have equal anchors, so only segments with one anchor need comparing.
2. Segments are dealt by anchor, as hashes, and sorted by Spark.  Of equal
   segments all but the earliest are removed at once (first within each task,
   before the shuffle); an anchor with one segment needs no more; the rest are
   fetched as bytes.  The sorted rows are read as a stream: a task holds one
   Arrow batch and one row.
3. Buckets of such segments, about ``BUCKET`` bytes with whole anchors, get a
   suffix array and its Burrows-Wheeler transform.  From the intervals of the
   strings that the array's sort has ranked first (``RANKED`` bytes), breadth
   first, each level puts a character in front of the strings of the level
   below: the LF mapping carries an interval of a string to the intervals of all
   its extensions, so that a boundary between neighbours gets its common prefix
   length at the level at which it first shows.  Lengths
   appear in increasing order and the expansion stops at ``window``; neighbours
   without a boundary by then share a whole window.  Of each such interval all
   starts but the earliest are removed.
4. Removed ranges meet their text again and are merged.

An anchor with very many different segments (a common line in ever new
surroundings) would make one large group.  A first pass finds such anchors: of
each anchor the different segments in a sixteenth of all (chosen by the hash of
the segment, so alike in every task) are counted without loss; an anchor with
over ``HOT`` segments is expected to have ``HOT`` / 16 there.  Missing one
would cost a larger bucket and no result.  Windows of hot anchors are dealt one
by one, by a hash of the whole window, and equal ones are settled in step 2.  At
most ``MOST_HOT`` anchors are hot, 8 bytes each in the broadcast: the commonest.

Segments are compared by 120 bits of hash in step 2 and byte by byte in step 3.

Defined results
---------------
* Null and empty texts: no bytes.  Texts of under ``window`` bytes lose nothing.
* Rows with equal id and equal text are one text: both lose the same ranges, and
  neither counts as an earlier copy of the other.  Of rows with equal id and
  different texts one counts as earlier, by a hash of the text.  Null id: last.
* An empty table gives an empty result.  Further columns are ignored by
  ``ranges`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors
from .common import saved, shuffle_parts

GRAM = 32
BUCKET = 1 << 18
#: Different segments from which an anchor is hot, and the number of such anchors at most.
HOT, MOST_HOT = 1024, 4_000_000
#: Of so many segments one is counted to find them.
SAMPLED = 16
#: Bytes of the strings from which the expansion starts.
RANKED = 7
#: Segments that a task combines at a time.
HELD = 2_000_000
LAST = (1 << 63) - 1
MARKS = "_kind int, _doc long, _text_key long, _start int, _end int, _anchor long"


def _order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _changes(*keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _merged(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of each text, joined where they touch."""
    at = _order(doc, key, start)
    doc, key, start, end = doc[at], key[at], start[at], end[at]
    new = _changes(doc, key)
    group = np.cumsum(new)
    # Furthest end so far within the text: ends are below 2**31.
    reach = np.maximum.accumulate((group << 32) + end) & ((1 << 32) - 1) if len(end) else end
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], key[first], start[first], np.maximum.reduceat(end, first) if len(first) else end


def _runs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A column of strings without nulls as bytes laid end to end, in parts of about ``anchors.PIECE``: bytes, their row, and each row's start and place in its text."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + anchors.PIECE, "right")) - 1)
        rows = np.arange(row, stop)
        yield raw[offsets[row] : offsets[stop]], np.repeat(rows, np.diff(offsets[row : stop + 1])), offsets[row:stop] - offsets[row], rows
        row = stop


def _segments(batch: pa.RecordBatch, window: int, hot: np.ndarray | None) -> list[np.ndarray]:
    """Columns anchor, context (hash and length), doc, text key, start of the batch's segments."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
    docs, keys = (batch.column(i).to_numpy() for i in (0, 1))
    for raw, owner, begins, rows in _runs(batch.column(2)):
        for low, high in anchors.pieces(len(raw), window):
            first, last, anchor, sums = anchors.segments(raw[low:high], owner[low:high], window, GRAM)
            end = last + window
            context = sums.of(first, end)
            if hot is not None and len(hot) and (on := np.isin(anchor, hot)).any():
                lengths = last[on] - first[on] + 1
                lone = np.repeat(first[on] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                whole = sums.of(lone, lone + window)
                edges = sums.of(lone, lone + GRAM) * np.uint64(3) + sums.of(lone + window - GRAM, lone + window)
                first, end = np.concatenate([first[~on], lone]), np.concatenate([end[~on], lone + window])
                anchor, context = np.concatenate([anchor[~on], whole]), np.concatenate([context[~on], anchors.mixed(edges)])
            context = (context & ~np.uint64(0xFF)) | (end - first).astype(np.uint64)
            at = owner[first + low]
            for part, values in zip(parts, (anchor.view(np.int64), context.view(np.int64), docs[at], keys[at], first + low - begins[at - rows[0]]), strict=True):
                part.append(values)
    return [np.concatenate(p) for p in parts]


def _marks(kind: np.ndarray | int, doc, key, start, end, anchor) -> pa.RecordBatch:
    kinds = np.full(len(doc), kind, np.int32) if isinstance(kind, int) else kind
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds), pa.array(doc), pa.array(key), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(anchor)],
        names=["_kind", "_doc", "_text_key", "_start", "_end", "_anchor"],
    )


def _together(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    """An order that puts rows of equal anchor and context together: by one hash of both."""
    return np.argsort(anchors.mixed(anchor.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + context.view(np.uint64)))


def _earliest(anchor, context, doc, key, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by anchor and context, and then by place; in it, the first row of each context, and later rows at another place."""
    at = _together(anchor, context)
    first = _changes(anchor[at], context[at])
    several = ~first
    several[:-1] |= ~first[1:]
    rows = np.flatnonzero(several)
    inner = at[rows]
    at[rows] = inner[_order(np.cumsum(first)[rows], doc[inner], key[inner], start[inner])]
    later = ~first & _changes(doc[at], key[at], start[at])
    return at, first, later


def _hot_anchors(texts: DataFrame, window: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                anchor, context = _segments(batch.slice(start, 512), window, None)[:2]
                chosen = anchors.mixed(context.view(np.uint64)) % np.uint64(SAMPLED) == 0
                anchor, context = anchor[chosen], context[chosen]
                at = _together(anchor, context)
                at = at[_changes(anchor[at], context[at])]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array(context[at])], names=["_anchor", "_context"])

    seen = texts.mapInArrow(run, "_anchor long, _context long").distinct()
    counts = saved(seen.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(1, HOT // SAMPLED)), "suffix-hot")
    found = counts.count()
    if found > MOST_HOT:
        counts = counts.filter(F.col("_n") > counts.agg(F.percentile_approx("_n", 1 - MOST_HOT / found, 100_000)).first()[0])
    return np.sort(counts.select("_anchor").toArrow()["_anchor"].to_numpy()).view(np.uint64)  # at most MOST_HOT numbers


def _dealt(texts: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    """Step 2: marks of kind 1, ranges to remove, and of kind 2, segments to compare byte by byte."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def settled() -> Iterator[pa.RecordBatch]:
            anchor, context, doc, key, start = (np.concatenate(x) for x in zip(*held, strict=True))
            at, first, later = _earliest(anchor, context, doc, key, start)
            a = at[first]
            yield pa.RecordBatch.from_arrays([pa.array(x[a]) for x in (anchor, context, doc, key)] + [pa.array(start[a].astype(np.int32)), pa.array(np.full(len(a), -1, np.int32))], names=["_anchor", "_context", "_doc", "_text_key", "_start", "_end"])
            b = at[later]
            gone = _merged(doc[b], key[b], start[b], start[b] + (context[b] & 0xFF))
            spread = anchors.mixed(gone[0].astype(np.uint64) + gone[2].astype(np.uint64)).view(np.int64)  # any place will do
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (spread, np.zeros(len(spread), np.int64), *gone[:2])] + [pa.array(x.astype(np.int32)) for x in gone[2:]], names=["_anchor", "_context", "_doc", "_text_key", "_start", "_end"])

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                held.append(_segments(batch.slice(start, 512), window, shared.value))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from settled()
                    held = []
        if held:
            yield from settled()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows, whose last one is kept from batch to batch, and the first segment of the last anchor while it has no other."""
        before = pending = [np.zeros(0, np.int64)] * 5
        several: np.ndarray = np.zeros(0, np.int64)  # the last anchor, if it has several segments
        for batch in batches:
            *row, end = (batch.column(i).to_numpy().astype(np.int64) for i in range(6))
            ready = end >= 0
            yield _marks(1, row[2][ready], row[3][ready], row[4][ready], end[ready], np.zeros(ready.sum(), np.int64))
            row = [x[~ready] for x in row]
            if not len(row[0]):
                continue
            have = len(before[0])
            first, place = (_changes(*[np.concatenate([before[k], row[k]]) for k in keys])[have:] for keys in ((0, 1), (2, 3, 4)))
            before = [x[-1:] for x in row]
            _, context, doc, key, start = (x[~first & place] for x in row)
            gone = _merged(doc, key, start, start + (context & 0xFF))
            yield _marks(1, *gone, np.zeros(len(gone[0]), np.int64))
            anchor, context, doc, key, start = new = [np.concatenate([p, x[first]]) for p, x in zip(pending, row, strict=True)]
            if not len(anchor):
                continue
            group = np.cumsum(_changes(anchor)) - 1
            size = np.bincount(group)
            wanted = (size[group] > 1) | np.isin(anchor, several)
            yield _marks(2, doc[wanted], key[wanted], start[wanted], start[wanted] + (context[wanted] & 0xFF), anchor[wanted])
            several = anchor[-1:] if wanted[-1] else anchor[:0]
            pending = [x[:0] if wanted[-1] else x[-1:] for x in new]

    rows = texts.mapInArrow(combine, "_anchor long, _context long, _doc long, _text_key long, _start int, _end int")
    dealt = rows.repartition(shuffle_parts(texts.sparkSession), "_anchor")
    return dealt.sortWithinPartitions("_anchor", "_context", "_doc", "_text_key", "_start").mapInArrow(compare, MARKS)


def suffix_array(text: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes, ordered by their first ``depth`` bytes; ``left`` is what each has left in its segment.

    Also their ranks by the first ``RANKED`` bytes alone.
    """
    n = len(text)
    size, key, known = RANKED, np.zeros(n, np.int64), None
    for i in range(size):
        key <<= 9
        key[: n - i] |= np.where(left[: n - i] > i, text[i:].astype(np.int64) + 1, 0)
    bits = np.uint64(n + 1).item().bit_length()
    while True:
        order = np.argsort(key)
        if size >= depth:
            return order, known
        ranks = np.empty(n, np.int64)
        ranks[order] = np.cumsum(_changes(key[order]))
        known = ranks if known is None else known
        key = ranks.copy()
        times = 63 // bits  # ranks that fit one key
        for i in range(1, times):
            key <<= bits
            if (shift := i * size) < n:
                key[: n - shift] |= np.where(left[: n - shift] > shift, ranks[shift:], 0)
        size *= times


def repeated(text: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in suffix order that share ``window`` bytes with the start before or behind them, and their interval's number."""
    sa, ranks = suffix_array(text, left, window + 1)
    n = len(sa)
    place = np.empty(n, np.int32)
    place[sa] = np.arange(n, dtype=np.int32)
    # The BWT's byte at x stands in front of suffix sa[x]; LF sends x to the suffix that begins with it.
    inside = np.zeros(n, bool)
    inside[1:] = left[:-1] > 1
    x = np.flatnonzero(inside[sa])
    lf = place[sa[x] - 1]
    back = np.full(n, -1, np.int32)
    back[lf] = x
    # The intervals of strings of RANKED bytes begin the expansion.
    rest, head = left[sa], ranks[sa]
    same = np.zeros(n, bool)  # y and y - 1 share a prefix of the level's length
    same[1:] = (head[1:] == head[:-1]) & (np.minimum(rest[1:], rest[:-1]) >= RANKED)
    y = np.flatnonzero(same)
    # For each neighbouring pair that still agrees: where it comes from, and the levels that both can reach.
    one, two, reach = back[y], back[y - 1], np.minimum(rest[y], rest[y - 1])
    interval = np.cumsum(~same, dtype=np.int32)
    for level in range(RANKED, window):
        agree = (interval[one] == interval[two]) & (reach > level)
        if not agree.all():
            same[y[~agree]] = False
            y, one, two, reach = y[agree], one[agree], two[agree], reach[agree]
            if not len(y):
                break
            interval = np.cumsum(~same, dtype=np.int32)
    member = same.copy()
    member[:-1] |= same[1:]
    at = np.flatnonzero(member)
    return sa[at], interval[at] if len(y) else at


def _bucket(doc: np.ndarray, key: np.ndarray, start: np.ndarray, text: np.ndarray, lengths: np.ndarray, window: int) -> pa.RecordBatch:
    """Ranges to remove from a bucket's segments: all starts of an interval but the earliest."""
    ends = np.cumsum(lengths)
    segment = np.repeat(np.arange(len(lengths)), lengths)
    left = ends[segment] - np.arange(len(text))
    found, interval = repeated(text, left, window)
    rank = np.empty(len(doc), np.int64)
    at = _order(doc, key)
    rank[at] = np.cumsum(_changes(doc[at], key[at]))
    s = segment[found]
    where = start[s] + found - (ends - lengths)[s]
    place = (rank[s] << 32) | where
    first = np.flatnonzero(_changes(interval))
    least = np.minimum.reduceat(place, first) if len(first) else place
    later = place > np.repeat(least, np.diff(np.append(first, len(place))))
    s, where = s[later], where[later]
    gone = _merged(doc[s], key[s], where, where + window)
    return _marks(1, *gone, np.zeros(len(gone[0]), np.int64))


def _compared(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Step 3: ranges to remove among the wanted segments."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text, spans in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                start, end, anchor = (x.to_numpy(zero_copy_only=False) for x in spans.values.flatten())
                n = len(start)
                pieces = pa.array([raw[a:b] for a, b in zip(start, end, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.full(n, doc.as_py())), pa.array(np.full(n, key.as_py())), pa.array(start), pieces], names=["_anchor", "_doc", "_text_key", "_start", "_bytes"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            data = batch.column(4)
            width = np.int64 if pa.types.is_large_binary(data.type) else np.int32
            offsets = np.frombuffer(data.buffers()[1], width)[data.offset : data.offset + len(data) + 1].astype(np.int64)
            raw = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            return (*(batch.column(i).to_numpy() for i in range(4)), np.diff(offsets), raw)

        def joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

        def buckets(final: bool) -> Iterator[pa.RecordBatch]:
            """Full buckets; what is left, the last anchor's rows at least, is held on unless final."""
            nonlocal held
            anchor, doc, key, start, lengths, raw = joined(held)
            ends = np.cumsum(lengths)
            new = np.append(np.flatnonzero(_changes(anchor)), len(anchor))
            begin = 0
            while begin < len(anchor):
                base = ends[begin - 1] if begin else 0
                fits = np.searchsorted(ends, base + BUCKET, "right")  # rows that fit
                i = np.searchsorted(new, max(fits, begin), "right") - 1
                stop = new[i] if new[i] > begin else new[i + 1]
                if stop == len(anchor) and not final:
                    break
                yield _bucket(doc[begin:stop], key[begin:stop], start[begin:stop].astype(np.int64), raw[base : ends[stop - 1]], lengths[begin:stop], window)
                begin = stop
            base = ends[begin - 1] if begin else 0
            held = [(anchor[begin:], doc[begin:], key[begin:], start[begin:], lengths[begin:], raw[base:])] if begin < len(anchor) else []

        for batch in batches:
            if batch.num_rows:
                held.append(flat(batch))
            if sum(len(x[5]) for x in held) > 4 * BUCKET:
                yield from buckets(False)
        if held:
            yield from buckets(True)

    lists = wanted.groupBy("_doc", "_text_key").agg(F.collect_list(F.struct("_start", "_end", "_anchor")).alias("_spans"))
    pieces = texts.join(lists, ["_doc", "_text_key"]).select("_doc", "_text_key", "_text", "_spans").mapInArrow(cut, "_anchor long, _doc long, _text_key long, _start int, _bytes binary")
    parts = shuffle_parts(texts.sparkSession)
    return pieces.repartition(parts, "_anchor").sortWithinPartitions("_anchor").mapInArrow(expand, MARKS)


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("_doc"), F.xxhash64(text).alias("_text_key"), text.alias("_text"), *more)


def ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100) -> DataFrame:
    """_doc, _text_key, _spans (start, end of bytes to remove; they may overlap) for the texts that lose something."""
    if not 2 * GRAM <= window <= (255 + GRAM) // 2:
        raise ValueError(f"window must be from {2 * GRAM} to {(255 + GRAM) // 2} bytes")
    texts = _keyed(docs, id_col, text_col)
    marks = saved(_dealt(texts, window, _hot_anchors(texts, window)), "suffix-marks")
    compared = saved(_compared(texts, marks.filter("_kind = 2"), window), "suffix-compared")
    gone = marks.filter("_kind = 1").union(compared)
    return gone.groupBy("_doc", "_text_key").agg(F.collect_list(F.struct("_start", "_end")).alias("_spans"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, digest: bool = False) -> DataFrame:
    """One row per input row: _row (the input), n_bytes, n_removed, n_spans, and kept_bytes or, with ``digest``, kept_sha256."""
    found = ranges(docs, id_col, text_col, window)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if not (digest and c == text_col)]).alias("_row")
    rows = _keyed(docs, id_col, text_col, row).join(found, ["_doc", "_text_key"], "left").select("_row", "_text", "_spans")
    kept = ("kept_sha256", pa.string(), T.StringType()) if digest else ("kept_bytes", pa.binary(), T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                parts, done, gone, n = [], 0, 0, 0
                if spans.is_valid:
                    start, end = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans.values.flatten())
                    zero = np.zeros(len(start), np.int64)
                    _, _, start, end = _merged(zero, zero, start, end)
                    n = len(start)
                    for a, b in zip(start.tolist(), end.tolist(), strict=True):
                        parts.append(raw[done:a])
                        gone, done = gone + b - a, b
                body = b"".join([*parts, raw[done:]])
                for column, value in zip(out, (len(raw), gone, n, hashlib.sha256(body).hexdigest() if digest else body), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], kept[1])], names=["_row", "n_bytes", "n_removed", "n_spans", kept[0]])

    added = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    return rows.mapInArrow(run, T.StructType([rows.schema["_row"], *added, T.StructField(kept[0], kept[2])]))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return clean(docs.select("doc_id", "text"), digest=True).select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
