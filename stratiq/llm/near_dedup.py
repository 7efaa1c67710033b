"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A text's shingles are hashed onto a circle of ``CIRCLE`` places by one
permutation; coordinate k of the signature is the smallest value that a second
permutation, shifted by k places, gives to them.  Shifting makes the k-th
coordinates of one shingle a run of neighbouring values, so that a signature is
the minimum over runs.  Coordinates are banded; documents that share a band are
candidates, and a candidate pair is linked only if the full sets of shingles
reach the threshold.  Groups are the connected components of links.

Texts with equal sets are one class from the start.  Within a bucket nothing is
paired with everything.  Each class is compared with the bucket's smallest id,
its hub h, and keeps what differs from it, D(x) = x xor h.  Two classes that are
linked to h are in one component.  For the others, with m = |h - x| and
n = |x - h|, the overlap of two classes is |h| - m(x) - m(y) + |D(x) and D(y)|,
so a link between x and y is a wanted overlap of their differences, t(x, y).
Such overlaps are found by prefix filtering: of differences in a common order,
rarest first, two that overlap in t places agree within their first |D| - t + 1.
Classes that merely resemble the same hub have few differences in common, hence
no pair, and classes that the hubs' links have joined already need none; pairs
come from joins on (hub, difference), which Spark splits where one is hot.  No
link between classes that share a band is lost.

Hot keys: a hub's pairs meet its text in parts of ``PAIRS``; hubs, bands, sets
and labels that very many rows share are looked up by broadcast (``looked_up``).

Sets are compared as 64-bit hashes of shingles.

With 40 bands of 6 a pair at similarity 0.8 shares no band with probability
5e-6, and less above.

Defined results
---------------
* Words are split at ASCII white space, A-Z lower-cased.  With fewer words than
  a shingle has, the whole sequence is the one shingle.
* Null text and text without words: n_shingles 0, linked with nothing.
* Ids are integers, or text that Spark casts to one.
* Rows of one id are one document: they share its component.
* Null id: the row joins the component of its links, and component_id is null
  where nothing else is reachable; such a row is kept.
* Ties and repeated rows follow from the above; an empty table gives an empty
  result.  Further columns are ignored by ``components`` and kept by
  ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FEW_ROWS, looked_up, removed, saved

BANDS, ROWS = 40, 6
CIRCLE = 1 << 20
#: Ids without a document id lie above all others.
NAMELESS = 1 << 62
#: Pairs of one hub that meet its text in one task.
PAIRS = 256


class _Hashes(dict):
    """64-bit hashes of words, for at most a million of them at a time."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1_000_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def hashed(words: list[bytes], table: dict, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - span + 1, span if span < width else 0, np.uint64)
        for i in range(span):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(words) - span + 1 + i]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


class Circulant:
    """Signatures of ``length`` coordinates from two seeded permutations of the circle."""

    def __init__(self, length: int, seed: int):
        draw = np.random.default_rng(seed)
        self.sigma = draw.permutation(CIRCLE).astype(np.int64)
        pi = draw.permutation(CIRCLE).astype(np.uint32)
        round_ = np.concatenate([pi, pi[:length]])
        # Row i: the values that the shifted permutations give to place i, one for each coordinate.
        self.runs = np.lib.stride_tricks.sliding_window_view(round_, length)
        self.length = length

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        places = np.unique(self.sigma[(hashes >> np.uint64(44)).astype(np.int64)])
        low = np.full(self.length, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(places), 2048):
            np.minimum(low, self.runs[places[i : i + 2048]].min(axis=0), out=low)
        return low


def _signatures(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """_id, _key, _n, _set (digest of the set), _bands (hashes that contain the band's number).  ``docs``: _id, _text, _key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        circle, table = Circulant(bands * rows, seed), _Hashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                counts, digests, keys = [], [], []
                for text in batch.column(1):
                    found = hashed((text.as_py() or "").encode("utf-8", "surrogatepass").lower().split(), table, width)
                    counts.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    if len(found):
                        sign = circle.signature(found).tobytes()
                        step = 4 * rows
                        keys.append([xxhash.xxh3_64_intdigest(sign[b * step : (b + 1) * step], seed=b) - (1 << 63) for b in range(bands)])
                    else:
                        keys.append([])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_key", "_n", "_set", "_bands"]
                )

    return docs.mapInArrow(run, "_id long, _key long, _n long, _set binary, _bands array<long>")


def _compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int, scratch: list[str]) -> DataFrame:
    """Pairs (_a, _b): sizes _na, _nb of their sets, _m missing from b, _n new in b, the differences _d, and _linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Hashes()
        of = lambda text: hashed((text.as_py() or "").encode("utf-8", "surrogatepass").lower().split(), table, width)
        last: tuple[int | None, np.ndarray] = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for a, x, y in zip(*(batch.column(i) for i in (0, 2, 3)), strict=True):
                if last[0] != a.as_py():
                    last = a.as_py(), of(x)
                h, z = last[1], of(y)
                both = len(np.intersect1d(h, z, assume_unique=True))
                row = len(h), len(z), len(h) - both, len(z) - both, np.setxor1d(h, z, assume_unique=True).view(np.int64), 100 * both >= percent * (len(h) + len(z) - both)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=["_a", "_b", "_na", "_nb", "_m", "_n", "_d", "_linked"])

    one = texts.select(F.col("_id").alias("_a"), F.col("_text").alias("_x"))
    two = texts.select(F.col("_id").alias("_b"), F.col("_text").alias("_y"))
    # A hub's pairs are dealt to parts of PAIRS, each of which gets the hub's text.
    sizes = saved(pairs.groupBy("_a").agg(F.count(F.lit(1)).alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / PAIRS).cast("int")), "near-sizes", scratch)
    dealt = looked_up(pairs, "_a", sizes, "_parts", sizes, scratch).withColumn("_part", F.pmod(F.xxhash64("_b"), F.col("_parts")).cast("int")).drop("_parts")
    one = one.join(sizes, "_a").select("_a", "_x", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    full = dealt.join(two, "_b").join(one, ["_a", "_part"]).select("_a", "_b", "_x", "_y")
    return full.mapInArrow(run, "_a long, _b long, _na long, _nb long, _m long, _n long, _d array<long>, _linked boolean")


def _beside_hubs(star: DataFrame, labels: DataFrame, percent: int, scratch: list[str]) -> DataFrame:
    """Links (_a, _b) between two classes of one hub of which one, at least, is not linked to it, across the components so far."""
    r = percent / (100 + percent)
    lone = saved(star.filter(~F.col("_linked")).select("_a", F.lit(True).alias("_lone")).distinct(), "near-lone", scratch)
    # e(x) + e(y) is the wanted overlap t; e <= c for those linked to the hub, e >= -c for all.
    c = (0.5 - r) * F.col("_na")
    members = saved(looked_up(star, "_a", lone, "_lone", None, scratch).drop("_lone").withColumn("_c", c).withColumn("_e", (1 - r) * F.col("_m") + r * F.col("_n") - F.col("_c")).withColumn("_size", F.size("_d")), "near-members", scratch)
    named = members.join(labels.withColumnRenamed("_id", "_b"), "_b", "left").withColumn("_label", F.coalesce("_label", "_b"))
    each = members.select("_a", "_b", F.explode("_d").alias("_x"))
    times = each.groupBy("_a", "_x").agg(F.count(F.lit(1)).alias("_times"))
    order = each.join(times, ["_a", "_x"]).groupBy("_a", "_b").agg(F.sort_array(F.collect_list(F.struct("_times", "_x"))).alias("_order"))
    ranked = saved(named.select("_a", "_b", "_e", "_c", "_size", "_linked", "_label").join(order, ["_a", "_b"]), "near-order", scratch)
    far = (F.col("_e") - F.col("_c")) / (1 - r)  # no feasible partner wants less of x
    near = F.greatest(far, F.col("_e") + F.col("_c"))  # nor of y, given that x is not linked to the hub

    def prefix(rows: DataFrame, least, name: str) -> DataFrame:
        length = F.greatest(F.lit(0), F.col("_size") - F.greatest(F.lit(1), F.ceil(least - 1e-9)) + 1).cast("int")
        rows = rows.filter(F.col("_size") > 0).select("_a", "_b", "_e", "_size", "_linked", "_label", F.posexplode(F.slice("_order", F.lit(1), length)).alias("_at", "_p"))
        rows = rows.filter("_p._times > 1").withColumn("_rest", F.col("_size") - F.col("_at"))
        return rows.select("_a", F.col("_p._x").alias("_x"), *[F.col(f"_{k}").alias(f"{name}_{k}") for k in ("b", "e", "rest", "linked", "label")])

    x, y = prefix(ranked.filter(~F.col("_linked")), far, "x"), prefix(ranked, near, "y")
    other = F.col("y_linked") | (F.col("x_b") < F.col("y_b"))
    # At the first place in which two agree, both have the wanted overlap still ahead.
    ahead = F.least("x_rest", "y_rest") >= F.col("x_e") + F.col("y_e") - 1e-9
    found = x.join(y, ["_a", "_x"]).filter((F.col("x_label") != F.col("y_label")) & other & ahead).select("_a", "x_b", "y_b").distinct()
    side = lambda name: members.select("_a", F.col("_b").alias(f"{name}_b"), F.col("_d").alias(f"{name}_d"), F.col("_m").alias(f"{name}_m"), F.col("_nb").alias(f"{name}_n"), *(["_na"] if name == "x" else []))
    full = found.join(side("x"), ["_a", "x_b"]).join(side("y"), ["_a", "y_b"])
    both = F.col("_na") - F.col("x_m") - F.col("y_m") + F.size(F.array_intersect("x_d", "y_d"))
    return full.filter(100 * both >= percent * (F.col("x_n") + F.col("y_n") - both)).select(F.least("x_b", "y_b").alias("_a"), F.greatest("x_b", "y_b").alias("_b")).distinct()


def connected(links: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """_id, _label (the component's smallest id) for every id on a link (_a, _b), _a < _b.

    An id keeps the link to its smallest neighbour; its other links are replaced
    by links of that neighbour.  Ids that are nobody's smaller end then hang on
    one link each and wait for its label, and the rounds run over the few others.
    Ids with very many links, and labels of very large components, meet the others
    by broadcast (``looked_up``).
    """
    parents = saved(links.groupBy("_b").agg(F.min("_a").alias("_p")), "near-parents", scratch)
    hubs = saved(links.select(F.col("_a").alias("_b")).distinct(), "near-hubs", scratch)
    across = links.join(parents, "_b").filter("_a <> _p").select(F.least("_a", "_p").alias("_u"), F.greatest("_a", "_p").alias("_v"))
    above = parents.join(hubs, "_b", "left_semi").select(F.col("_p").alias("_u"), F.col("_b").alias("_v"))
    edges = across.union(above).distinct()
    both = saved(edges.union(edges.select("_v", "_u")).union(hubs.select("_b", "_b")), "near-edges", scratch)
    degrees = saved(both.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")), "near-degrees", scratch)
    labels = saved(both.groupBy("_u").agg(F.min("_v").alias("_label")).select(F.col("_u").alias("_id"), "_label"), "near-labels", scratch)
    while True:
        heard = looked_up(both, "_v", labels.withColumnRenamed("_id", "_v"), "_label", degrees, scratch).groupBy("_u").agg(F.min("_label").alias("_heard"))
        near = saved(labels.join(heard.withColumnRenamed("_u", "_id"), "_id").select("_id", F.col("_label").alias("_old"), F.least("_label", "_heard").alias("_near")), "near-heard", scratch)
        # A label is an id of the same component: its own label is as good or better.
        jump = labels.select(F.col("_id").alias("_near"), F.col("_label").alias("_far"))
        after = saved(looked_up(near, "_near", jump, "_far", None, scratch).select("_id", "_old", F.least("_near", "_far").alias("_label")), "near-labels", scratch)
        labels = after.select("_id", "_label")
        if after.filter("_old <> _label").isEmpty():
            break
    rest = looked_up(parents.join(hubs, "_b", "left_anti"), "_p", labels.withColumnRenamed("_id", "_p"), "_label", None, scratch).select(F.col("_b").alias("_id"), "_label")
    return saved(labels.union(rest), "near-labels", scratch)


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int, seed: int) -> DataFrame:
    """_id, _key (hash of the text where the id is null), _n, _label (smallest id of the component; null without words) for every row."""
    scratch: list[str] = []
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text")).withColumn("_key", F.when(F.col("_id").isNull(), F.xxhash64("_text")))
    signs = saved(_signatures(plain, width, bands, rows, seed), "near-signs")
    full = F.col("_n") > 0
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64("_set"), F.lit(1 << 61))
    reps = signs.filter(full).groupBy("_set").agg(F.min("_id").alias("_rep"), F.first("_bands").alias("_bands"), F.count(F.lit(1)).alias("_rows"))
    reps = saved(reps.withColumn("_rep", F.coalesce("_rep", nameless)), "near-reps", scratch)
    members = reps.select("_rep", F.explode("_bands").alias("_key"))
    shared = members.groupBy("_key").agg(F.min("_rep").alias("_hub"), F.max("_rep").alias("_far"), F.count(F.lit(1)).alias("_n")).filter("_hub < _far")
    shared = saved(shared.drop("_far"), "near-shared", scratch)
    pairs = looked_up(members, "_key", shared, "_hub", shared, scratch).filter("_rep <> _hub").select(F.col("_hub").alias("_a"), F.col("_rep").alias("_b")).distinct()
    pairs = saved(pairs, "near-pairs", scratch)

    wanted = saved(pairs.select(F.col("_a").alias("_id")).union(pairs.select("_b")).distinct(), "near-wanted", scratch)
    wanted = F.broadcast(wanted) if wanted.count() <= FEW_ROWS else wanted
    texts = saved(plain.filter("_id is not null").join(wanted, "_id").select("_id", "_text"), "near-texts", scratch)
    if reps.filter(F.col("_rep") >= NAMELESS).limit(1).count():
        # Texts without id are named by their set; few, if any.
        by_text = signs.filter("_id is null").select("_key", nameless.alias("_id")).distinct()
        texts = texts.unionByName(plain.filter("_id is null").select("_key", "_text").dropDuplicates(["_key"]).join(by_text, "_key").select("_id", "_text"))
    star = saved(_compared(pairs, texts, width, percent, scratch), "near-star", scratch)
    links = star.filter("_linked").select("_a", "_b")
    labels = connected(links, scratch)
    if not star.filter(~F.col("_linked")).isEmpty():
        more = saved(_beside_hubs(star, labels, percent, scratch), "near-links", scratch)
        labels = labels if more.isEmpty() else connected(links.union(more), scratch)
    groups = reps.join(labels.withColumnRenamed("_id", "_rep"), "_rep", "left").select("_set", F.coalesce("_label", "_rep").alias("_label"), F.col("_rows").alias("_n"))
    groups = saved(groups, "near-groups")
    named = looked_up(signs.filter(full).select("_id", "_key", F.col("_n").alias("_size"), "_set"), "_set", groups, "_label", groups)
    removed(docs.sparkSession, scratch)
    return named.select("_id", "_key", F.col("_size").alias("_n"), "_label").unionByName(signs.filter(~full).select("_id", "_key", "_n", F.lit(None).cast("long").alias("_label")))


def _kept(found: DataFrame) -> DataFrame:
    """The classes with _component and _kept."""
    label = F.when(F.col("_label") < NAMELESS, F.col("_label"))
    named = found.withColumn("_component", F.when(F.col("_n") > 0, label).otherwise(F.col("_id")))
    return named.withColumn("_kept", F.coalesce(F.col("_id") == F.col("_component"), F.col("_component").isNull()))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = 11) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    found = _kept(_classes(docs, id_col, text_col, width, percent, bands, rows, seed))
    return found.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_kept").alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    gone = saved(_kept(_classes(docs, id_col, text_col, width, percent, BANDS, ROWS, 11)).filter("not _kept").select(F.col("_id").alias("_gone"), F.col("_key").alias("_gone_key")).distinct(), "near-gone")
    named = gone.filter("_gone is not null").select("_gone")
    named = F.broadcast(named) if named.limit(FEW_ROWS + 1).count() <= FEW_ROWS else named
    out = docs.join(named, F.col(f"`{id_col}`").cast("long") == F.col("_gone"), "left_anti")
    if (nameless := gone.filter("_gone is null")).isEmpty():
        return out
    return out.join(nameless, F.col(f"`{id_col}`").isNull() & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("_gone_key")), "left_anti")
