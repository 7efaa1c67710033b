"""Signatures of segments: zonal statistics, composition, information measures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiq.functions.numeric import div
from stratiq.sources.scratch import saved

from .relational import small, spread


def zonal(df: DataFrame, by: str, bands: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """band__mean, sd (population), min, max, cv and quantiles for each segment and band, one aggregation.

    All quantiles of a band come from one map of its values.
    """
    aggs: list[Column] = []
    shown: list[Column | str] = [by]
    for b in bands:
        aggs += [F.avg(b).alias(f"{b}__mean"), F.stddev_pop(b).alias(f"{b}__sd"), F.min(b).alias(f"{b}__min"), F.max(b).alias(f"{b}__max")]
        shown += [f"{b}__{k}" for k in ("mean", "sd", "min", "max")] + [div(f"{b}__sd", f"{b}__mean").alias(f"{b}__cv")]
        if quantiles:
            aggs.append(F.percentile(b, F.array(*[F.lit(float(q)) for q in quantiles])).alias(f"{b}__q"))
            shown += [F.col(f"{b}__q")[i].alias(f"{b}__q{round(100 * q):02d}") for i, q in enumerate(quantiles)]
    return df.groupBy(by).agg(*aggs).select(*shown)


def zonal_weighted(df: DataFrame, by: str, bands: Sequence[str], weight: str) -> DataFrame:
    """Weighted mean and weighted population sd: sums of w, w x, w x squared."""
    w = F.sum(weight)
    mean = lambda b: div(F.sum(F.col(weight) * F.col(b)), w)
    square = lambda b: div(F.sum(F.col(weight) * F.col(b) * F.col(b)), w)
    return df.groupBy(by).agg(*[x for b in bands for x in (mean(b).alias(f"{b}__mean"), F.sqrt(F.greatest(square(b) - mean(b) * mean(b), F.lit(0.0))).alias(f"{b}__sd"))])


def weighted_quantile(df: DataFrame, by: str, band: str, weight: str, q: float) -> DataFrame:
    """The smallest value whose cumulative weight reaches q of the segment's weight."""
    w = Window.partitionBy(by).orderBy(band).rangeBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_c", F.sum(weight).over(w)).withColumn("_t", F.sum(weight).over(Window.partitionBy(by)))
    return rows.filter(F.col("_c") >= q * F.col("_t")).groupBy(by).agg(F.min(band).alias(f"{band}__wq{round(100 * q):02d}"))


def composition(df: DataFrame, by: str, cls: str, weight: str) -> DataFrame:
    """by, cls, share: weights summed by class, over the segment's weight."""
    sums = df.groupBy(by, cls).agg(F.sum(weight).alias("_w"))
    return sums.withColumn("share", div("_w", F.sum("_w").over(Window.partitionBy(by)))).drop("_w")


def composition_wide(df: DataFrame, by: str, cls: str, weight: str, classes: Sequence[str]) -> DataFrame:
    """One share column per class, 0 where it is absent."""
    total = F.sum(weight)
    return df.groupBy(by).agg(*[div(F.sum(F.when(F.col(cls) == c, F.col(weight)).otherwise(0.0)), total).alias(f"frac_{c}") for c in classes])


def mode_share(df: DataFrame, by: str, cls: str, weight: str) -> DataFrame:
    """The class of the largest weight (the smallest of ties) and its share."""
    sums = df.groupBy(by, cls).agg(F.sum(weight).alias("_w"))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.col("_w").desc(), F.col(cls)))
    share = div("_w", F.sum("_w").over(Window.partitionBy(by)))
    return sums.withColumn("mode_share", share).withColumn("_r", best).filter("_r = 1").select(by, F.col(cls).alias("mode"), "mode_share")


def dominant_class(df: DataFrame, by: str, code: str, weight: str, mapping: Column) -> DataFrame:
    """Codes shared out, mapped to classes and collapsed: class, purity, n_classes.  Unmapped codes keep their share of the whole."""
    parts = composition(df, by, code, weight).withColumn("class", mapping).filter(F.col("class").isNotNull())
    sums = parts.groupBy(by, "class").agg(F.sum("share").alias("purity"))
    w = Window.partitionBy(by)
    ranked = sums.withColumn("n_classes", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.round("purity", 9).desc(), F.col("class"))))
    return ranked.filter("_r = 1").select(by, "class", "purity", "n_classes")


def entropy(df: DataFrame, by: str, cls: str, weight: str) -> DataFrame:
    """H (natural log), richness K and H_norm (null if K < 2)."""
    p = composition(df, by, cls, weight).filter("share > 0")
    out = p.groupBy(by).agg((-F.sum(F.col("share") * F.ln("share"))).alias("H"), F.count(F.lit(1)).alias("K"))
    return out.withColumn("H_norm", F.when(F.col("K") >= 2, F.col("H") / F.ln(F.col("K"))))


def adjacency(grid: DataFrame, row: str, col: str, keep: Sequence[str]) -> DataFrame:
    """Ordered pairs of each cell with its east and south neighbour: keep columns as a_..., b_...

    The neighbour is found by an equi-join on the shifted index, so that no row
    of cells has to fit one task.
    """
    a = grid.select(row, col, *[F.col(k).alias(f"a_{k}") for k in keep])
    right = grid.select(F.col(row), (F.col(col) - 1).alias(col), *[F.col(k).alias(f"b_{k}") for k in keep])
    below = grid.select((F.col(row) - 1).alias(row), F.col(col), *[F.col(k).alias(f"b_{k}") for k in keep])
    return a.join(right.union(below), [row, col]).drop(row, col)


def mutual_information(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """I = sum p ln(p / (p_a p_b)) over the pairs of each group."""
    counts = pairs.groupBy(*by, a, b).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*by))
    pa, pb = F.sum("_n").over(Window.partitionBy(*by, a)), F.sum("_n").over(Window.partitionBy(*by, b))
    p = counts.withColumn("_t", total).withColumn("_a", pa).withColumn("_b", pb)
    term = F.col("_n") / F.col("_t") * F.ln(F.col("_n") * F.col("_t") / (F.col("_a") * F.col("_b")))
    return p.groupBy(*by).agg(F.sum(term).alias("I"))


def relative_information(h: DataFrame, i: DataFrame, by: str) -> DataFrame:
    """U = I / H; 0 where H is 0, null where there are no pairs."""
    return h.join(i, by, "left").withColumn("U", F.when(F.col("I").isNull(), None).when(F.col("H") > 0, F.col("I") / F.col("H")).otherwise(F.lit(0.0)))


def cove(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """The probability of each unordered pair of neighbouring classes in a tile."""
    both = pairs.select(by, F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    n = both.groupBy(by, "low", "high").agg(F.count(F.lit(1)).alias("_n"))
    return n.withColumn("p", F.col("_n") / F.sum("_n").over(Window.partitionBy(by))).drop("_n")


def _distinct(codes: np.ndarray, p: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row its place among the distinct signatures; of these, sorted by class: class, place and p."""
    ends = np.cumsum(sizes)
    seen: dict = {}
    place, first = np.zeros(len(sizes), int), np.zeros(len(sizes), bool)
    for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
        known = len(seen)
        place[i] = seen.setdefault((codes[a:b].tobytes(), p[a:b].tobytes()), known)
        first[i] = place[i] == known
    kept = np.repeat(first, sizes)
    order = np.argsort(codes[kept], kind="stable")
    return place, codes[kept][order], np.repeat(place, sizes)[kept][order], p[kept][order]


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL's round does: by the shortest decimal of the number, half up."""
    scaled = np.abs(x) * 10.0**digits
    out = np.copysign(np.floor(scaled + 0.5) / 10.0**digits, x) + 0.0
    for i in np.argwhere(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[tuple(i)] = float(Decimal(repr(float(x[tuple(i)]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _divergences(asked: pa.StructArray, others: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of both sides' rows among their distinct signatures, and the divergences of these."""
    flat = [rows.field("_m").flatten() for rows in (asked, others)]
    codes = np.asarray(pa.concat_arrays([f.field("_k") for f in flat]).dictionary_encode().indices)
    codes = codes[: len(flat[0])], codes[len(flat[0]) :]
    (x, xc, xi, xp), (y, yc, yi, yp) = (_distinct(c, np.asarray(f.field("_p"), float), np.asarray(pc.list_value_length(rows.field("_m")))) for c, f, rows in zip(codes, flat, (asked, others), strict=True))
    js = np.full((x.max(initial=-1) + 1, y.max(initial=-1) + 1), 0.6931471805599453)
    for c in np.intersect1d(xc, yc):
        at, to = slice(*np.searchsorted(xc, [c, c + 1])), slice(*np.searchsorted(yc, [c, c + 1]))
        p, q = xp[at, None], yp[None, to]
        # p ln(p / (p + q)) + q ln(q / (p + q)), with one logarithm for a pair.
        both = p + q
        term = np.log(both)
        term *= both
        np.subtract(p * np.log(p) + q * np.log(q), term, out=term)
        term *= 0.5
        js[np.ix_(xi[at], yi[to])] += term
    return x, y, js


def jensen_shannon(queries: DataFrame, signatures: DataFrame, by: str, keys: Sequence[str], p: str, block: int = 512, digits: int | None = None) -> DataFrame:
    """a, b, js: the divergence (natural log) of every query from every other signature; ln 2 where they have no class in common.

    JS = ln 2 + 1/2 sum over common classes of (p ln(p / (p + q)) + q ln(q / (p + q))),
    the other classes' terms being 0.  The queries, a stated set, meet all
    signatures in blocks of about ``block`` rows, equal signatures in the same
    blocks, so that each pair of different ones is worked out once for two blocks;
    the pairs leave a task as they are made.  ``digits``: js is rounded to so many.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        classes = df.filter(F.col(by).isNotNull()).select(F.col(by).alias("_id"), F.struct(*keys).cast("string").alias("_k"), F.col(p).cast("double").alias("_p"))
        rows = saved(classes.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_k", "_p"))).alias("_m")), "signatures")
        rows = rows.withColumn("_block", F.pmod(F.xxhash64("_m"), F.lit(max(1, rows.count() // block))))
        full = saved(rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 2 * block), "full-blocks")
        rows = rows.join(small(full), "_block", "left").withColumn("_part", F.pmod(F.xxhash64("_id"), F.coalesce(F.ceil(F.col("_n") / block), F.lit(1))))
        return saved(rows.groupBy("_block", "_part").agg(F.collect_list(F.struct("_id", "_m")).alias(name)).select(name), "blocks")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, others in zip(batch.column("_q"), batch.column("_s"), strict=True):
                x, y, js = _divergences(asked.values, others.values)
                js = js if digits is None else _half_up(js, digits)
                a, b = asked.values.field("_id"), others.values.field("_id")
                own = {k: j for j, k in enumerate(b.to_pylist())}
                same = [(i, own[k]) for i, k in enumerate(a.to_pylist()) if k in own]
                step = max(1, 100_000 // len(b))
                for at in range(0, len(a), step):
                    n = min(step, len(a) - at)
                    kept = np.ones((n, len(b)), bool)
                    for i, j in same:
                        if at <= i < at + n:
                            kept[i - at, j] = False
                    i, j = np.nonzero(kept)
                    yield pa.record_batch([a.take(pa.array(at + i)), b.take(pa.array(j)), pa.array(js[x[at + i], y[j]])], ["a", "b", "js"])

    asked, others = blocks(queries, "_q"), blocks(signatures, "_s")
    kind = dict(queries.dtypes)[by]
    return spread(others, 1).crossJoin(small(asked, 1_000)).mapInArrow(met, f"a {kind}, b {kind}, js double")
