"""Partitioning around medoids, and numbers of clusters suggested by several methods."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiq.sources.scratch import dropped, saved

from .models import _below, _numbers, _ward, best_k, evaluation_sample, k_report, kmeans
from .stats import silhouette, vote

#: Rows whose distances to all candidates are held at once.
ROWS_AT_ONCE = 1000


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - y[None]) ** 2).sum(axis=2))


def _summed(rows: DataFrame, features: Sequence[str], part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of ``part`` of blocks of them: each task sends one array of that shape, which also comes to the driver."""
    features, size = list(features), int(np.prod(shape))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            x = _numbers(batch, features)
            for i in range(0, len(x), ROWS_AT_ONCE):
                total += part(x[i : i + ROWS_AT_ONCE])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total.ravel())], names=["cell", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(sums, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # a row for each number of the array
        out[r["cell"]] = r["v"]
    return out.reshape(shape)


def _least(cost: np.ndarray, scale: float) -> int:
    """The first of the least values, those within rounding of each other being equal: sums come in any order."""
    return int(np.flatnonzero(cost.ravel() <= cost.min() + 1e-9 * scale)[0])


def medoids(df: DataFrame, key: str, features: Sequence[str], k: int, candidates: int = 1000, out: str = "cluster") -> tuple[DataFrame, list, float]:
    """``df``'s complete rows with their cluster 1..k, the keys of the k medoids, and the sum of distances to them.

    Medoids are built greedily and then swapped, the best of all swaps in each
    round, until none lowers the sum.  Every row counts in every sum; medoids are
    chosen among about ``candidates`` rows of the smallest hashes (all, if there
    are no more: then this is partitioning around medoids itself), which the tasks
    hold.  A round is one pass: k sums for each candidate come to the driver.
    Candidates are in order of the keys, and the first of equal ones is taken.
    No row: no medoid.  With fewer distinct candidates than k, as many clusters.
    """
    features = list(features)
    rows = saved(df.na.drop(subset=[key, *features]).withColumns({f: F.col(f).cast("double") for f in features}), "medoids")
    count = rows.count()
    some = rows if count <= candidates else rows.filter(_below(key, "medoids", candidates / count))
    found = some.select(key, *features).orderBy(key).collect()  # about ``candidates`` rows
    if not found:
        return rows.withColumn(out, F.lit(None).cast("int")), [], 0.0
    c = np.array([[r[f] for f in features] for r in found])
    total = _summed(rows, features, lambda x: _distances(x, c).sum(axis=0), (len(c),))
    chosen = [_least(total, float(total.max()))]
    cost = float(total[chosen[0]])
    while len(chosen) < k:
        have = c[chosen]
        gain = _summed(rows, features, lambda x: np.minimum(_distances(x, c) - _distances(x, have).min(axis=1)[:, None], 0).sum(axis=0), (len(c),))
        best = _least(gain, cost)
        if gain[best] >= -1e-9 * max(cost, 1e-300):
            break
        chosen.append(best)
        cost += float(gain[best])
    while len(chosen) > 1:
        have, many = c[chosen], len(chosen)

        def swaps(x: np.ndarray, have: np.ndarray = have, many: int = many) -> np.ndarray:
            near, d = _distances(x, have), _distances(x, c)
            at = near.argmin(axis=1)
            first = near[np.arange(len(x)), at]
            near[np.arange(len(x)), at] = np.inf
            # Rows of other medoids may only gain; rows of the one that goes take the new one or their second.
            gained = np.minimum(d - first[:, None], 0)
            own = np.minimum(d, near.min(axis=1)[:, None]) - first[:, None] - gained
            return gained.sum(axis=0) + np.stack([own[at == m].sum(axis=0) for m in range(many)])

        change = _summed(rows, features, swaps, (many, len(c)))
        best = _least(change, cost)
        if change.flat[best] >= -1e-9 * max(cost, 1e-300):
            break
        chosen[best // len(c)] = best % len(c)
        cost += float(change.flat[best])
    order = sorted(chosen)
    gaps = [F.sqrt(sum(((F.col(f) - F.lit(float(v))) ** 2 for f, v in zip(features, c[m], strict=True)), F.lit(0.0))) for m in order]
    label = F.array_position(F.array(*gaps), F.array_min(F.array(*gaps))).cast("int")
    return rows.withColumn(out, label), [found[m][key] for m in order], cost


def dindex_k(points: np.ndarray, sizes: np.ndarray, low: int, high: int) -> int | None:
    """The k within the range at which Ward's clusters of weighted points gain most by the Dindex: its largest second difference.

    The Dindex is the mean over clusters of the mean distance to the cluster's
    centre; None if the range leaves no k with a neighbour on both sides.
    """
    ks = [k for k in range(max(1, low - 1), high + 2) if k <= len(points)]
    if len(ks) < 3:
        return None
    index = []
    for k in ks:
        member, means = _ward(points, sizes, k), []
        for m in range(1, member.max() + 1):
            x, w = points[member == m], sizes[member == m]
            means.append(np.average(np.linalg.norm(x - np.average(x, axis=0, weights=w), axis=1), weights=w))
        index.append(float(np.mean(means)))
    bend = np.diff(index, 2)
    return ks[1 + int(np.argmax(bend))]


def k_suggestions(df: DataFrame, key: str, features: Sequence[str], ks: Sequence[int], restarts: int = 10, boots: int = 30, centres: int = 300, asked: int = 2000, seed: int = 1) -> DataFrame:
    """method, k: the numbers of clusters that four methods suggest on an evaluation sample, and their vote.

    pam: medoids, by mean silhouette.  kmeans: the least cost of ``restarts``
    runs, by mean silhouette.  ward: Ward's merges of at most ``centres`` weighted
    centres, by the Dindex.  bootstrap: the report's composite with stability.
    vote: the most frequent if it has two votes, else the median, over the
    suggestions within the range.  No row for an empty sample.
    """
    spark, ks, features = df.sparkSession, sorted(ks), list(features)
    rows = saved(evaluation_sample(df.select(key, *features).na.drop(), key), "k-suggestions")
    count, kind = rows.count(), "method string, k int"
    if not count:
        return spark.createDataFrame([], kind)
    few = _below(key, "silhouette", asked / count) if count > asked else None

    def best(cluster: Callable[[int], DataFrame]) -> int:
        scores = []
        for k in ks:
            labelled = saved(cluster(k), "k-labels")
            scores.append(silhouette(labelled, key, "cluster", features, few).first()[0])
            dropped(labelled)
        return ks[int(np.argmax([-np.inf if s is None else s for s in scores]))]

    found = [("pam", best(lambda k: medoids(rows, key, features, k)[0])), ("kmeans", best(lambda k: kmeans(rows, features, k, restarts=restarts, seed=seed, out="cluster")[0]))]
    micro = rows.withColumn("_micro", F.xxhash64(key)) if count <= centres else kmeans(rows, features, centres, restarts=1, seed=seed, out="_micro")[0]
    means = micro.groupBy("_micro").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in features]).orderBy(*features).collect()  # at most ``centres`` rows
    bent = dindex_k(np.array([[float(r[f]) for f in features] for r in means]), np.array([r["n"] for r in means]), ks[0], ks[-1])
    found += [("ward", bent)] if bent is not None else []
    found.append(("bootstrap", best_k(k_report(rows, key, features, ks, boots, seed, asked=asked))))
    votes = spark.createDataFrame(found, kind)
    return reduce(DataFrame.union, [votes, vote(votes, "k", ks[0], ks[-1]).select(F.lit("vote").alias("method"), F.col("k").cast("int").alias("k"))])
