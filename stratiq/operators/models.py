"""Strata and classes learned with MLlib, and per-series models in grouped pandas."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiq.sources.scratch import saved

from .geometry import within_filter
from .relational import complete_cases, top_n, zscores
from .stats import adjusted_rand, calinski_harabasz, davies_bouldin, drop_correlated, kappa_by, linear_combinations, near_zero_variance, silhouette, to_centroid, vote


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_v").transform(df)


def kmeans(df: DataFrame, features: Sequence[str], k: int, restarts: int = 3, seed: int = 1, out: str = "stratum") -> tuple[DataFrame, float]:
    """Clusters 1..k from the restart of the least cost, and that cost."""
    rows = _vectors(df, features)
    best = None
    for i in range(restarts):
        model = KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="_p", maxIter=20).fit(rows)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(rows).withColumn(out, F.col("_p") + 1).drop("_v", "_p"), best.summary.trainingCost


def _unclustered(df: DataFrame, key: str) -> DataFrame:
    """Every unit without a stratum: what remains where no unit is complete."""
    return df.select(key, F.lit(None).cast("int").alias("stratum"), F.lit(None).cast("double").alias("dist_to_center"), F.lit(None).cast("boolean").alias("candidate"))


def strata(df: DataFrame, key: str, features: Sequence[str], k: int, n: int, seed: int = 1) -> DataFrame:
    """Complete rows, standardised and clustered; every unit with its stratum, distance and whether it is among the n nearest (null outside)."""
    z = [f"{f}_z" for f in features]
    rows = saved(zscores(complete_cases(df.select(key, *features), features), features).na.drop(subset=z), "strata-rows")
    if rows.isEmpty():
        return _unclustered(df, key)
    clustered, _ = kmeans(rows, z, k, seed=seed)
    near = to_centroid(clustered, "stratum", z).select(key, "stratum", "dist_to_center")
    near = saved(near, "strata")
    best = top_n(near, n, ["stratum"], [F.col("dist_to_center"), F.col(key)]).select(key, F.lit(True).alias("candidate"))
    # By the size of their packed files, keys of millions of rows would be broadcast.
    return df.select(key).join(near.hint("merge"), key, "left").join(best, key, "left").withColumn("candidate", F.when(F.col("stratum").isNotNull(), F.coalesce("candidate", F.lit(False))))


def pca_scores(df: DataFrame, features: Sequence[str], n: int) -> DataFrame:
    """Standardised features' principal components pc1.. and origin_dist."""
    z = [f"{f}_z" for f in features]
    rows = _vectors(zscores(df, features).na.drop(subset=z), z)
    out = PCA(k=n, inputCol="_v", outputCol="_pc").fit(rows).transform(rows).withColumn("_a", vector_to_array("_pc"))
    out = out.withColumns({f"pc{i + 1}": F.col("_a")[i] for i in range(n)})
    return out.withColumn("origin_dist", F.sqrt(sum((F.col(f"pc{i + 1}") ** 2 for i in range(n)), F.lit(0.0)))).drop("_v", "_pc", "_a", *z)


def _below(key: str, salt: str, share: float) -> Column:
    """True for about ``share`` of the keys, chosen by a hash."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 52)).cast("double") < share * float(1 << 52)


def evaluation_sample(df: DataFrame, key: str, least: int = 2000, share: float = 0.2) -> DataFrame:
    """About max(least, share of the rows) rows, those whose key's hash is below that share of its range; all if there are no more."""
    count = df.count()
    want = max(least, int(np.ceil(share * count)))
    return df if count <= want else df.filter(_below(key, "k-sample", want / count))


#: Shares of a Poisson distribution of mean 1 up to each value.
POISSON = np.cumsum([np.exp(-1) / math.factorial(i) for i in range(19)])


def _mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """64 further bits of each hash (Steele, Lea and Flood's finaliser)."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64) + np.uint64(salt + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def replicate_weights(hashes: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """How often each row is drawn in a bootstrap replicate: Poisson of mean 1, by the row's hash."""
    share = (_mixed(hashes, 2 * replicate + 1000 * seed) >> np.uint64(11)).astype(float) * 2.0**-53
    return np.searchsorted(POISSON, share, side="right")


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


def _numbers(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns], axis=1)


def bootstrap_jaccard(rows: DataFrame, key: str, cluster: str, features: Sequence[str], k: int, boots: int = 30, rounds: int = 20, seed: int = 1) -> DataFrame:
    """replicate, cluster, jaccard: how well each cluster of ``rows`` returns in k-means of bootstrap replicates.

    A replicate draws each row as often as :func:`replicate_weights` says.  All
    replicates run in one pass for each round: tasks assign their rows to every
    replicate's centres and send weighted sums, ``boots`` times k centres; these
    alone come to the driver.  Centres start at the k drawn rows of the smallest
    hashes.  Clusters are compared over the rows drawn, each once; a replicate that
    draws no row of a cluster has no row for it.
    """
    features, width = list(features), len(features)
    packed = saved(rows.select(F.xxhash64(key, F.lit("bootstrap")).alias("_h"), F.col(cluster).alias("_c"), *[F.col(f).cast("double") for f in features]).na.drop(), "bootstrap")
    spark, named = rows.sparkSession, ", ".join(f"x{i} double" for i in range(width))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, x = batch.column(0).to_numpy(), _numbers(batch, features)
            for b in range(boots):
                rank = _mixed(h, 2 * b + 1 + 1000 * seed).astype(np.int64)
                rank[replicate_weights(h, b, seed) == 0] = np.iinfo(np.int64).max
                first = np.argsort(rank, kind="stable")[:k]
                first = first[rank[first] != np.iinfo(np.int64).max]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), b)), pa.array(rank[first]), *[pa.array(x[first, i]) for i in range(width)]], names=["b", "rank", *[f"x{i}" for i in range(width)]])

    chosen = top_n(packed.mapInArrow(starts, f"b long, rank long, {named}"), k, ["b"], [F.col("rank")])
    centres = np.full((boots, k, width), np.inf)
    for b, found in itertools.groupby(sorted(tuple(r) for r in chosen.collect()), key=lambda r: r[0]):  # boots * k rows
        for i, r in enumerate(found):
            centres[b, i] = r[2:]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((boots, k, width + 1))
        for batch in batches:
            h, x = batch.column(0).to_numpy(), _numbers(batch, features)
            for b in range(boots):
                w, at = replicate_weights(h, b, seed), _nearest(x, centres[b])
                for i in range(width):
                    total[b, :, i] += np.bincount(at, w * x[:, i], k)
                total[b, :, width] += np.bincount(at, w, k)
        used = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], names=["cell", "v"])

    for _ in range(rounds):
        total = np.zeros(boots * k * (width + 1))
        for r in packed.mapInArrow(summed, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # a row for each number of a centre
            total[r["cell"]] = r["v"]
        total = total.reshape(boots, k, width + 1)
        now = np.where(total[..., -1:] > 0, total[..., :-1] / np.maximum(total[..., -1:], 1), centres)
        still, centres = np.array_equal(now, centres), now
        if still:
            break

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, x, c = batch.column(0).to_numpy(), _numbers(batch, features), batch.column(1)
            for b in range(boots):
                drawn = np.flatnonzero(replicate_weights(h, b, seed))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(drawn), b)), c.take(pa.array(drawn)), pa.array(_nearest(x[drawn], centres[b]))], names=["replicate", cluster, "_again"])

    kind = dict(packed.dtypes)["_c"]
    cells = packed.mapInArrow(counted, f"replicate long, `{cluster}` {kind}, _again long").groupBy("replicate", cluster, "_again").agg(F.count(F.lit(1)).alias("n"))
    own, other = F.sum("n").over(Window.partitionBy("replicate", cluster)), F.sum("n").over(Window.partitionBy("replicate", "_again"))
    cells = cells.withColumns({"_own": own, "_other": other})
    return cells.groupBy("replicate", cluster).agg(F.max(F.col("n") / (F.col("_own") + F.col("_other") - F.col("n"))).alias("jaccard"))


REPORT = "k long, silhouette double, ch double, db double, wss double, stability double, score double"


def k_report(df: DataFrame, key: str, features: Sequence[str], ks: Sequence[int], boots: int = 30, seed: int = 1, restarts: int = 1, asked: int = 2000) -> DataFrame:
    """Indices for each k on an evaluation sample that the caller has drawn, their z-scores, and the composite score; no row if the sample is empty.

    The silhouette is that of about ``asked`` of its rows among all of them;
    stability is the mean over clusters and ``boots`` bootstrap replicates.
    """
    rows = saved(df.select(key, *features), "k-sample")
    count = rows.count()
    if not count:
        return df.sparkSession.createDataFrame([], REPORT)
    few = _below(key, "silhouette", asked / count) if count > asked else None
    found = []
    for k in ks:
        whole, cost = kmeans(rows, features, k, restarts=restarts, seed=seed)
        whole = saved(whole, "k-clusters")
        stable = bootstrap_jaccard(whole, key, "stratum", features, k, boots, seed=seed).agg(F.avg("jaccard")).first()[0]
        one = lambda t: float(t.first()[0] or 0.0)
        found.append((int(k), one(silhouette(whole, key, "stratum", features, few)), one(calinski_harabasz(whole, "stratum", features)), one(davies_bouldin(whole, "stratum", features)), float(cost), float(np.nan if stable is None else stable)))
    table = pd.DataFrame(found, columns=["k", "silhouette", "ch", "db", "wss", "stability"])
    z = lambda c: (table[c] - table[c].mean()) / (table[c].std() or 1.0)
    table["score"] = z("silhouette") + z("ch") - z("db") - 0.5 * z("wss") + 2 * z("stability")
    return df.sparkSession.createDataFrame(table)


def best_k(report: DataFrame) -> int:
    """The k of the highest score among those with a stability; if no k has one, by the score without it."""
    table = report.toPandas().sort_values("k")  # one row for each k
    sure = table[np.isfinite(table["stability"])]
    if len(sure):
        return int(sure["k"].iloc[int(np.argmax(sure["score"].fillna(-np.inf)))])
    z = lambda c: (table[c] - table[c].mean()) / (table[c].std() or 1.0)
    return int(table["k"].iloc[int(np.argmax(z("silhouette") + z("ch") - z("db") - 0.5 * z("wss")))])


def hopkins(df: DataFrame, key: str, features: Sequence[str], n: int = 50, seed: int = 1) -> DataFrame:
    """One row, hopkins: n rows and n uniform points against the data, nearest distances of both."""
    lows = df.agg(*[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features]).first()
    draw = np.random.default_rng(seed)
    uniform = [(int(-i - 1), *(float(draw.uniform(lows[f"lo_{f}"], lows[f"hi_{f}"])) for f in features)) for i in range(n)]
    kind = dict(df.dtypes)[key]
    probe = df.sparkSession.createDataFrame(uniform, f"_q {kind}, " + ", ".join(f"q_{f} double" for f in features)).withColumn("_real", F.lit(0))
    own = df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n).select(F.col(key).alias("_q"), *[F.col(f).cast("double").alias(f"q_{f}") for f in features], F.lit(1).alias("_real"))
    gap = F.sqrt(sum(((F.col(f) - F.col(f"q_{f}")) ** 2 for f in features), F.lit(0.0)))
    near = df.select(key, *features).join(F.broadcast(own.union(probe)), F.col(key) != F.col("_q")).groupBy("_q", "_real").agg(F.min(gap).alias("d"))
    sums = near.agg(F.sum(F.when(F.col("_real") == 0, F.col("d"))).alias("u"), F.sum(F.when(F.col("_real") == 1, F.col("d"))).alias("w"))
    return sums.select((F.col("u") / (F.col("u") + F.col("w"))).alias("hopkins"))


def forest(train: DataFrame, new: DataFrame, key: str, label: str, features: Sequence[str], trees: int = 20, depth: int = 6, mtry: int = 2, seed: int = 1) -> DataFrame:
    """key, pred_class, pred_pmax and p_<class> for each class seen in training."""
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    model = RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, maxDepth=depth, featureSubsetStrategy=str(mtry), seed=seed).fit(_vectors(indexer.transform(train), features))
    out = model.transform(_vectors(new, features)).withColumn("_p", vector_to_array("probability"))
    names = indexer.labels
    columns = [F.col("_p")[i].alias(f"p_{c}") for i, c in enumerate(names)]
    top = F.array_max("_p")
    return out.select(key, F.element_at(F.array(*map(F.lit, names)), F.array_position("_p", top).cast("int")).alias("pred_class"), top.alias("pred_pmax"), *columns)


def spatial_folds(df: DataFrame, x: str, y: str, folds: int, seed: int = 1) -> DataFrame:
    """Fold numbers 1..folds by k-means on coordinates."""
    return kmeans(df, [x, y], folds, restarts=1, seed=seed, out="fold")[0]


def block_kappa(rows: DataFrame, key: str, label: str, features: Sequence[str], fold: str, folds: Sequence[int], **options) -> float:
    """Mean kappa of forests that leave one spatial block out: each predicts the block that it has not seen."""
    found = None
    for i in folds:
        one = forest(rows.filter(F.col(fold) != i), rows.filter(F.col(fold) == i), key, label, features, **options).select(key, "pred_class")
        found = one if found is None else found.unionByName(one)
    both = rows.select(key, fold, label).join(found, key)
    return float(kappa_by(both, fold, label, "pred_class").agg(F.avg("kappa")).first()[0] or 0.0)


def forward_selection(rows: DataFrame, key: str, label: str, features: Sequence[str], fold: str, folds: Sequence[int], **options) -> tuple[list[str], float]:
    """The best pair of features by mean kappa over blocks, then one more at a time while it rises."""
    measure = lambda names: block_kappa(rows, key, label, names, fold, folds, **(options | {"mtry": min(options.get("mtry", 2), len(names))}))
    best, chosen = max((measure(list(p)), list(p)) for p in combinations(features, 2))
    while len(chosen) < len(features):
        score, more = max((measure([*chosen, f]), f) for f in features if f not in chosen)
        if score <= best:
            break
        best, chosen = score, [*chosen, more]
    return chosen, best


def tune_forest(rows: DataFrame, key: str, label: str, features: Sequence[str], fold: str, folds: Sequence[int], trees: Sequence[int], mtry: Sequence[int], depth: int = 6) -> DataFrame:
    """trees, mtry, kappa for each combination, the mean over spatial blocks that are left out in turn; best marks the highest."""
    found = [(t, m, block_kappa(rows, key, label, features, fold, folds, trees=t, mtry=m, depth=depth)) for t in trees for m in mtry if m <= len(features)]
    top = max(k for _, _, k in found)
    first = next(i for i, (_, _, k) in enumerate(found) if k == top)
    return rows.sparkSession.createDataFrame([(t, m, k, i == first) for i, (t, m, k) in enumerate(found)], "trees int, mtry int, kappa double, best boolean")


def choose_k(report: DataFrame, low: int, high: int) -> int | None:
    """The k that most indices of a report prefer (see :func:`stratiq.operators.stats.vote`); None for an empty report."""
    ks = report.select(F.explode(F.array(*[F.struct(F.lit(sign).alias("s"), F.col("k"), (F.col(c) * sign).alias("v"), F.lit(c).alias("c")) for c, sign in (("silhouette", 1), ("ch", 1), ("db", -1), ("score", 1))])).alias("x"))
    picks = ks.groupBy("x.c").agg(F.max_by("x.k", "x.v").alias("k"))
    found = vote(picks, "k", low, high).first()
    return int(found[0]) if found is not None and found[0] is not None else None


def domain_strata(df: DataFrame, key: str, features: Sequence[str], hull: Sequence[tuple[float, float]], ks: Sequence[int], n: int, x: str = "x", y: str = "y", cutoff: float = 0.95) -> DataFrame:
    """Strata of one domain, all steps: units in the hull, complete ones, predictors pruned, k chosen by vote on an evaluation sample, clusters, the n nearest of each.

    Every unit of ``df`` is returned; stratum, dist_to_center and candidate are
    null outside the hull and for incomplete units.
    """
    inside = saved(complete_cases(within_filter(df, hull, x, y), features).select(key, *features), "domain")
    if inside.isEmpty():
        return _unclustered(df, key)
    flat = {r["column"] for r in near_zero_variance(inside, features).filter("nzv").collect()}
    kept = [f for f in features if f not in flat]
    kept = drop_correlated(inside, kept, cutoff)
    kept = [f for f in kept if f not in set(linear_combinations(inside, kept))]
    z = [f"{f}_z" for f in kept]
    rows = saved(zscores(inside, kept).na.drop(subset=z).select(key, *kept, *z), "domain-z")
    k = choose_k(k_report(evaluation_sample(rows, key), key, z, ks), min(ks), max(ks))
    if k is None:
        return _unclustered(df, key)
    found = strata(rows, key, kept, k, n)
    return df.select(key).join(found, key, "left")


@functools.cache
def mosum_boundary(level: float, h: float = 0.25, period: float = 10.0, steps: int = 100, paths: int = 4000, seed: int = 1) -> float:
    """Critical value of the monitoring OLS-MOSUM process, by simulation.

    Under no break the sums of residuals behave as a Brownian motion less its
    value at the end of the history times t.  The value is the 1 - ``level``
    quantile, over simulated paths, of the largest moving sum over a window of
    ``h`` between the history's end (t = 1) and ``period``, each over
    sqrt(2 log+ t), the shape of the boundary.
    """
    draw, width = np.random.default_rng(seed), max(1, int(h * steps))
    t = np.arange(1, int(period * steps) + 1) / steps
    shape = np.sqrt(2 * np.maximum(1.0, np.log(t)))[steps:]
    tops = []
    for _ in range(paths // 500):
        path = np.cumsum(draw.normal(0, steps**-0.5, (500, len(t))), axis=1)
        path -= path[:, steps - 1 : steps] * t
        tops.append((np.abs(path[:, steps:] - path[:, steps - width : -width]) / shape).max(axis=1))
    return float(np.quantile(np.concatenate(tops), 1 - level))


def _breaks(value: np.ndarray, month: np.ndarray, start: int, boundary: float, h: float = 0.25) -> tuple[float, float]:
    """Month and magnitude of the first boundary crossing of the moving sums of residuals; NaN without one."""
    t = month.astype(float)
    year = 2 * np.pi * t / 12
    design = np.column_stack([np.ones_like(t), t, *(f(k * year) for k in (1, 2, 3) for f in (np.cos, np.sin))])
    past, ahead = month < start, month >= start
    if past.sum() <= design.shape[1] + 1 or not ahead.any():
        return np.nan, np.nan
    beta, *_ = np.linalg.lstsq(design[past], value[past], rcond=None)
    residual = value - design @ beta
    n = int(past.sum())
    sigma = np.sqrt((residual[past] ** 2).sum() / max(1, n - design.shape[1]))
    magnitude = float(np.median(residual[ahead]))
    if not sigma > 1e-12:
        return np.nan, magnitude
    width = max(1, int(n * h))
    sums = np.concatenate([[0.0], np.cumsum(residual)])
    for i in range(n, len(value)):
        stat = abs(sums[i + 1] - sums[max(0, i + 1 - width)]) / (sigma * np.sqrt(n))
        ratio = (i + 1) / n
        if stat > boundary * np.sqrt(2 * max(1.0, np.log(ratio))):
            return float(month[i]), magnitude
    return np.nan, magnitude


def break_detection(series: DataFrame, by: str, month: str, value: str, start: int, level: float = 0.01) -> DataFrame:
    """by, break_month, magnitude: a season-trend model on the history before ``start``, monitored after it.  A series is one pixel's: small."""

    boundary = mosum_boundary(level)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["v"]).sort_values("m")
        when, size = _breaks(pdf["v"].to_numpy(float), pdf["m"].to_numpy(int), start, boundary)
        return pd.DataFrame({"k": [pdf["k"].iloc[0] if len(pdf) else None], "break_month": [when], "magnitude": [size]})

    kind = dict(series.dtypes)[by]
    rows = series.select(F.col(by).alias("k"), F.col(month).cast("int").alias("m"), F.col(value).cast("double").alias("v")).filter("v is not null")
    out = rows.groupBy("k").applyInPandas(one, f"k {kind}, break_month double, magnitude double")
    return out.withColumnRenamed("k", by).withColumn("break_month", F.nanvl("break_month", F.lit(None).cast("double"))).withColumn("magnitude", F.nanvl("magnitude", F.lit(None).cast("double")))


def _ward(x: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Ward's clusters 1..k of weighted points, by the pair that adds least to the sum of squares."""
    x, size, member, live = x.copy(), size.astype(float).copy(), np.arange(len(x)), np.ones(len(x), bool)
    cost = size[:, None] * size / (size[:, None] + size) * ((x[:, None] - x) ** 2).sum(axis=2)
    cost[np.tril_indices(len(x))] = np.inf
    for _ in range(len(x) - k):
        a, b = np.unravel_index(int(cost.argmin()), cost.shape)
        x[a], size[a] = (size[a] * x[a] + size[b] * x[b]) / (size[a] + size[b]), size[a] + size[b]
        member[member == b] = a
        live[b] = False
        cost[b, :] = cost[:, b] = np.inf
        new = np.where(live, size[a] * size / (size[a] + size) * ((x - x[a]) ** 2).sum(axis=1), np.inf)
        cost[a, a + 1 :], cost[:a, a] = new[a + 1 :], new[:a]
    return np.searchsorted(np.unique(member), member) + 1


def ward(tiles: DataFrame, key: str, features: Sequence[str], k: int, centres: int = 300, seed: int = 1) -> DataFrame:
    """key, cluster (1..k): Ward's clusters of micro-clusters.

    k-means on Spark reduces the rows, however many, to at most ``centres``
    weighted centres; Ward's merges run on these, and the labels go back to all
    rows.  With no more rows than centres the result is that of Ward's method.
    """
    rows = saved(tiles.select(key, *features).na.drop(), "ward-rows")
    if rows.isEmpty():
        return rows.select(key, F.lit(None).cast("int").alias("cluster"))
    if rows.count() <= centres:
        micro = rows.withColumn("_micro", F.dense_rank().over(Window.orderBy(key)))  # at most ``centres`` rows
    else:
        micro, _ = kmeans(rows, features, centres, restarts=1, seed=seed, out="_micro")
    micro = saved(micro, "ward-micro")
    # One row for each centre.
    found = micro.groupBy("_micro").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in features]).orderBy("_micro").collect()
    member = _ward(np.array([[float(r[f]) for f in features] for r in found]), np.array([r["n"] for r in found]), min(k, len(found)))
    labels = tiles.sparkSession.createDataFrame([(r["_micro"], int(m)) for r, m in zip(found, member, strict=True)], "_micro int, cluster int")
    return micro.join(F.broadcast(labels), "_micro").select(key, "cluster")


def scale_stability(base: DataFrame, others: Sequence[DataFrame], cell: str, label: str) -> DataFrame:
    """One row: mean and sd of the adjusted Rand index of a segmentation against its perturbations."""
    found = None
    for o in others:
        one = adjusted_rand(base.select(cell, F.col(label).alias("_a")).join(o.select(cell, F.col(label).alias("_b")), cell), "_a", "_b")
        found = one if found is None else found.union(one)
    return found.agg(F.avg("ari").alias("ari_prev"), F.stddev_samp("ari").alias("ari_sd")).withColumn("score", F.col("ari_prev") - F.coalesce("ari_sd", F.lit(0.0)))
