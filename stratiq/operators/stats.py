"""Agreement of partitions, cluster quality, correlation and distances, as grouped sums."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiq.functions.numeric import div
from stratiq.sources.scratch import saved

from .relational import MOST_TASKS, quantile_bins, quantiles, small, spread, top_n, with_totals


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r for every pair of columns, from one pass; rows with a null in a pair are left out of that pair."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def drop_correlated(df: DataFrame, columns: Sequence[str], cutoff: float = 0.9) -> list[str]:
    """Columns kept in order: each only if no kept one correlates with it beyond the cutoff."""
    r = {(x["a"], x["b"]): x["r"] for x in corr_matrix(df, columns).collect()}  # one row per pair of columns
    kept: list[str] = []
    for c in columns:
        if all(abs(r.get((k, c)) or 0.0) <= cutoff for k in kept):
            kept.append(c)
    return kept


def _pairs2(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, ari: null if the denominator is 0."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = cells.agg(F.sum(_pairs2(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(_pairs2(F.col("n"))).alias(name))
    all_ = both.crossJoin(side(a, "sa")).crossJoin(side(b, "sb"))
    expected = div(F.col("sa") * F.col("sb"), _pairs2(F.col("n")))
    return all_.select(div(F.col("ij") - expected, (F.col("sa") + F.col("sb")) / 2 - expected).alias("ari"))


def kappa(df: DataFrame, truth: str, found: str) -> DataFrame:
    """One row: n, accuracy, kappa."""
    cells = df.groupBy(truth, found).agg(F.count(F.lit(1)).cast("double").alias("n"))
    hit = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(truth) == F.col(found), F.col("n")).otherwise(0.0)).alias("hits"))
    t = cells.groupBy(F.col(truth).alias("k")).agg(F.sum("n").alias("t"))
    f = cells.groupBy(F.col(found).alias("k")).agg(F.sum("n").alias("f"))
    chance = t.join(f, "k").agg(F.coalesce(F.sum(F.col("t") * F.col("f")), F.lit(0.0)).alias("tf"))
    po, pe = F.col("hits") / F.col("n"), F.col("tf") / (F.col("n") * F.col("n"))
    return hit.crossJoin(chance).select(F.col("n").cast("long").alias("n"), po.alias("accuracy"), div(po - pe, 1 - pe).alias("kappa"))


def kappa_by(df: DataFrame, by: str, truth: str, found: str) -> DataFrame:
    """by, n, accuracy, kappa for each fold, and mean_kappa over the folds."""
    cells = df.groupBy(by, truth, found).agg(F.count(F.lit(1)).cast("double").alias("c"))
    hit = cells.groupBy(by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(truth) == F.col(found), F.col("c")).otherwise(0.0)).alias("hits"))
    t = cells.groupBy(by, F.col(truth).alias("k")).agg(F.sum("c").alias("t"))
    f = cells.groupBy(by, F.col(found).alias("k")).agg(F.sum("c").alias("f"))
    chance = t.join(f, [by, "k"]).groupBy(by).agg(F.sum(F.col("t") * F.col("f")).alias("tf"))
    po, pe = F.col("hits") / F.col("n"), F.coalesce("tf", F.lit(0.0)) / (F.col("n") * F.col("n"))
    out = hit.join(chance, by, "left").select(by, F.col("n").cast("long").alias("n"), po.alias("accuracy"), div(po - pe, 1 - pe).alias("kappa"))
    return with_totals(out, mean_kappa=F.avg("kappa"))


def centroids(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    return df.groupBy(cluster).agg(*[F.avg(f).alias(f"c_{f}") for f in features], F.count(F.lit(1)).alias("size"))


def distance(features: Sequence[str], prefix: str = "c_") -> Column:
    return F.sqrt(sum(((F.col(f) - F.col(f"{prefix}{f}")) ** 2 for f in features), F.lit(0.0)))


def to_centroid(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Rows with dist_to_center, the distance to their own cluster's mean."""
    return df.join(small(centroids(df, cluster, features), 100_000), cluster).withColumn("dist_to_center", distance(features))


def calinski_harabasz(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """One row, ch: between and within sums of squares from sums per cluster alone."""
    sums = df.groupBy(cluster).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f).alias(f"s_{f}") for f in features], sum((F.sum(F.col(f) * F.col(f)) for f in features), F.lit(0.0)).alias("q"))
    own = sum((F.col(f"s_{f}") * F.col(f"s_{f}") for f in features), F.lit(0.0)) / F.col("n")
    total = sums.agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), F.sum("q").alias("q"), F.sum(own).alias("own"), *[F.sum(f"s_{f}").alias(f"t_{f}") for f in features])
    grand = sum((F.col(f"t_{f}") * F.col(f"t_{f}") for f in features), F.lit(0.0)) / F.col("n")
    between, within = F.col("own") - grand, F.col("q") - F.col("own")
    return total.select(div(div(between, F.col("k") - 1), div(within, F.col("n") - F.col("k"))).alias("ch"))


def davies_bouldin(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """One row, db: the mean over clusters of the worst (spread + spread) / separation.

    The measure compares all pairs of clusters, never of rows; clusters are few,
    and one array of them is read by each.
    """
    spread = to_centroid(df, cluster, features).groupBy(cluster).agg(F.avg("dist_to_center").alias("s"), F.array(*[F.first(f"c_{f}") for f in features]).alias("c"))
    rows = with_totals(spread, _all=F.collect_list(F.struct(F.col(cluster).alias("k"), "s", "c")))
    others = F.filter("_all", lambda o: o["k"] != F.col(cluster))
    gap = lambda o: F.sqrt(F.aggregate(F.zip_with("c", o["c"], lambda x, y: (x - y) ** 2), F.lit(0.0), lambda a, t: a + t))
    worst = rows.select(F.array_max(F.transform(others, lambda o: (F.col("s") + o["s"]) / F.nullif(gap(o), F.lit(0.0)))).alias("r"))
    return worst.agg(F.avg("r").alias("db"))


def silhouette(df: DataFrame, key: str, cluster: str, features: Sequence[str], queries: Column | None = None) -> DataFrame:
    """One row, silhouette: the mean Euclidean silhouette of the rows that meet ``queries`` (all by default) among all rows.

    Mean distances to each cluster are partial sums; the queries, a stated set of
    a checked size, meet all rows by broadcast.
    """
    rows = df.select(key, cluster, *features)
    asked = (rows.filter(queries) if queries is not None else rows).select(F.col(key).alias("_k"), F.col(cluster).alias("_c"), *[F.col(f).alias(f"q_{f}") for f in features])
    near = rows.join(small(asked), F.col(key) != F.col("_k")).groupBy("_k", "_c", cluster).agg(F.avg(distance(features, "q_")).alias("d"))
    own = F.max(F.when(F.col(cluster) == F.col("_c"), F.col("d")))
    out = F.min(F.when(F.col(cluster) != F.col("_c"), F.col("d")))
    per = near.groupBy("_k").agg(own.alias("a"), out.alias("b"))
    return per.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise(div(F.col("b") - F.col("a"), F.greatest("a", "b")))).alias("silhouette"))


def cluster_jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    """For each cluster of a, the best Jaccard overlap with a cluster of b."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    na, nb = F.sum("n").over(Window.partitionBy(a)), F.sum("n").over(Window.partitionBy(b))
    return cells.withColumn("_a", na).withColumn("_b", nb).groupBy(a).agg(F.max(F.col("n") / (F.col("_a") + F.col("_b") - F.col("n"))).alias("jaccard"))


def pca_two(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with the distance to the origin on two standardised variables, and the share of the first component, (1 + |r|) / 2."""
    t = with_totals(df, _mx=F.avg(x), _my=F.avg(y), _sx=F.stddev_samp(x), _sy=F.stddev_samp(y), _r=F.corr(x, y))
    zx, zy = div(F.col(x) - F.col("_mx"), "_sx"), div(F.col(y) - F.col("_my"), "_sy")
    s = F.sqrt(F.lit(2.0))
    out = t.withColumn("pc_sum", (zx + zy) / s).withColumn("pc_diff", (zx - zy) / s).withColumn("origin_dist", F.sqrt(zx * zx + zy * zy))
    return out.withColumn("explained", (1 + F.abs(F.col("_r"))) / 2).drop("_mx", "_my", "_sx", "_sy", "_r")


def vote(ks: DataFrame, k: str, low: int, high: int) -> DataFrame:
    """One row, k: the most frequent value within the range if it has two votes (the smallest of ties), else the integer median."""
    inside = ks.filter(F.col(k).between(low, high))
    n = inside.groupBy(k).agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.max(F.struct("n", (-F.col(k)).alias("neg"))).alias("t"))
    mid = inside.agg(F.percentile(k, F.lit(0.5)).alias("m"))
    return top.crossJoin(mid).select(F.when(F.col("t.n") >= 2, -F.col("t.neg")).otherwise(F.floor("m")).cast("long").alias("k"))


def near_zero_variance(df: DataFrame, columns: Sequence[str], ratio: float = 19.0, unique: float = 10.0) -> DataFrame:
    """column, freq_ratio, pct_unique, nzv for each column: most common against second most common value, and distinct values a hundred rows.

    One scan: values of all columns are counted together, then the counts.
    """
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = each.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("column", "n").agg(F.count(F.lit(1)).alias("times"))
    # Distinct counts of N rows number at most sqrt(2 N); the two highest decide.
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc()))
    both = counts.withColumn("_r", rank).groupBy("column").agg(
        F.max("n").alias("n1"), F.max(F.when(F.col("_r") == 1, F.col("times"))).alias("tops"), F.max(F.when(F.col("_r") == 2, F.col("n"))).alias("n2"), F.sum("times").alias("d"), F.sum(F.col("times") * F.col("n")).alias("rows")
    )
    out = both.select("column", F.when(F.col("tops") > 1, 1.0).when(F.col("n2").isNull(), 0.0).otherwise(F.col("n1") / F.col("n2")).alias("freq_ratio"), (100.0 * F.col("d") / F.col("rows")).alias("pct_unique"), "d")
    return out.withColumn("nzv", (F.col("freq_ratio") > ratio) & (F.col("pct_unique") <= unique) | (F.col("d") <= 1)).drop("d")


def linear_combinations(df: DataFrame, columns: Sequence[str], least: float = 1e-7) -> list[str]:
    """Columns to drop, in order, so that no kept one is a linear combination of those before it and a constant.

    From one pass for the sums of products (centred and scaled); the elimination
    runs on a matrix of columns by columns.
    """
    import numpy as np

    t = with_totals(df.select(*columns).na.drop(), **{f"_m_{c}": F.avg(c) for c in columns})
    z = [F.col(c) - F.col(f"_m_{c}") for c in columns]
    n = len(columns)
    row = t.agg(*[F.sum(z[i] * z[j]).alias(f"{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    gram = np.array([[row[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    scale = np.sqrt(np.clip(np.diag(gram), 1e-300, None))
    gram = gram / np.outer(scale, scale)
    kept: list[int] = []
    for i in range(n):
        if kept:
            known = gram[np.ix_(kept, kept)]
            left = gram[i, i] - gram[i, kept] @ np.linalg.solve(known, gram[kept, i])
        else:
            left = gram[i, i]
        if left > least:
            kept.append(i)
    return [c for i, c in enumerate(columns) if i not in kept]


def _blocks(df: DataFrame, key: str, features: Sequence[str], rows: int, name: str, *more: str) -> DataFrame:
    """Rows packed by about ``rows``, in key order: ``name``_k (key and ``more``) and ``name``_x (all features, row by row; null as nan)."""
    n = df.count()
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    packed = df.groupBy(F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // rows)))).alias("_b")).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), *more, x.alias("x")))).alias("_r"))
    kept = F.transform("_r", lambda r: F.struct(r["k"].alias("k"), *[r[m].alias(m) for m in more]))
    return packed.select(kept.alias(f"{name}_k"), F.flatten(F.transform("_r", lambda r: r["x"])).alias(f"{name}_x"))


def _block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every block of the one with every block of the other, a few pairs in a task."""
    left, right = saved(left, "blocks"), saved(right, "blocks")
    n = left.count() * right.count()
    parts = max(1, min(n, MOST_TASKS // 10))
    return spread(left.crossJoin(right), max(1, -(-n // parts)), rows=n)


def _gaps(x: pa.Array | np.ndarray, y: pa.Array | np.ndarray, x_keys: list, y_keys: list, width: int, first: int, last: int) -> np.ndarray:
    """Euclidean distances of some rows of a block to all of another, summed feature by feature; nan for a row and itself."""
    one, two = (np.asarray(v, float).reshape(-1, width) for v in (x, y))
    gap = np.zeros((last - first, len(two)))
    for c in range(width):
        step = one[first:last, c, None] - two[None, :, c]
        gap += step * step
    np.sqrt(gap, out=gap)
    at: dict = {}
    for j, k in enumerate(y_keys):
        at.setdefault(k, []).append(j)
    for i, k in enumerate(x_keys[first:last]):
        gap[i, at.get(k, [])] = np.nan
    return gap


#: Points of a leaf of the tree that parts them, leaves at most, rows of the sample for each leaf, queries that meet a block at once.
LEAF, LEAVES, DRAWN, ASKED = 2_000, 4_096, 16, 4_000


def _tree(rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and value of each cut, level by level: at the median of the feature that varies most in its part of the rows."""
    feature, cut, parts = np.zeros(2**depth - 1, int), np.zeros(2**depth - 1), [rows]
    for i in range(len(cut)):
        if len(parts[i]):
            feature[i] = parts[i].var(axis=0).argmax()
            cut[i] = np.median(parts[i][:, feature[i]])
        low = parts[i][:, feature[i]] <= cut[i]
        parts += [parts[i][low], parts[i][~low]]
    return feature, cut


def _leaves(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), int)
    while len(at) and at[0] < len(cut):
        at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
    return at - len(cut)


def _flat(x: pa.Array, width: int) -> np.ndarray:
    """Rows of features of an array of arrays."""
    return np.asarray(x.flatten(), float).reshape(-1, width)


def _under(x: np.ndarray, y: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows of x and y that are nearer than x's own ``far``, and their distances; None where rounding can't be bounded."""
    x2, y2 = (x * x).sum(axis=1), (y * y).sum(axis=1)
    if not (np.isfinite(x2).all() and np.isfinite(y2).all() and np.isfinite(far).all()):
        return None
    rounding = 1e-12 * (x2.max(initial=0) + y2.max(initial=0))
    i, j = np.nonzero((x @ y.T) * -2 + y2 <= (far * far * (1 + 1e-12) + rounding - x2)[:, None])
    gap = np.zeros(len(i))
    for c in range(x.shape[1]):
        step = x[i, c] - y[j, c]
        gap += step * step
    gap = np.sqrt(gap)
    return tuple(v[gap < far[i]] for v in (i, j, gap))


def _least(x: np.ndarray, y: np.ndarray, far: np.ndarray, x_keys: list, y_keys: list, k: int) -> list[list[float]]:
    """For each row of x the k least distances to rows of y of another key: those under ``far``, or all where that is infinite."""
    found = _under(x, y, far)
    if found is None:
        gap = _gaps(x.ravel(), y.ravel(), x_keys, y_keys, x.shape[1], 0, len(x))
        part = np.sort(np.partition(gap, k - 1, axis=1)[:, :k] if gap.shape[1] > k else gap, axis=1)
        return [row[~np.isnan(row) & ((row < f) | np.isinf(f))].tolist() for row, f in zip(part, far, strict=True)]
    out: list[list[float]] = [[] for _ in x]
    for i, j, gap in zip(*(v.tolist() for v in found), strict=True):
        if x_keys[i] != y_keys[j]:
            out[i].append(gap)
    return [sorted(row)[:k] for row in out]


def _asked(visits: DataFrame, blocks: DataFrame, width: int, k: int) -> DataFrame:
    """``visits`` (_b, _key, _x, _far) with ``_d``, the least distances to the points of block ``_b``; a block meets a bounded number of them at once."""
    visits = saved(visits, "knn-visits")
    parts = visits.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("_parts"))
    parts = saved(parts, "knn-parts")
    n = max(-(-(parts.agg(F.sum("_parts")).first()[0] or 0) // 8), int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = min(MOST_TASKS, n)

    @F.arrow_udf("array<array<double>>")
    def least(x: pa.Array, far: pa.Array, x_keys: pa.Array, y: pa.Array, y_keys: pa.Array) -> pa.Array:
        out = []
        for i in range(len(x)):
            one, most, own = np.asarray(x[i].values, float).reshape(-1, width), np.asarray(far[i].values, float), x_keys[i].as_py()
            other, theirs = (np.asarray(y[i].values, float).reshape(-1, width), y_keys[i].as_py()) if y[i].is_valid else (np.zeros((0, width)), [])
            found = []
            step = max(16, min(256, 512_000 // max(1, len(other))))
            for at in range(0, len(one), step):
                found += _least(one[at : at + step], other, most[at : at + step], own[at : at + step], theirs, k)
            out.append(found)
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    dealt = visits.join(small(parts), "_b").withColumn("_part", F.pmod(F.xxhash64("_key", "_x"), F.col("_parts")).cast("int")).repartition(n, "_b", "_part")
    groups = dealt.groupBy("_b", "_part").agg(F.collect_list(F.struct("_key", "_x", "_far")).alias("_q"))
    copies = blocks.join(small(parts), "_b").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts").repartition(n, "_b", "_part")
    met = groups.join(copies.hint("merge"), ["_b", "_part"], "left")
    met = met.select("_b", "_q", least(F.flatten("_q._x"), "_q._far", "_q._key", "_p._x", "_p._key").alias("_d"))
    return met.select("_b", F.explode(F.arrays_zip("_q", "_d")).alias("r")).select("_b", "r._q._key", "r._q._x", "r._d")


def knn_distance(queries: DataFrame, points: DataFrame, key: str, features: Sequence[str], k: int) -> DataFrame:
    """The distance of each query row to its k-th nearest point, null if it has fewer.

    A tree parts the space at medians of a bounded sample; the points of a leaf are
    one block, or several of bounded size.  Each query meets a block of its own
    leaf first; what it finds there bounds its distance, and it then meets the
    other blocks whose leaf has a box within that bound.  Blocks left out cannot
    hold a nearer point, so the result is that of all pairs.  Rows with a null or
    nan feature are no neighbours.  The more features, the less a box rules out
    and the more a visit carries: leaves then hold more points.
    """
    width = len(features)
    leaf_rows = max(LEAF * max(1, width // 8), 8 * k)
    known = lambda df: df.select(F.col(key).alias("_key"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x")).filter(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    near_to, asked = known(points), known(queries)
    n = near_to.count()
    depth = max(0, min(int(np.log2(LEAVES)), int(np.ceil(np.log2(max(1, n / leaf_rows))))))
    want = DRAWN * 2**depth
    some = near_to.filter(F.pmod(F.xxhash64("_key", F.lit("tree")), F.lit(1 << 52)) < F.lit(int(min(1.0, want / max(1, n)) * (1 << 52)))).limit(2 * want).select("_x")
    drawn = _flat(some.toArrow().column(0).combine_chunks(), width) if depth else np.zeros((0, width))  # a bounded sample
    feature, cut = _tree(drawn[np.isfinite(drawn).all(axis=1)], depth)

    @F.arrow_udf("int")
    def leaf(x: pa.Array) -> pa.Array:
        return pa.array(_leaves(_flat(x, width), feature, cut).astype(np.int32))

    ends = [f(F.col("_x")[c]).alias(f"_{f.__name__}{c}") for f in (F.min, F.max) for c in range(width)]
    sizes = near_to.withColumn("_leaf", leaf("_x")).groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n"), *ends).orderBy("_leaf").collect()  # a row for each leaf
    filled = np.array([r["_leaf"] for r in sizes], int)
    low, high = (np.array([[r[f"_{f}{c}"] for c in range(width)] for r in sizes], float).reshape(-1, width) for f in ("min", "max"))
    subs = np.ones(2**depth, int)
    subs[filled] = [-(-r["_n"] // (2 * leaf_rows)) for r in sizes]
    start = np.cumsum(subs) - subs

    @F.arrow_udf("int")
    def block(x: pa.Array, h: pa.Array) -> pa.Array:
        at = _leaves(_flat(x, width), feature, cut)
        return pa.array((start[at] + np.asarray(h) % subs[at]).astype(np.int32))

    @F.arrow_udf("array<int>")
    def reached(x: pa.Array, far: pa.Array, own: pa.Array) -> pa.Array:
        rows, most, mine = _flat(x, width), np.asarray(far, float), np.asarray(own)
        ends, out = [0], []
        for at in range(0, len(rows), 64):
            one = rows[at : at + 64]
            gap = np.zeros((len(one), len(filled)))
            with np.errstate(invalid="ignore"):
                for c in range(width):
                    v = one[:, c, None]
                    gap += np.fmax(np.fmax(low[None, :, c] - v, v - high[None, :, c]), 0) ** 2
            close = (np.sqrt(gap) * (1 - 1e-12) < most[at : at + 64, None]) | np.isinf(most[at : at + 64, None])
            for i in range(len(one)):
                to = filled[close[i]]
                found = np.repeat(start[to] - np.cumsum(subs[to]) + subs[to], subs[to]) + np.arange(subs[to].sum())
                out.append(found[found != mine[at + i]])
                ends.append(ends[-1] + len(out[-1]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int32()))

    mix = F.pmod(F.xxhash64("_key"), F.lit(1 << 40))
    blocks = saved(near_to.withColumn("_b", block("_x", mix)).groupBy("_b").agg(F.collect_list(F.struct("_key", "_x")).alias("_p")), "knn-points")
    blocks = blocks.select("_b", F.struct(F.col("_p._key").alias("_key"), F.flatten("_p._x").alias("_x")).alias("_p"))
    first = saved(_asked(asked.select(block("_x", mix).alias("_b"), "_key", "_x", F.lit(float("inf")).alias("_far")), blocks, width, k), "knn-first")
    far = first.select("_key", "_x", F.coalesce(F.get("_d", F.lit(k - 1)), F.lit(float("inf"))).alias("_far"), "_b")
    more = _asked(far.select(F.explode(reached("_x", "_far", "_b")).alias("_b"), "_key", "_x", "_far"), blocks, width, k)
    none = queries.select(F.col(key).alias("_key"), F.array().cast("array<double>").alias("_d"))
    near = first.select("_key", "_d").unionByName(more.filter(F.size("_d") > 0).select("_key", "_d")).unionByName(none)
    merged = near.groupBy(F.col("_key").alias(key)).agg(F.sort_array(F.flatten(F.collect_list("_d"))).alias("_d"))
    out = merged.select(key, F.get("_d", F.lit(k - 1)).alias("knn"))
    return out if points.limit(k + 1).count() > k else out.filter("knn is not null")


def dissimilarity(new: DataFrame, train: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Area of applicability: distance to the nearest training row over the mean distance within training.  ``train`` is a set of a checked size."""
    t = train.select(F.col(key).alias("_t"), *[F.col(f).alias(f"t_{f}") for f in features])
    u = train.select(F.col(key).alias("_u"), *features)
    mean = u.join(small(t), F.col("_u") < F.col("_t")).agg(F.avg(distance(features, "t_")).alias("_mean"))
    near = new.select(key, *features).join(small(t), F.col(key) != F.col("_t")).groupBy(key).agg(F.min(distance(features, "t_")).alias("_min"))
    return near.crossJoin(F.broadcast(mean)).select(key, div("_min", "_mean").alias("di"))


def knn_bandwidths(queries: DataFrame, points: DataFrame, key: str, features: Sequence[str], k: int, probs: Sequence[float]) -> DataFrame:
    """prob, bandwidth: quantiles of the k-th nearest distances of the queries."""
    found = quantiles(knn_distance(queries, points, key, features, k), "knn", probs)
    return queries.sparkSession.createDataFrame([(float(p), x) for p, x in zip(probs, found, strict=True)], "prob double, bandwidth double")


def knee(sizes: DataFrame, n: str, floor: int, half: int) -> DataFrame:
    """One row, cutoff: the size at the sharpest bend of sorted log sizes, smoothed by a running median, not under ``floor``.

    Distinct sizes are ordered, not rows: few even for many labels.
    """
    from .raster import running_median, second_difference

    distinct = sizes.groupBy(F.col(n).alias("size")).agg(F.count(F.lit(1)).alias("labels")).filter(F.col("size") > 0).withColumn("_all", F.lit(1)).withColumn("_log", F.ln("size"))
    smooth = running_median(distinct, ["_all"], "size", "_log", half)
    bent = second_difference(smooth, ["_all"], "size", "running_median").withColumn("_next", F.lead("size").over(Window.partitionBy("_all").orderBy("size")))
    best = bent.filter("second_difference is not null").agg(F.max(F.struct(F.round("second_difference", 9).alias("d"), (-F.col("_next")).alias("s"))).alias("b"))
    return best.select(F.greatest(-F.col("b.s"), F.lit(floor)).cast("long").alias("cutoff"))


def patch_scales(patches: DataFrame, area: str, probs: Sequence[float]) -> DataFrame:
    """Radii sqrt(A / pi) of patches at the probabilities given: scale_id, radius."""
    found = quantiles(patches.select(F.sqrt(F.col(area) / F.lit(3.141592653589793)).alias("r")), "r", probs)
    return patches.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(found)], "scale_id int, radius double")


def applicability(new: DataFrame, train: DataFrame, key: str, features: Sequence[str], weights: dict[str, float] | None = None, label: str | None = None) -> DataFrame:
    """Area of applicability: key, di, lpd, inside, and near_label if training rows have a label.

    di: distance to the nearest training row over the mean distance within
    training, features times their weights.  The threshold is the largest such
    index of a training row that is no outlier (over the upper quartile by more
    than 1.5 quartile ranges).  lpd: training rows within the threshold; inside:
    at least one is.  A row is not its own neighbour.  Blocks of rows meet blocks
    of training rows: pairs are reduced where they are made, neither shuffled nor
    sorted by Spark.
    """
    w = weights or {}
    scaled = lambda df, name: df.select(F.col(key).alias(name), *[(F.col(f) * w.get(f, 1.0)).alias(f) for f in features], *([F.col(label).alias("_label")] if label and name == "_t" else []))
    sides = _blocks(scaled(train, "_u"), "_u", features, 2_000, "q"), _blocks(scaled(train, "_t"), "_t", features, 4_000, "p", *(["_label"] if label else []))
    own = saved(_met(*sides, len(features), None, None).withColumnRenamed("k", "_u"), "own")
    mean = own.filter("d is not null").agg(F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).first()[0]
    index = lambda d: F.round(div(d, F.lit(mean)), 9)
    at = own.filter("pairs > 0").select(index(F.col("d")).alias("di"))
    low, high = quantiles(at, "di", (0.25, 0.75))
    top = at.filter(F.col("di") <= F.lit(high + 1.5 * (high - low))).agg(F.max("di")).first()[0] if high is not None else None
    found = _met(_blocks(scaled(new, key), key, features, 2_000, "q"), sides[1], len(features), mean, top).filter("pairs > 0")
    return found.select(F.col("k").alias(key), index(F.col("d")).alias("di"), F.col("within").alias("lpd"), (F.col("within") > 0).alias("inside"), *([F.col("near._label").alias("near_label")] if label else []))


def _met(left: DataFrame, right: DataFrame, width: int, mean: float | None, top: float | None) -> DataFrame:
    """k, d, s, n, within, pairs, near: for each row of the blocks of ``left`` the least distance to another row of ``right``, the sum and number of all,
    those whose index (by the ``mean``, nine digits) is within ``top``, all other rows, and the nearest (by nine digits, the smallest key of ties).
    """

    def inside(gap: np.ndarray) -> np.ndarray:
        if top is None or mean is None or mean == 0:
            return np.zeros(len(gap), int)
        index = gap / mean
        count = (index < top + 4.9e-10).sum(axis=1)
        # On the edge of rounding the digits decide.
        for i, j in np.argwhere((index >= top + 4.9e-10) & (index <= top + 5.1e-10)):
            count[i] += Decimal(repr(float(index[i, j]))).quantize(Decimal("1e-9"), ROUND_HALF_UP) <= Decimal(repr(float(top)))
        return count

    @F.arrow_udf("array<struct<d: double, s: double, n: bigint, within: bigint, pairs: bigint, near: array<struct<d: double, at: int>>>>")
    def met(xs: pa.Array, ys: pa.Array, x_keys: pa.Array, y_keys: pa.Array) -> pa.Array:
        out = []
        for x, y, a, b in zip(xs, ys, x_keys, y_keys, strict=True):
            a, b, found = a.as_py(), b.as_py(), []
            times = Counter(b)
            for first in range(0, len(a), 256):
                gap = _gaps(x.values, y.values, a, b, width, first, min(len(a), first + 256))
                known = ~np.isnan(gap)
                n, s, within, least = known.sum(axis=1), np.nansum(gap, axis=1), inside(gap), np.where(known, gap, np.inf).min(axis=1)
                for i, d in enumerate(least):
                    some = [j for j in np.flatnonzero(gap[i] <= d + 1e-8)] if n[i] else []
                    firsts = {gap[i, j]: j for j in reversed(some)}  # of equal distances the smallest key
                    near = [{"d": float(g), "at": int(j) + 1} for g, j in firsts.items()]
                    found.append({"d": float(d) if n[i] else None, "s": float(s[i]), "n": int(n[i]), "within": int(within[i]), "pairs": len(b) - times[a[first + i]], "near": near})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("d", pa.float64()), ("s", pa.float64()), ("n", pa.int64()), ("within", pa.int64()), ("pairs", pa.int64()), ("near", pa.list_(pa.struct([("d", pa.float64()), ("at", pa.int32())])))])))

    keys = lambda c: F.transform(c, lambda r: r["k"])
    pairs = _block_pairs(left, right).select("q_k", "p_k", met("q_x", "p_x", keys("q_k"), keys("p_k")).alias("_m"))
    near = lambda m, p: F.array_min(F.transform(m["near"], lambda c: F.struct(F.round(c["d"], 9).alias("d"), F.element_at(p, c["at"]).alias("r"))))
    each = pairs.select(F.explode(F.transform(F.arrays_zip("q_k", "_m"), lambda z: F.struct(z["q_k"]["k"].alias("k"), z["_m"].alias("m"), near(z["_m"], F.col("p_k")).alias("near")))).alias("z")).select("z.k", "z.m", "z.near")
    out = each.groupBy("k").agg(F.min("m.d").alias("d"), F.sum("m.s").alias("s"), F.sum("m.n").alias("n"), F.sum("m.within").alias("within"), F.sum("m.pairs").alias("pairs"), F.min(F.when(F.col("near").isNotNull(), F.col("near"))).alias("near"))
    return out.withColumn("near", F.col("near.r"))


def error_profile(df: DataFrame, di: str, wrong: str, bins: int) -> DataFrame:
    """bin, n, di (mean), error: the share of wrong predictions in bins of equal numbers by dissimilarity."""
    return quantile_bins(df, di, bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(di).alias("di"), F.avg(F.col(wrong).cast("double")).alias("error"))


def perturbations(settings: DataFrame, key: str, most: int = 8, floor: float = 0.8) -> DataFrame:
    """key, spatialr, ranger, minsize: for each setting of the segmentation up to ``most`` neighbours, chosen by a hash of their steps.

    Steps are 1 for spatialr (0 for 3 or less), a tenth of ranger (0.005 at
    least) and a fifth of minsize (5 at least).  Values stay positive and minsize
    over ``floor`` of its own; the setting itself is left out.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if i or j or k])
    rows = settings.withColumn("_s", F.explode(steps)).filter((F.col("spatialr") > 3) | (F.col("_s.i") == 0))
    rows = top_n(rows, most, [key], [F.md5(F.concat_ws(",", "_s.i", "_s.j", "_s.k"))])
    dr, dm = F.greatest(F.lit(0.005), F.col("ranger") * 0.1), F.greatest(F.lit(5), F.round(F.col("minsize") * 0.2)).cast("int")
    least = F.greatest(F.lit(1), F.round(F.col("minsize") * floor).cast("int"))
    return rows.select(
        key, F.greatest(F.lit(1), F.col("_s.i") + F.col("spatialr")).alias("spatialr"), F.round(F.greatest(F.lit(1e-6), F.col("_s.j") * dr + F.col("ranger")), 9).alias("ranger"),
        F.greatest(least, F.col("_s.k") * dm + F.col("minsize")).alias("minsize"),
    )
