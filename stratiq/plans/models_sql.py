"""Statistics that SQL can express: agreement, cluster quality, correlation, neighbours."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from stratiq.functions.numeric import r6
from stratiq.operators import stats
from stratiq.sources.scratch import saved

from .registry import query
from .views import DOMAINS, VEC, twin, v_dist, v_feat, v_grid, v_seg, v_vec, v_whole


@query(twin(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM v_feat" for a, b in combinations(DOMAINS, 2))))
def corr_matrix(spark, sf_dir):
    return stats.corr_matrix(v_feat(spark, sf_dir), DOMAINS).select("a", "b", r6("r").alias("r"))


_C2 = "sum(n * (n - 1) / 2)"


@query(twin(
    f"SELECT round((ij - sa * sb / (n * (n - 1) / 2)) / nullif((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2), 0), 6) AS ari FROM (SELECT {_C2} AS ij, sum(n) AS n FROM c), (SELECT {_C2} AS sa FROM (SELECT cls, sum(n) AS n FROM c GROUP BY cls)), (SELECT {_C2} AS sb FROM (SELECT lab, sum(n) AS n FROM c GROUP BY lab))",
    c="SELECT cls, lab, CAST(count(*) AS DOUBLE) AS n FROM v_grid GROUP BY cls, lab"))
def adjusted_rand_index(spark, sf_dir):
    return stats.adjusted_rand(v_grid(spark, sf_dir), "cls", "lab").select(r6("ari").alias("ari"))


_ARI = f"SELECT k, (ij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) AS ari FROM (SELECT k, {_C2} AS ij, sum(n) AS n FROM c GROUP BY k) JOIN (SELECT k, {_C2} AS sa FROM (SELECT k, a, sum(n) AS n FROM c GROUP BY k, a) GROUP BY k) USING (k) JOIN (SELECT k, {_C2} AS sb FROM (SELECT k, b, sum(n) AS n FROM c GROUP BY k, b) GROUP BY k) USING (k)"


@query(twin(
    "SELECT round(avg(ari), 6) AS ari_prev, round(stddev_samp(ari), 6) AS ari_sd, round(avg(ari) - stddev_samp(ari), 6) AS score FROM r",
    c="SELECT k, CAST(floor(z / 100000) AS BIGINT) AS a, CAST(floor((z + k * 10000) / 100000) AS BIGINT) AS b, CAST(count(*) AS DOUBLE) AS n FROM v_grid, (VALUES (1), (2), (3)) s(k) GROUP BY 1, 2, 3", r=_ARI))
def stability_score(spark, sf_dir):
    from stratiq.operators.models import scale_stability

    g = v_grid(spark, sf_dir).withColumn("cell", F.col("row") * 100 + F.col("col"))
    cut = lambda shift: g.select("cell", F.floor((F.col("z") + shift) / 100000).alias("label"))
    return scale_stability(cut(0), [cut(10000 * k) for k in (1, 2, 3)], "cell", "label").select(*[r6(c).alias(c) for c in ("ari_prev", "ari_sd", "score")])


@query(twin(
    "SELECT CAST(n AS BIGINT) AS n, round(hits / n, 6) AS accuracy, round((hits / n - tf / (n * n)) / nullif(1 - tf / (n * n), 0), 6) AS kappa FROM (SELECT sum(n) AS n, sum(CASE WHEN truth = found THEN n ELSE 0 END) AS hits FROM c), (SELECT sum(t * f) AS tf FROM (SELECT truth AS k, sum(n) AS t FROM c GROUP BY truth) JOIN (SELECT found AS k, sum(n) AS f FROM c GROUP BY found) USING (k))",
    c="SELECT label AS truth, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS found, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY 1, 2"))
def cohen_kappa(spark, sf_dir):
    v = v_vec(spark, sf_dir).withColumn("found", F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return stats.kappa(v, "label", "found").select("n", r6("accuracy").alias("accuracy"), r6("kappa").alias("kappa"))


@query(twin(
    "SELECT fold, CAST(n AS BIGINT) AS n, round(hits / n, 6) AS accuracy, round((hits / n - tf / (n * n)) / (1 - tf / (n * n)), 6) AS kappa, round(avg((hits / n - tf / (n * n)) / (1 - tf / (n * n))) OVER (), 6) AS mean_kappa FROM (SELECT fold, sum(n) AS n, sum(CASE WHEN truth = found THEN n ELSE 0 END) AS hits FROM c GROUP BY fold) JOIN (SELECT fold, sum(t * f) AS tf FROM (SELECT fold, truth AS k, sum(n) AS t FROM c GROUP BY 1, 2) JOIN (SELECT fold, found AS k, sum(n) AS f FROM c GROUP BY 1, 2) USING (fold, k) GROUP BY fold) USING (fold)",
    c="SELECT vec_id % 4 AS fold, label AS truth, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS found, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY 1, 2, 3"))
def kappa_by_fold(spark, sf_dir):
    v = v_vec(spark, sf_dir).withColumn("fold", F.col("vec_id") % 4).withColumn("found", F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return stats.kappa_by(v, "fold", "label", "found").select("fold", "n", *[r6(c).alias(c) for c in ("accuracy", "kappa", "mean_kappa")])


_AVG = ", ".join(f"avg({e}) AS c_{e}" for e in VEC)


@query(twin("SELECT label, " + ", ".join(f"round(avg({e}), 6) AS c_{e}" for e in VEC) + ", count(*) AS size FROM v_vec GROUP BY label"))
def cluster_centroids(spark, sf_dir):
    return stats.centroids(v_vec(spark, sf_dir), "label", VEC).select("label", *[r6(f"c_{e}").alias(f"c_{e}") for e in VEC], "size")


_OWN = "SELECT v.vec_id, v.label, sqrt(" + " + ".join(f"(v.{e} - c.c_{e}) ** 2" for e in VEC) + ") AS d FROM v_vec v JOIN c ON v.label = c.label"


@query(twin("SELECT vec_id, label, round(d, 6) AS dist_to_center FROM o", c=f"SELECT label, {_AVG} FROM v_vec GROUP BY label", o=_OWN))
def distance_to_centroid(spark, sf_dir):
    return stats.to_centroid(v_vec(spark, sf_dir), "label", VEC).select("vec_id", "label", r6("dist_to_center").alias("dist_to_center"))


@query(twin(
    "SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS ch FROM (SELECT (SELECT sum(" + " + ".join(f"(c_{e} - (SELECT avg({e}) FROM v_vec)) ** 2" for e in VEC) + ") FROM (SELECT v.vec_id, c.* FROM v_vec v JOIN c ON v.label = c.label)) AS b, (SELECT sum(d * d) FROM o) AS w, (SELECT CAST(count(*) AS DOUBLE) FROM v_vec) AS n, (SELECT CAST(count(DISTINCT label) AS DOUBLE) FROM v_vec) AS k)",
    c=f"SELECT label, {_AVG} FROM v_vec GROUP BY label", o=_OWN))
def calinski_harabasz(spark, sf_dir):
    return stats.calinski_harabasz(v_vec(spark, sf_dir), "label", VEC).select(F.round("ch", 4).alias("ch"))


@query(twin(
    "SELECT round(avg(r), 6) AS db FROM (SELECT a.label, max((a.s + b.s) / sqrt(" + " + ".join(f"(a.c_{e} - b.c_{e}) ** 2" for e in VEC) + ")) AS r FROM p a JOIN p b ON a.label <> b.label GROUP BY a.label)",
    c=f"SELECT label, {_AVG} FROM v_vec GROUP BY label", o=_OWN, p="SELECT c.*, s.s FROM c JOIN (SELECT label, avg(d) AS s FROM o GROUP BY label) s ON c.label = s.label"))
def davies_bouldin(spark, sf_dir):
    return stats.davies_bouldin(v_vec(spark, sf_dir), "label", VEC).select(r6("db").alias("db"))


_GAP = "sqrt(" + " + ".join(f"(x.{e} - y.{e}) ** 2" for e in VEC) + ")"


@query(twin(
    "SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / nullif(greatest(a, b), 0) END), 6) AS silhouette FROM (SELECT vec_id, max(CASE WHEN xl = yl THEN d END) AS a, min(CASE WHEN xl <> yl THEN d END) AS b FROM (SELECT x.vec_id, x.label AS xl, y.label AS yl, avg(" + _GAP + ") AS d FROM v_vec x JOIN v_vec y ON x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0 GROUP BY x.vec_id, x.label, y.label) GROUP BY vec_id)"))
def silhouette_score(spark, sf_dir):
    """Every twentieth row, the stated query set, among all rows."""
    return stats.silhouette(v_vec(spark, sf_dir), "vec_id", "label", VEC, F.col("vec_id") % 20 == 0).select(r6("silhouette").alias("silhouette"))


@query(twin("SELECT cls, round(max(n / (a + b - n)), 6) AS jaccard FROM (SELECT *, sum(n) OVER (PARTITION BY cls) AS a, sum(n) OVER (PARTITION BY lab) AS b FROM (SELECT cls, lab, CAST(count(*) AS DOUBLE) AS n FROM v_grid GROUP BY cls, lab)) GROUP BY cls"))
def cluster_jaccard(spark, sf_dir):
    return stats.cluster_jaccard(v_grid(spark, sf_dir), "cls", "lab").select("cls", r6("jaccard").alias("jaccard"))


@query(twin(
    "SELECT segment_id, round(sqrt(zx * zx + zy * zy), 6) AS origin_dist, round((1 + abs(r)) / 2, 6) AS explained FROM (SELECT segment_id, (price - (SELECT avg(price) FROM v_feat)) / (SELECT stddev_samp(price) FROM v_feat) AS zx, (w - (SELECT avg(w) FROM v_feat)) / (SELECT stddev_samp(w) FROM v_feat) AS zy, (SELECT corr(price, w) FROM v_feat) AS r FROM v_feat)"
))
def pca_two_var(spark, sf_dir):
    return stats.pca_two(v_feat(spark, sf_dir), "price", "w").select("segment_id", r6("origin_dist").alias("origin_dist"), r6("explained").alias("explained"))


@query("SELECT CAST(k AS BIGINT) AS k FROM (SELECT n_regionkey * 3 + 4 AS k, count(*) AS n FROM nation GROUP BY 1) WHERE k BETWEEN 4 AND 25 ORDER BY n DESC, k LIMIT 1")
def vote_k(spark, sf_dir):
    from .views import table

    return stats.vote(table(spark, sf_dir, "nation").select((F.col("n_regionkey") * 3 + 4).alias("k")), "k", 4, 25)


_NZV = "SELECT '{c}' AS \"column\", (SELECT max(n) FROM c_{c}) AS n1, (SELECT count(*) FROM c_{c}) AS d, (SELECT sum(n) FROM c_{c}) AS t, (SELECT count(*) FROM c_{c} WHERE n = (SELECT max(n) FROM c_{c})) AS tops, (SELECT max(n) FROM c_{c} WHERE n < (SELECT max(n) FROM c_{c})) AS n2"


@query(twin(
    'SELECT "column", round(fr, 6) AS freq_ratio, round(pu, 6) AS pct_unique, (fr > 19 AND pu <= 10) OR d <= 1 AS nzv FROM (SELECT *, CASE WHEN tops > 1 THEN 1e0 WHEN n2 IS NULL THEN 0e0 ELSE n1 / CAST(n2 AS DOUBLE) END AS fr, 100e0 * d / CAST(t AS DOUBLE) AS pu FROM (' + " UNION ALL ".join(_NZV.format(c=c) for c in ("stratum", "size", "flat")) + "))",
    c_stratum="SELECT stratum, count(*) AS n FROM v_seg GROUP BY 1", c_size="SELECT size, count(*) AS n FROM v_seg GROUP BY 1", c_flat="SELECT segment_id % 100 = 0 AS flat, count(*) AS n FROM v_seg GROUP BY 1"))
def near_zero_variance(spark, sf_dir):
    rows = v_seg(spark, sf_dir).withColumn("flat", F.col("segment_id") % 100 == 0)
    return stats.near_zero_variance(rows, ["stratum", "size", "flat"]).select("column", r6("freq_ratio").alias("freq_ratio"), r6("pct_unique").alias("pct_unique"), "nzv")


@query(twin(
    "SELECT vec_id, round(d, 6) AS knn FROM (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r FROM (SELECT x.vec_id, y.vec_id AS other, nullif(list_distance(x.e, y.e), CAST('nan' AS DOUBLE)) AS d FROM (SELECT * FROM v_whole WHERE vec_id % 20 = 0) x JOIN v_whole y ON x.vec_id <> y.vec_id)) WHERE r = 10"))
def knn_distance(spark, sf_dir):
    """By all components of the vectors; every twentieth row is the stated query set."""
    v, names = v_whole(spark, sf_dir)
    return stats.knn_distance(v.filter("vec_id % 20 = 0"), v, "vec_id", names, 10).select("vec_id", r6("knn").alias("knn"))


@query(twin("SELECT x.vec_id, round(min(" + _GAP + ") / (SELECT avg(" + _GAP + ") FROM t x JOIN t y ON x.vec_id < y.vec_id), 6) AS di FROM v_vec x JOIN t y ON x.vec_id <> y.vec_id GROUP BY x.vec_id", t="SELECT * FROM v_vec WHERE vec_id % 20 = 0"))
def dissimilarity_index(spark, sf_dir):
    v = v_vec(spark, sf_dir)
    return stats.dissimilarity(v, v.filter("vec_id % 20 = 0"), "vec_id", VEC).select("vec_id", r6("di").alias("di"))


@query(twin("SELECT CAST(k AS INTEGER) AS scale_id, round(quantile, 6) AS radius FROM (SELECT 1 AS k, quantile_cont(sqrt(area / pi()), 0.1) AS quantile FROM v_seg UNION ALL SELECT 2, quantile_cont(sqrt(area / pi()), 0.5) FROM v_seg UNION ALL SELECT 3, quantile_cont(sqrt(area / pi()), 0.9) FROM v_seg)"))
def patch_scale_table(spark, sf_dir):
    return stats.patch_scales(v_seg(spark, sf_dir), "area", (0.1, 0.5, 0.9)).select("scale_id", r6("radius").alias("radius"))


def _greedy(names, cutoff):
    """SQL of the rule itself: column i stays if it correlates beyond the cutoff with no column that stays before it."""
    kept = {}
    for i, c in enumerate(names):
        kept[c] = " AND ".join(["TRUE", *[f"NOT (keep_{b} AND abs(coalesce(corr_{b}_{c}, 0)) > {cutoff})" for b in names[:i]]])
    steps = "SELECT " + ", ".join(f"corr({a}, {b}) AS corr_{a}_{b}" for a, b in combinations(names, 2)) + " FROM v_dist"
    for c in names:
        steps = f"SELECT *, {kept[c]} AS keep_{c} FROM ({steps})"
    return " UNION ALL ".join(f"SELECT '{c}' AS name FROM k WHERE keep_{c}" for c in names), steps


_PRUNED, _KEPT = _greedy([f"d_{c}" for c in DOMAINS], 0.3)


@query(twin(_PRUNED, k=_KEPT))
def drop_correlated(spark, sf_dir):
    names = [f"d_{c}" for c in DOMAINS]
    kept = stats.drop_correlated(v_dist(spark, sf_dir), names, 0.3)
    return spark.createDataFrame([(k,) for k in kept], "name string")


@query(twin("SELECT p AS prob, round(CASE p WHEN 0.1 THEN q[1] WHEN 0.5 THEN q[2] ELSE q[3] END, 6) AS bandwidth FROM (VALUES (0.1e0), (0.5e0), (0.9e0)) t(p), (SELECT quantile_cont(d, [0.1, 0.5, 0.9]) AS q FROM (SELECT x.vec_id, " + _GAP + " AS d, row_number() OVER (PARTITION BY x.vec_id ORDER BY " + _GAP + ", y.vec_id) AS r FROM (SELECT * FROM v_vec WHERE vec_id % 20 = 0) x JOIN v_vec y ON x.vec_id <> y.vec_id) WHERE r = 10)"))
def knn_bandwidth(spark, sf_dir):
    """Feature-space bandwidths: quantiles of 10-nearest-neighbour distances of every twentieth row."""
    v = v_vec(spark, sf_dir)
    return stats.knn_bandwidths(v.filter("vec_id % 20 = 0"), v, "vec_id", VEC, 10, (0.1, 0.5, 0.9)).select("prob", r6("bandwidth").alias("bandwidth"))


def _explained(name: str, one: str, two: str) -> str:
    """The share of a column's variance that two others explain, from the three correlations."""
    a, b, c = f"corr({name}, {one})", f"corr({name}, {two})", f"corr({one}, {two})"
    return f"SELECT '{name}' AS name, ({a} * {a} + {b} * {b} - 2 * {a} * {b} * {c}) / (1 - {c} * {c}) AS share FROM lc"


@query(twin(
    "SELECT name FROM (" + " UNION ALL ".join([*(_explained(*t) for t in (("tax", "price", "disc"), ("w", "price", "tax"), ("ord", "price", "w"), ("total", "price", "w"))), "SELECT 'disc', corr(disc, price) ** 2 FROM lc", "SELECT 'flat', CASE WHEN var_samp(flat) = 0 THEN 1 ELSE 0 END FROM lc"]) + ") WHERE share > 1 - 1e-7",
    lc="SELECT *, price + 2 * w AS total, 3e0 AS flat FROM v_feat",
))
def linear_combinations(spark, sf_dir):
    """Of the domains, their sum and a constant, the columns that others make up."""
    rows = v_feat(spark, sf_dir).withColumn("total", F.col("price") + 2 * F.col("w")).withColumn("flat", F.lit(3.0))
    found = stats.linear_combinations(rows, [*DOMAINS, "total", "flat"])
    return spark.createDataFrame([(c,) for c in found], "name string")


_AOA = {
    "t": "SELECT * FROM v_vec WHERE vec_id % 20 = 0",
    "m": f"SELECT avg({_GAP}) AS m FROM t x JOIN t y ON x.vec_id <> y.vec_id",
    "u": f"SELECT x.vec_id, round(min({_GAP}) / any_value(m), 9) AS di FROM t x JOIN t y ON x.vec_id <> y.vec_id, m GROUP BY x.vec_id",
    "h": "SELECT max(di) AS h FROM u, (SELECT quantile_cont(di, 0.25) AS a, quantile_cont(di, 0.75) AS b FROM u) WHERE di <= b + 1.5e0 * (b - a)",
    "p": f"SELECT x.vec_id, x.label, y.label AS other, y.vec_id AS t, {_GAP} AS d FROM v_vec x JOIN t y ON x.vec_id <> y.vec_id",
    "o": "SELECT vec_id, round(min(d) / any_value(m), 9) AS di, count(*) FILTER (round(d / m, 9) <= h) AS lpd, any_value(label) <> arg_min(other, {'d': round(d, 9), 't': t}) AS wrong FROM p, m, h GROUP BY vec_id",
}


def _applied(spark, sf_dir):
    v = v_vec(spark, sf_dir)
    return stats.applicability(v, v.filter("vec_id % 20 = 0"), "vec_id", VEC, label="label").join(v.select("vec_id", "label"), "vec_id")


@query(twin("SELECT vec_id, round(di, 6) AS di, lpd, lpd > 0 AS inside FROM o", **_AOA))
def area_of_applicability(spark, sf_dir):
    """Dissimilarity, local density of training rows, and whether a row is inside: every twentieth row is the training set."""
    return _applied(spark, sf_dir).select("vec_id", r6("di").alias("di"), "lpd", "inside")


@query(twin(
    "SELECT bin, count(*) AS n, round(avg(di), 6) AS di, round(avg(CASE WHEN wrong THEN 1e0 ELSE 0e0 END), 6) AS error FROM "
    "(SELECT *, CAST(greatest(1, len(list_filter(cuts, lambda c: c < di))) AS INTEGER) AS bin FROM o, (SELECT list_sort(list_distinct(quantile_cont(di, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS cuts FROM o)) GROUP BY bin", **_AOA))  # fmt: skip
def error_profiles(spark, sf_dir):
    """Errors of the nearest training row's label, by dissimilarity."""
    rows = saved(_applied(spark, sf_dir), "applied").withColumn("wrong", F.col("label") != F.col("near_label"))
    return stats.error_profile(rows, "di", "wrong", 5).select("bin", "n", r6("di").alias("di"), r6("error").alias("error"))


_SETTINGS = "SELECT n_nationkey AS scale_id, 2 + n_nationkey % 5 AS spatialr, (2 + n_nationkey % 4 * 3) / 100e0 AS ranger, 10 + 7 * n_nationkey AS minsize FROM nation"


@query(
    f"SELECT scale_id, spatialr + i AS spatialr, round(ranger + greatest(0.005e0, ranger * 0.1e0) * j, 9) AS ranger, CAST(greatest(round(minsize * 0.8e0), minsize + greatest(5, round(minsize * 0.2e0)) * k) AS INTEGER) AS minsize FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY scale_id ORDER BY md5(i || ',' || j || ',' || k)) AS r FROM ({_SETTINGS}), (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j), (VALUES (-1), (0), (1)) c(k) WHERE NOT (i = 0 AND j = 0 AND k = 0) AND (i = 0 OR spatialr > 3)) WHERE r <= 8")  # fmt: skip
def param_perturbations(spark, sf_dir):
    """Neighbours of a table of settings, one for each scale."""
    from .views import table

    k = F.col("n_nationkey")
    settings = table(spark, sf_dir, "nation").select(k.alias("scale_id"), (k % 5 + 2).alias("spatialr"), ((k % 4 * 3 + 2) / 100).alias("ranger"), (k * 7 + 10).alias("minsize"))
    return stats.perturbations(settings, "scale_id")


@query(twin("SELECT segment_id, round(sqrt(((price - mp) / sp) ** 2 + ((w - mw) / sw) ** 2), 6) AS origin_dist FROM v_feat, (SELECT avg(price) AS mp, stddev_samp(price) AS sp, avg(w) AS mw, stddev_samp(w) AS sw FROM v_feat) ORDER BY round(sqrt(((price - mp) / sp) ** 2 + ((w - mw) / sw) ** 2), 9), segment_id LIMIT 100"))
def it_pca_global(spark, sf_dir):
    """The hundred segments nearest to the origin of the components, without strata: with all components that is the origin of the z-scores."""
    from stratiq.operators.models import pca_scores

    scores = pca_scores(v_feat(spark, sf_dir), ["price", "w"], 2).select("segment_id", r6("origin_dist").alias("origin_dist"), F.round("origin_dist", 9).alias("_d"))
    return scores.orderBy("_d", "segment_id").limit(100).drop("_d")
