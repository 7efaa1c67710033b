"""Zonal statistics, composition and information measures; ranks and bins over segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiq.functions.numeric import cases, r6, row_argmax
from stratiq.operators import raster, relational as R, signatures as S

from .registry import query
from .views import DOMAINS, table, twin, whole, v_cell, v_dist, v_feat, v_grid, v_seg, v_site

BANDS = ("price", "disc", "tax")
#: Bands in whole hundredths, so that means and quantiles are exact and need no rounding.
_STATS = ", ".join(
    f"avg({b}) / 100 AS {b}__mean, round(stddev_pop({b}) / 100, 6) AS {b}__sd, min({b}) / 100 AS {b}__min, max({b}) / 100 AS {b}__max, round(stddev_pop({b}) / nullif(avg({b}), 0), 6) AS {b}__cv, "
    + ", ".join(f"quantile_cont({b}, {q}) / 100 AS {b}__q{round(100 * q):02d}" for q in (0.25, 0.5, 0.75))
    for b in BANDS
)


def _rounded(df, *keys):
    return df.select(*keys, *[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


@query(twin(f"SELECT segment_id, {_STATS} FROM (SELECT segment_id, {', '.join(f'round({b} * 100) AS {b}' for b in BANDS)} FROM v_cell) GROUP BY segment_id"))
def zonal_stats(spark, sf_dir):
    cells = v_cell(spark, sf_dir).select("segment_id", *[whole(b).alias(b) for b in BANDS])
    out = S.zonal(cells, "segment_id", BANDS)
    shown = {"sd": lambda c: r6(c / 100), "cv": r6}
    return out.select("segment_id", *[shown.get(c.split("__")[1], lambda c: c / 100)(F.col(c)).alias(c) for c in out.columns if c != "segment_id"])


@query(twin("SELECT segment_id, round(sum(w * price) / sum(w), 6) AS price__mean, round(sqrt(greatest(sum(w * price * price) / sum(w) - (sum(w * price) / sum(w)) * (sum(w * price) / sum(w)), 0e0)), 2) AS price__sd FROM v_cell GROUP BY segment_id"))
def zonal_weighted_mean(spark, sf_dir):
    out = S.zonal_weighted(v_cell(spark, sf_dir), "segment_id", ["price"], "w")
    return out.select("segment_id", r6("price__mean").alias("price__mean"), F.round("price__sd", 2).alias("price__sd"))


@query(twin("SELECT segment_id, min(price) AS price__wq50 FROM (SELECT segment_id, price, sum(n) OVER (PARTITION BY segment_id ORDER BY price) AS c, sum(n) OVER (PARTITION BY segment_id) AS t FROM (SELECT segment_id, price, round(w * 50) AS n FROM v_cell)) WHERE c >= 0.5 * t GROUP BY segment_id"))
def zonal_weighted_quantile(spark, sf_dir):
    return S.weighted_quantile(v_cell(spark, sf_dir).withColumn("n", F.round(F.col("w") * 50)), "segment_id", "price", "n", 0.5)


@query(twin("SELECT segment_id, price, disc, tax, w, ord FROM v_feat"))
def zonal_mean(spark, sf_dir):
    return v_feat(spark, sf_dir)


_MODE = "SELECT segment_id, cls AS mode, round(n / t, 6) AS mode_share FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY n DESC, cls) AS r, sum(n) OVER (PARTITION BY segment_id) AS t FROM (SELECT segment_id, cls, sum(round(w * 50)) AS n FROM v_cell GROUP BY segment_id, cls)) WHERE r = 1"


@query(twin(_MODE))
def mode_share(spark, sf_dir):
    return _rounded(S.mode_share(v_cell(spark, sf_dir).withColumn("n", F.round(F.col("w") * 50)), "segment_id", "cls", "n"), "segment_id")


@query(twin("SELECT m.segment_id, m.mode, m.mode_share, x.top FROM m JOIN (SELECT segment_id, max(ord) AS top FROM v_cell GROUP BY segment_id) x ON m.segment_id = x.segment_id", m=_MODE.replace("cls", "ord")))
def ordinal_mode_max(spark, sf_dir):
    c = v_cell(spark, sf_dir).withColumn("n", F.round(F.col("w") * 50))
    top = c.groupBy("segment_id").agg(F.max("ord").alias("top"))
    return _rounded(S.mode_share(c, "segment_id", "ord", "n").join(top, "segment_id"), "segment_id")


@query(twin(
    "SELECT a.segment_id, a.mode, a.mode_share, b.positive, b.p90 FROM (" + _MODE.replace("sum(round(w * 50))", "CAST(count(*) AS DOUBLE)") + ") a JOIN "
    "(SELECT segment_id, round(avg(CASE WHEN disc > 0 THEN 1e0 ELSE 0e0 END), 6) AS positive, round(quantile_cont(price, 0.9), 6) AS p90 FROM v_cell GROUP BY segment_id) b ON a.segment_id = b.segment_id"
))
def majority_fraction(spark, sf_dir):
    c = v_cell(spark, sf_dir).withColumn("one", F.lit(1.0))
    more = c.groupBy("segment_id").agg(F.avg(F.when(F.col("disc") > 0, 1.0).otherwise(0.0)).alias("positive"), F.percentile("price", F.lit(0.9)).alias("p90"))
    return _rounded(S.mode_share(c, "segment_id", "cls", "one").join(more, "segment_id"), "segment_id")


@query(twin("SELECT segment_id, " + ", ".join(f"round(sum(CASE WHEN cls = '{c}' THEN w ELSE 0 END) / sum(w), 6) AS frac_{c}" for c in "ANR") + " FROM v_cell GROUP BY segment_id"))
def class_fractions_pivot(spark, sf_dir):
    return _rounded(S.composition_wide(v_cell(spark, sf_dir), "segment_id", "cls", "w", ["A", "N", "R"]), "segment_id")


_SHARE = "SELECT segment_id, {c}, sum(w) / sum(sum(w)) OVER (PARTITION BY segment_id) AS share FROM v_cell GROUP BY segment_id, {c}"


@query(twin("SELECT segment_id, cls, sum(n) / sum(sum(n)) OVER (PARTITION BY segment_id) AS share FROM (SELECT segment_id, cls, round(w * 50) AS n FROM v_cell) GROUP BY segment_id, cls"))
def class_shares_long(spark, sf_dir):
    """Weights in whole fiftieths: a share is one division of exact sums."""
    return S.composition(v_cell(spark, sf_dir).withColumn("n", whole("w", 50)), "segment_id", "cls", "n")


_CLASS = "CASE WHEN ord IN (1, 2) THEN 'a' WHEN ord IN (3, 4) THEN 'b' WHEN ord = 5 THEN 'c' END"
_DOMINANT = (
    "SELECT segment_id, class, purity, n_classes FROM (SELECT *, count(*) OVER (PARTITION BY segment_id) AS n_classes, row_number() OVER (PARTITION BY segment_id ORDER BY round(purity, 9) DESC, class) AS r FROM "
    f"(SELECT segment_id, class, sum(share) AS purity FROM (SELECT segment_id, {_CLASS} AS class, share FROM s) WHERE class IS NOT NULL GROUP BY segment_id, class)) WHERE r = 1"
)


def _dominant(spark, sf_dir):
    o = F.col("ord")
    mapping = cases(o, [(o.isin(1, 2), "a"), (o.isin(3, 4), "b"), (o == 5, "c")])
    return S.dominant_class(v_cell(spark, sf_dir), "segment_id", "ord", "w", mapping)


@query(twin("SELECT segment_id, class, round(purity, 6) AS purity, n_classes FROM d", s=_SHARE.format(c="ord"), d=_DOMINANT))
def dominant_class_purity(spark, sf_dir):
    return _rounded(_dominant(spark, sf_dir), "segment_id")


@query(twin("SELECT d.segment_id, d.class FROM d JOIN v_seg s ON d.segment_id = s.segment_id, (SELECT quantile_cont(area, 0.05) AS cut FROM v_seg) q WHERE area >= cut AND round(purity, 9) >= 0.66e0", s=_SHARE.format(c="ord"), d=_DOMINANT))
def purity_gate(spark, sf_dir):
    seg = v_seg(spark, sf_dir)
    seg = seg.filter(F.col("area") >= R.quantiles(seg, "area", [0.05])[0])
    return _dominant(spark, sf_dir).filter(F.round("purity", 9) >= 0.66).join(seg.select("segment_id"), "segment_id").select("segment_id", "class")


_ENTROPY = 'SELECT segment_id, -sum(share * ln(share)) AS "H", count(*) AS "K" FROM s WHERE share > 0 GROUP BY segment_id'


@query(twin('SELECT segment_id, round("H", 6) + 0e0 AS "H", "K", round(CASE WHEN "K" >= 2 THEN "H" / ln("K") END, 6) AS "H_norm" FROM h', s=_SHARE.format(c="cls"), h=_ENTROPY))
def shannon_entropy(spark, sf_dir):
    out = S.entropy(v_cell(spark, sf_dir), "segment_id", "cls", "w")
    return out.select("segment_id", (r6("H") + 0.0).alias("H"), "K", r6("H_norm").alias("H_norm"))


_TILED = "SELECT row, col, cls, lab, z, CAST(floor(row / 10e0) * 10 + floor(col / 10e0) AS BIGINT) AS tile FROM v_grid"
_PAIRS = "SELECT a.tile, a.cls AS a, b.cls AS b FROM t a JOIN t b ON (a.row = b.row AND a.col + 1 = b.col) OR (a.row + 1 = b.row AND a.col = b.col) WHERE a.tile = b.tile"
_PAIRS = "SELECT a.tile, a.cls AS a, b.cls AS b FROM t a JOIN t b ON a.row = b.row AND a.col + 1 = b.col AND a.tile = b.tile UNION ALL SELECT a.tile, a.cls, b.cls FROM t a JOIN t b ON a.row + 1 = b.row AND a.col = b.col AND a.tile = b.tile"
_MI = 'SELECT tile, sum(n / t * ln(n * t / (pa * pb))) AS "I" FROM (SELECT *, sum(n) OVER (PARTITION BY tile) AS t, sum(n) OVER (PARTITION BY tile, a) AS pa, sum(n) OVER (PARTITION BY tile, b) AS pb FROM (SELECT tile, a, b, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY tile, a, b)) GROUP BY tile'


def _tiled(spark, sf_dir):
    return v_grid(spark, sf_dir).withColumn("tile", (F.floor(F.col("row") / 10) * 10 + F.floor(F.col("col") / 10)).cast("bigint"))


def _pairs(spark, sf_dir):
    return S.adjacency(_tiled(spark, sf_dir), "row", "col", ["cls", "tile"]).filter("a_tile = b_tile").select(F.col("a_tile").alias("tile"), F.col("a_cls").alias("a"), F.col("b_cls").alias("b"))


@query(twin('SELECT tile, round("I", 6) AS "I" FROM i', t=_TILED, p=_PAIRS, i=_MI))
def mutual_information(spark, sf_dir):
    return _rounded(S.mutual_information(_pairs(spark, sf_dir), ["tile"], "a", "b"), "tile")


_H_TILE = 'SELECT tile, -sum(q * ln(q)) AS "H" FROM (SELECT tile, count(*) / sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY tile) AS q FROM t GROUP BY tile, cls) GROUP BY tile'


@query(twin('SELECT h.tile, round(h."H", 6) AS "H", round(i."I", 6) AS "I", round(CASE WHEN i."I" IS NULL THEN NULL WHEN h."H" > 0 THEN i."I" / h."H" ELSE 0e0 END, 6) AS "U" FROM h LEFT JOIN i ON h.tile = i.tile', t=_TILED, p=_PAIRS, i=_MI, h=_H_TILE))
def relative_mutual_information(spark, sf_dir):
    h = S.entropy(_tiled(spark, sf_dir).withColumn("one", F.lit(1.0)), "tile", "cls", "one").select("tile", "H")
    return _rounded(S.relative_information(h, S.mutual_information(_pairs(spark, sf_dir), ["tile"], "a", "b"), "tile"), "tile")


@query(twin("SELECT a, b FROM p", t=_TILED, p=_PAIRS))
def union_all_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b")


_COVE = "SELECT tile, least(a, b) AS low, greatest(a, b) AS high, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY tile) AS p FROM p GROUP BY tile, least(a, b), greatest(a, b)"


@query(twin("SELECT tile, low, high, round(p, 6) AS p FROM c", t=_TILED, p=_PAIRS, c=_COVE))
def cove_signature(spark, sf_dir):
    return _rounded(S.cove(_pairs(spark, sf_dir), "tile", "a", "b"), "tile", "low", "high")


@query(twin(
    "SELECT q.tile AS a, t.tile AS b, round(ln(2e0) + coalesce(s, 0e0), 6) AS js FROM (SELECT DISTINCT tile FROM c WHERE tile % 20 = 0) q JOIN (SELECT DISTINCT tile FROM c) t ON q.tile <> t.tile LEFT JOIN "
    "(SELECT x.tile AS a, y.tile AS b, sum(0.5e0 * (x.p * ln(x.p / (x.p + y.p)) + y.p * ln(y.p / (x.p + y.p)))) AS s FROM c x JOIN c y ON x.low = y.low AND x.high = y.high AND x.tile <> y.tile WHERE x.tile % 20 = 0 GROUP BY x.tile, y.tile) k ON q.tile = k.a AND t.tile = k.b",
    t=_TILED, p=_PAIRS, c=_COVE))
def jensen_shannon_pairs(spark, sf_dir):
    """Every twentieth tile, the stated query set, against all tiles."""
    c = S.cove(_pairs(spark, sf_dir), "tile", "a", "b")
    return S.jensen_shannon(c.filter("tile % 20 = 0"), c, "tile", ["low", "high"], "p", digits=6)


@query(twin("SELECT segment_id, stratum, d FROM (SELECT segment_id, stratum, d_price AS d, row_number() OVER (PARTITION BY stratum ORDER BY d_price, segment_id) AS r FROM v_site WHERE d_price IS NOT NULL) WHERE r <= 5"))
def topn_per_stratum(spark, sf_dir):
    rows = v_site(spark, sf_dir).filter("d_price is not null").select("segment_id", "stratum", F.col("d_price").alias("d"))
    return R.top_n(rows, 5, ["stratum"], [F.col("d"), F.col("segment_id")])


@query(twin("SELECT segment_id, d_price FROM v_dist ORDER BY d_price, segment_id LIMIT 100"))
def topn_global(spark, sf_dir):
    return v_dist(spark, sf_dir).select("segment_id", "d_price").orderBy("d_price", "segment_id").limit(100)


@query(twin("SELECT stratum, segment_id FROM (SELECT stratum, segment_id, row_number() OVER (PARTITION BY stratum ORDER BY area DESC, segment_id) AS r FROM v_seg) WHERE r = 1"))
def argmax_row(spark, sf_dir):
    return v_seg(spark, sf_dir).groupBy("stratum").agg(F.max_by("segment_id", F.struct("area", -F.col("segment_id"))).alias("segment_id"))


@query(twin("SELECT segment_id, CASE WHEN d_price = g THEN 'd_price' WHEN d_disc = g THEN 'd_disc' WHEN d_tax = g THEN 'd_tax' WHEN d_w = g THEN 'd_w' WHEN d_ord = g THEN 'd_ord' END AS top, g AS value FROM (SELECT *, greatest(d_price, d_disc, d_tax, d_w, d_ord) AS g FROM v_dist)"))
def rowwise_argmax(spark, sf_dir):
    names = [f"d_{c}" for c in DOMAINS]
    return v_dist(spark, sf_dir).select("segment_id", row_argmax(names).alias("top"), F.greatest(*names).alias("value"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS id FROM customer WHERE c_acctbal > 0")
def row_ids(spark, sf_dir):
    return R.row_ids(table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey"), "c_custkey")


@query(twin("SELECT segment_id, stratum, CAST(ntile(4) OVER (PARTITION BY stratum ORDER BY area, segment_id) AS INTEGER) AS tile FROM v_seg"))
def ntile_bins(spark, sf_dir):
    from pyspark.sql import Window

    return v_seg(spark, sf_dir).select("segment_id", "stratum", F.ntile(4).over(Window.partitionBy("stratum").orderBy("area", "segment_id")).alias("tile"))


@query(twin(
    "SELECT segment_id, CAST(greatest(1, len(list_filter(cuts, lambda c: c < area))) AS INTEGER) AS bin FROM v_seg, (SELECT list_sort(list_distinct(quantile_cont(area, [0, 0.111111111111111, 0.222222222222222, 0.333333333333333, 0.444444444444444, 0.555555555555556, 0.666666666666667, 0.777777777777778, 0.888888888888889, 1]))) AS cuts FROM v_seg)"
))
def quantile_bins(spark, sf_dir):
    rows = v_seg(spark, sf_dir).select("segment_id", "area")
    return R.quantile_bins(rows, "area", 9).select("segment_id", "bin")


@query(twin(
    "SELECT segment_id, CASE WHEN area <= a[1] THEN 1 WHEN area <= a[2] THEN 2 ELSE 3 END AS elev_bin, CASE WHEN size <= b[1] THEN 1 WHEN size <= b[2] THEN 2 ELSE 3 END AS slope_bin, "
    "'physio_elev-' || CASE WHEN area <= a[1] THEN 1 WHEN area <= a[2] THEN 2 ELSE 3 END || '_slope-' || CASE WHEN size <= b[1] THEN 1 WHEN size <= b[2] THEN 2 ELSE 3 END AS label FROM v_seg, "
    "(SELECT quantile_cont(area, [0.3333333333333333, 0.6666666666666666]) AS a, quantile_cont(size, [0.3333333333333333, 0.6666666666666666]) AS b FROM v_seg)"
))
def tertile_tokens(spark, sf_dir):
    return R.tertile_tokens(v_seg(spark, sf_dir), {"area": "elev", "size": "slope"}, "physio").select("segment_id", "elev_bin", "slope_bin", "label")


@query(twin("SELECT segment_id, round((price - m) / s, 6) AS price_z FROM v_feat, (SELECT avg(price) AS m, stddev_samp(price) AS s FROM v_feat)"))
def zscore(spark, sf_dir):
    return R.zscores(v_feat(spark, sf_dir).select("segment_id", "price"), ["price"]).select("segment_id", r6("price_z").alias("price_z"))


@query(twin("SELECT segment_id, round((d_price - lo) / nullif(hi - lo, 0), 6) AS d_price_n, CAST(NULL AS DOUBLE) AS flat_n FROM v_dist, (SELECT min(d_price) AS lo, max(d_price) AS hi FROM v_dist)"))
def minmax_norm(spark, sf_dir):
    rows = v_dist(spark, sf_dir).select("segment_id", "d_price", F.lit(3.0).alias("flat"))
    return R.unit_range(rows, ["d_price", "flat"]).select("segment_id", r6("d_price_n").alias("d_price_n"), r6("flat_n").alias("flat_n"))


@query(twin("SELECT row, col, round(lead(z, 2) OVER w - 2 * lead(z, 1) OVER w + z, 4) AS second_difference FROM v_grid WINDOW w AS (PARTITION BY row ORDER BY col)"))
def second_difference(spark, sf_dir):
    return raster.second_difference(v_grid(spark, sf_dir), ["row"], "col", "z").select("row", "col", F.round("second_difference", 4).alias("second_difference"))


_SMOOTH = (
    "SELECT row, col, list_sort(list_slice(near, pos - greatest(1, pos - 2) - least(2, pos - 1, n - pos) + 1, pos - greatest(1, pos - 2) + least(2, pos - 1, n - pos) + 1))[least(2, pos - 1, n - pos) + 1] AS y FROM "
    "(SELECT row, col, list(z) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, row_number() OVER (PARTITION BY row ORDER BY col) AS pos, count(*) OVER (PARTITION BY row) AS n FROM v_grid)"
)


@query(twin("SELECT row, col, round(CASE WHEN lag(y, 1) OVER w IS NULL AND n > 2 THEN list_sort([y, lead(y, 1) OVER w, 3 * lead(y, 1) OVER w - 2 * lead(y, 2) OVER w])[2] WHEN lead(y, 1) OVER w IS NULL AND n > 2 THEN list_sort([y, lag(y, 1) OVER w, 3 * lag(y, 1) OVER w - 2 * lag(y, 2) OVER w])[2] ELSE y END, 6) AS running_median FROM (SELECT *, count(*) OVER (PARTITION BY row) AS n FROM y) WINDOW w AS (PARTITION BY row ORDER BY col)", y=_SMOOTH))
def running_median(spark, sf_dir):
    return raster.running_median(v_grid(spark, sf_dir), ["row"], "col", "z", 2).select("row", "col", r6("running_median").alias("running_median"))


@query(twin("SELECT s.stratum, s.segment_id, round(d, 6) AS dist_to_center FROM (SELECT f.segment_id, s.stratum, sqrt((z1 - avg(z1) OVER (PARTITION BY s.stratum)) ** 2 + (z2 - avg(z2) OVER (PARTITION BY s.stratum)) ** 2) AS d FROM f JOIN v_seg s ON f.segment_id = s.segment_id) s QUALIFY row_number() OVER (PARTITION BY s.stratum ORDER BY round(d, 9), s.segment_id) <= 3",
    b="SELECT segment_id, avg(price) AS m, stddev_pop(price) AS d FROM v_cell GROUP BY segment_id",
    f="SELECT segment_id, (m - (SELECT avg(m) FROM b)) / (SELECT stddev_samp(m) FROM b) AS z1, (d - (SELECT avg(d) FROM b)) / (SELECT stddev_samp(d) FROM b) AS z2 FROM b"))
def representative_segments(spark, sf_dir):
    """The three segments nearest to the centre of their stratum in standardised mean and spread."""
    from stratiq.operators.stats import to_centroid

    z = ["price__mean_z", "price__sd_z"]
    signatures = R.zscores(S.zonal(v_cell(spark, sf_dir), "segment_id", ["price"], ()), ["price__mean", "price__sd"])
    rows = signatures.join(v_seg(spark, sf_dir).select("segment_id", "stratum"), "segment_id")
    near = to_centroid(rows, "stratum", z).withColumn("_d", F.round("dist_to_center", 9))
    return R.top_n(near, 3, ["stratum"], [F.col("_d"), F.col("segment_id")]).select("stratum", "segment_id", r6("dist_to_center").alias("dist_to_center"))
