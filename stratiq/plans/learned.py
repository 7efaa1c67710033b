"""Operators that no SQL expresses: models and iterative segmentation.  Tests hold their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiq.operators import medoids, models as M, prediction, segmentation
from stratiq.sources.scratch import removed_at_end, saved, scratch_path

from .registry import query
from .views import DOMAINS, VEC, table, v_cell, v_dist, v_feat, v_grid, v_seg, v_vec


@query()
def kmeans_strata(spark, sf_dir):
    return M.strata(v_feat(spark, sf_dir), "segment_id", list(DOMAINS), k=6, n=5)


@query()
def it_pca_strata(spark, sf_dir):
    from stratiq.operators.relational import quantile_bins, top_n

    scores = M.pca_scores(v_feat(spark, sf_dir), ["price", "w"], 2).select("segment_id", "pc1", "pc2", "origin_dist")
    binned = quantile_bins(scores, "pc1", 9)
    return top_n(binned, 10, ["bin"], [F.col("origin_dist"), F.col("segment_id")])


@query()
def rf_classify(spark, sf_dir):
    rows = v_feat(spark, sf_dir).join(v_cell(spark, sf_dir).groupBy("segment_id").agg(F.mode("cls", True).alias("cls")), "segment_id")
    return M.forest(rows.filter("segment_id % 10 = 0"), rows, "segment_id", "cls", list(DOMAINS))


@query()
def spatial_folds(spark, sf_dir):
    return M.spatial_folds(v_seg(spark, sf_dir), "x", "y", 5).select("segment_id", "fold")


@query()
def break_detection(spark, sf_dir):
    """Monthly means of each priority's price with a step added from month 60 on for some."""
    o = table(spark, sf_dir, "orders")
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    step = F.when((month >= 60) & F.col("o_orderpriority").startswith("1"), 100000.0).otherwise(0.0)
    monthly = o.groupBy("o_orderpriority", month.alias("month")).agg(F.avg(F.col("o_totalprice") + step).alias("value"))
    return M.break_detection(monthly, "o_orderpriority", "month", "value", start=48)


@query()
def meanshift_labels(spark, sf_dir):
    """Segments of the grid by mean shift to convergence; a test holds them against a plain one."""
    return segmentation.mean_shift(v_grid(spark, sf_dir), "z", 2.0, 60000.0, 100, minsize=3).select("row", "col", "segment")


@query()
def choose_k_report(spark, sf_dir):
    return M.k_report(M.evaluation_sample(v_dist(spark, sf_dir), "segment_id"), "segment_id", [f"d_{c}" for c in DOMAINS], [3, 5])


@query()
def hopkins(spark, sf_dir):
    return M.hopkins(v_vec(spark, sf_dir), "vec_id", VEC)


@query()
def ward_tiles(spark, sf_dir):
    tiles = v_grid(spark, sf_dir).groupBy((F.floor(F.col("row") / 10) * 10 + F.floor(F.col("col") / 10)).alias("tile")).agg(F.avg("z").alias("mean"), F.stddev_samp("z").alias("sd"))
    return M.ward(tiles, "tile", ["mean", "sd"], 6)


def _classed(spark, sf_dir):
    rows = v_feat(spark, sf_dir).join(v_cell(spark, sf_dir).groupBy("segment_id").agg(F.mode("cls", True).alias("cls")), "segment_id").join(v_seg(spark, sf_dir).select("segment_id", "x", "y"), "segment_id")
    return saved(M.spatial_folds(rows, "x", "y", 3), "folds")


@query()
def rf_tuning(spark, sf_dir):
    """Forests by trees and mtry, each judged on spatial blocks that it has not seen."""
    return M.tune_forest(_classed(spark, sf_dir), "segment_id", "cls", list(DOMAINS), "fold", (1, 2, 3), (5, 10), (2, 3), depth=4)


@query()
def rf_feature_selection(spark, sf_dir):
    """Predictors by forward selection on the same blocks."""
    chosen, kappa = M.forward_selection(_classed(spark, sf_dir), "segment_id", "cls", ["price", "disc", "w"], "fold", (1, 2, 3), trees=5, depth=4)
    return spark.createDataFrame([(i + 1, c, kappa) for i, c in enumerate(chosen)], "place int, feature string, kappa double")


@query()
def domain_strata(spark, sf_dir):
    """Strata of the cells' domain within a hull, with pruning and the choice of k."""
    units = v_seg(spark, sf_dir).select("segment_id", "x", "y").join(v_feat(spark, sf_dir), "segment_id", "left")
    return M.domain_strata(units, "segment_id", list(DOMAINS), ((-1.0, -1.0), (4500.0, -1.0), (4500.0, 1e9), (-1.0, 1e9)), (3, 4, 5), 5)


@query()
def tile_typing(spark, sf_dir):
    """Types of tiles by entropy, relative information, height and share of one class: eight clusters, five nearest each."""
    from stratiq.operators import signatures as S

    from .zones import _pairs, _tiled

    t = _tiled(spark, sf_dir)
    h = S.entropy(t.withColumn("one", F.lit(1.0)), "tile", "cls", "one").select("tile", "H")
    info = S.relative_information(h, S.mutual_information(_pairs(spark, sf_dir), ["tile"], "a", "b"), "tile").select("tile", "H", "U")
    more = t.groupBy("tile").agg(F.avg("z").alias("elevation"), F.avg(F.when(F.col("cls") == "1-URGENT", 1.0).otherwise(0.0)).alias("share"))
    return M.strata(info.join(more, "tile"), "tile", ["H", "U", "elevation", "share"], k=8, n=5)


@query()
def medoid_strata(spark, sf_dir):
    """Strata of the segments around medoids in place of means; a test holds the method against a plain one."""
    labelled, keys, _ = medoids.medoids(v_dist(spark, sf_dir), "segment_id", [f"d_{c}" for c in DOMAINS], 4, out="stratum")
    return labelled.select("segment_id", "stratum", F.col("segment_id").isin(keys).alias("medoid"))


@query()
def k_suggestions(spark, sf_dir):
    """Numbers of strata that medoids, k-means, Ward's merges and the bootstrap suggest, and their vote."""
    return medoids.k_suggestions(v_dist(spark, sf_dir), "segment_id", [f"d_{c}" for c in DOMAINS], [3, 4, 5], restarts=2, boots=10)


@query()
def rf_grid(spark, sf_dir):
    """Probabilities of classes for every cell of the grid, and its class, by a forest that was saved and loaded again.

    Cells learn from the block of ten by ten cells that they lie in: its mean, spread and highest value, labelled by its commonest class.
    """
    grid = v_grid(spark, sf_dir)
    block = [F.floor(F.col("row") / 10).alias("block_row"), F.floor(F.col("col") / 10).alias("block_col")]
    blocks = saved(grid.groupBy(*block).agg(F.avg("z").alias("mean"), F.stddev_samp("z").alias("sd"), F.max("z").alias("top"), F.mode("cls", True).alias("class")), "blocks")
    path = scratch_path(spark, "forest")
    prediction.fit_forest(blocks, "class", ["mean", "sd", "top"], trees=10, depth=4).save(path)
    removed_at_end(spark, path)
    found = prediction.load_forest(path)
    cells = grid.select("row", "col", *block).join(blocks.drop("class"), ["block_row", "block_col"]).select("row", "col", "mean", "sd", "top")
    return prediction.hard_classes(prediction.probabilities(cells, found), found).drop("mean", "sd", "top")


@query()
def rf_refit(spark, sf_dir):
    """The forest refitted with the predictors and settings that spatial blocks prefer, and what it says of every segment."""
    rows = _classed(spark, sf_dir)
    found, _ = prediction.tuned_forest(rows, "segment_id", "cls", ["price", "disc", "w"], "fold", (1, 2, 3), trees=(5, 10), most=3, depth=4)
    return prediction.hard_classes(prediction.probabilities(rows.select("segment_id", *found.features), found), found).drop(*found.features)


@query()
def candidate_points(spark, sf_dir):
    """The three nearest segments of each of six strata in two spaces of decision, at the middle of their orders' cells."""
    units, place = v_feat(spark, sf_dir), v_seg(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("segment_id"), (F.col("l_orderkey") % 100).alias("x"), F.floor(F.col("l_orderkey") / 100).alias("y"))
    spaces = {"price": (units, ["price", "w"]), "terms": (units, ["disc", "tax", "ord"])}
    return prediction.candidates_as_points(place.select("segment_id"), "segment_id", lines, spaces, {"price": 6, "terms": 6}, 3)
