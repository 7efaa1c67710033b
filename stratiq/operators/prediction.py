"""Forests that are kept: fitted once, saved, loaded, and applied to grids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiq.sources.scratch import saved

from . import relational as R
from .models import forward_selection, tune_forest
from .relational import small


@dataclass(frozen=True)
class Forest:
    """A fitted pipeline: label to number, features to a vector, forest."""

    pipeline: PipelineModel

    @property
    def labels(self) -> list[str]:
        return list(self.pipeline.stages[0].labels)

    @property
    def features(self) -> list[str]:
        return list(self.pipeline.stages[1].getInputCols())

    def save(self, path: str) -> None:
        """Written whole; a model that is there is replaced."""
        self.pipeline.write().overwrite().save(path)


def load_forest(path: str) -> Forest:
    return Forest(PipelineModel.load(path))


def _finite(features: Sequence[str]) -> Column:
    """True where every feature is a number other than NaN and the infinities."""
    out = F.lit(True)
    for f in features:
        c = F.col(f).cast("double")
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def fit_forest(train: DataFrame, label: str, features: Sequence[str], trees: int = 20, depth: int = 6, mtry: int = 2, seed: int = 1) -> Forest:
    """Fitted on the rows with a label and finite features; ValueError if there is none."""
    rows = train.filter(_finite(features) & F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_label"), *[F.col(f).cast("double").alias(f) for f in features])
    if rows.isEmpty():
        raise ValueError("no row to learn from")
    stages = [
        StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=list(features), outputCol="_v"),
        RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, maxDepth=depth, featureSubsetStrategy=str(min(mtry, len(features))), seed=seed),
    ]
    return Forest(Pipeline(stages=stages).fit(rows))


def probabilities(df: DataFrame, found: Forest) -> DataFrame:
    """``df`` with p_<class> for each class: grids by cells, tables by rows, wherever they lie.  Rows that lack a finite feature have null."""
    ok, names = _finite(found.features), found.features
    # Spark fills in what the model may not see, and its answers there are taken back.
    asked = df.select("*", ok.alias("_ok"), *[F.when(ok, F.col(f).cast("double")).otherwise(0.0).alias(f"_f{i}") for i, f in enumerate(names)])
    vector = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(names))], outputCol="_v")
    out = found.pipeline.stages[2].transform(vector.transform(asked)).withColumn("_p", vector_to_array("probability"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.when(F.col("_ok"), F.col("_p")[i]).alias(f"p_{c}") for i, c in enumerate(found.labels)])


def hard_classes(df: DataFrame, found: Forest, ids: DataFrame | None = None, label: str = "class", number: str = "class_id") -> DataFrame:
    """``df`` of :func:`probabilities` with the likeliest class (the first of equals) and its number.

    ``ids`` holds pairs of class and number, repeated or not; ValueError if they
    are not one to one.  Classes that it lacks have a null number.  Without it,
    numbers run from 1 in the classes' order.
    """
    every = F.array(*[F.col(f"`p_{c}`") for c in found.labels])
    at = F.when(F.array_max(every).isNotNull(), F.array_position(every, F.array_max(every)).cast("int"))
    out = df.withColumn(label, F.get(F.array(*map(F.lit, found.labels)), at - 1))
    if ids is None:
        return out.withColumn(number, at)
    pairs = ids.select(F.col(label).cast("string").alias(label), number).distinct().na.drop()
    for side in (label, number):
        if not pairs.groupBy(side).count().filter("count > 1").isEmpty():
            raise ValueError(f"{label} and {number} are not one to one")
    return out.join(small(pairs), label, "left")


def tuned_forest(rows: DataFrame, key: str, label: str, features: Sequence[str], fold: str, folds: Sequence[int], trees: Sequence[int] = (200, 400, 600), most: int = 8, depth: int = 6, seed: int = 1, select: bool = True) -> tuple[Forest, DataFrame]:
    """The forest refitted on all rows with the predictors and settings that spatial blocks prefer, and the sweep's table.

    Predictors by forward selection (with ``select``), then every number of trees
    with every mtry from 2 up to ``most`` or the number of predictors.
    """
    chosen = forward_selection(rows, key, label, features, fold, folds, depth=depth)[0] if select and len(features) > 1 else list(features)
    sweep = tune_forest(rows, key, label, chosen, fold, folds, trees, range(min(2, len(chosen)), min(most, len(chosen)) + 1), depth=depth)
    best = sweep.filter("best").first()
    return fit_forest(rows, label, chosen, best["trees"], depth, best["mtry"], seed), sweep


def candidates_as_points(units: DataFrame, key: str, cells: DataFrame, spaces: dict[str, tuple[DataFrame, Sequence[str]]], ks: dict[str, int], n: int, x: str = "x", y: str = "y") -> DataFrame:
    """candidate_type, key, stratum, dist_to_center, x, y: the n nearest units of each stratum in each space of decision, at the middle of their cells.

    Each space has its table, its features and a fixed number of strata; units
    that are incomplete in a space are no candidate of it.  ``cells`` (key, x, y)
    are joined to the candidates alone, which are few; a unit without a cell has no place.
    """
    from .models import strata

    # Broadcast up to a checked number of rows; by the size of a packed file alone, millions of keys would be.
    keys = units.select(key)
    keys = F.broadcast(keys) if keys.limit(R.FEW_ROWS + 1).count() <= R.FEW_ROWS else keys.hint("merge")
    found = None
    for name, (table, features) in spaces.items():
        own = strata(keys.join(table, key), key, features, ks[name], n).filter("candidate")
        one = own.select(F.lit(name).alias("candidate_type"), key, "stratum", "dist_to_center")
        found = one if found is None else found.unionByName(one)
    found = saved(found, "candidates")
    middles = cells.join(small(found.select(key).distinct()), key, "left_semi").groupBy(key).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    return found.join(middles, key, "left")
