"""Strata, score fusion and the choice of sites under quotas and spacing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiq.functions.numeric import weighted_sum

from .geometry import thin
from .relational import filter_text, top_n, union_fill, unit_range


def mcda(df: DataFrame, weights: dict[str, float], condition: str = "", scope: str = "filtered", out: str = "mcda_score") -> DataFrame:
    """Weighted sum of distances mapped to 0..1; null if any is.  Ranges come from the filtered rows or from all (scope 'global')."""
    if scope not in ("filtered", "global"):
        raise ValueError(f"unknown scope {scope}")
    rows = filter_text(df, condition) if scope == "filtered" else df
    scored = unit_range(rows, list(weights)).withColumn(out, weighted_sum({f"{c}_n": w for c, w in weights.items()}))
    return filter_text(scored, condition) if scope == "global" else scored


def lowest(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n rows of the lowest score; rows without a score are never picked."""
    return df.filter(F.col(score).isNotNull()).orderBy(score, key).limit(n)


@dataclass(frozen=True)
class Setting:
    """One scenario of the selector."""

    name: str
    target: str
    per_target: int
    condition: str = ""
    rank: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=dict)
    scope: str = "filtered"
    spacing: float = 0.0


def select_sites(df: DataFrame, setting: Setting, key: str) -> DataFrame:
    """Filter, rank (by columns, or by fused score), quota per target, then spacing."""
    if setting.weights:
        rows, order = mcda(df, setting.weights, setting.condition, setting.scope), ["mcda_score"]
        rows = rows.filter("mcda_score is not null").withColumn("mcda_score", F.round("mcda_score", 9))
    else:
        rows, order = filter_text(df, setting.condition), list(setting.rank)
        rows = rows.na.drop(subset=order)
    picked = top_n(rows, setting.per_target, [setting.target], [*[F.col(c) for c in order], F.col(key)])
    return thin(picked, key, order, setting.spacing) if setting.spacing > 0 else picked


def scenarios(df: DataFrame, settings: Sequence[Setting], key: str, keep: Sequence[str]) -> DataFrame:
    """All settings' sites under a column ``setting``."""
    return union_fill([select_sites(df, s, key).select(F.lit(s.name).alias("setting"), *keep) for s in settings])


def coverage(all_: DataFrame, picked: DataFrame, target: str) -> DataFrame:
    """Per target: units, picked units and their share."""
    a = all_.groupBy(target).agg(F.count(F.lit(1)).alias("units"))
    b = picked.groupBy(target).agg(F.count(F.lit(1)).alias("picked"))
    return a.join(b, target, "left").select(target, "units", F.coalesce("picked", F.lit(0)).alias("picked"), (F.coalesce("picked", F.lit(0)) / F.col("units")).alias("share"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of two choices and of what they share."""
    x = a.select(key, F.lit(1).alias("_a")).join(b.select(key, F.lit(1).alias("_b")), key, "full")
    n = lambda c: F.count(F.when(c, 1))
    return x.agg(n(F.col("_a").isNotNull()).alias("first"), n(F.col("_b").isNotNull()).alias("second"), n(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def domain_summary(all_: DataFrame, picked: DataFrame, domain: str, features: Sequence[str]) -> DataFrame:
    """How well a choice stands for each domain: units, picked, and for each feature the picked units' mean less that of all, in standard deviations of all (null without picked units or spread)."""
    whole = all_.groupBy(domain).agg(F.count(F.lit(1)).alias("units"), *[f(c).alias(f"{n}_{c}") for c in features for n, f in (("_m", F.avg), ("_s", F.stddev_samp))])
    part = picked.groupBy(domain).agg(F.count(F.lit(1)).alias("picked"), *[F.avg(c).alias(f"_p_{c}") for c in features])
    gaps = [((F.col(f"_p_{c}") - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))).alias(f"{c}_gap") for c in features]
    return whole.join(part, domain, "left").select(domain, "units", F.coalesce("picked", F.lit(0)).alias("picked"), *gaps)
