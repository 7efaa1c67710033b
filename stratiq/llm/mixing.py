"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents, ordered by a seeded hash of id and text, form a permuted
sequence that is cut into blocks of about ``block_docs`` documents by hash
range.  A source's target in words gives an exact quota of blocks: whole passes
over the sequence, then the leading blocks of one more pass, then a last block of
which only the documents count that come nearest to the target.  A binary tree
over the output shards splits all quotas: at each node the left half's blocks are
one multivariate-hypergeometric draw from the node's quotas, so that the leaves'
quotas add up exactly.  Each shard then takes its own run of each source's
permuted blocks, disjoint from all other shards' runs, and shuffles its rows
locally.  A document is taken once for each run that holds its block.

Sources are a table, not a list of the driver: their order, targets, quotas and
cuts are columns.  The tree runs on two levels with the same distribution, first
over groups of ``GROUP`` neighbouring sources on the driver, then within each
group in a task of its own.  Rows meet their source's plan by broadcast where the
source is hot or there are few, by shuffle otherwise.

Only sums for each source and block are aggregated; no source's rows meet in
one task except those of its last block (its documents / ``MAX_BLOCKS``, or
about ``block_docs``).

Targets: sources in code point order, null last, have the weights given, in
turn, and share the size of the whole input; none exceeds ``max_repeats`` times
its size, and what is cut off goes to the others by weight.

Defined results
---------------
* Null text has size 0; such rows, and those of a source of size 0, are taken
  as often as their source's whole blocks say, at most ``max_repeats`` times,
  which adds no word.
* Null source: a source of its own, last in order.
* Rows with equal id, text and source are taken together, each equally often.  Rows
  without id have places of their own, by their place in the table.
* An empty table gives an empty result.
* Further columns are ignored by ``decide``, kept by ``mix``, whatever their names.
* Reruns agree: every draw is seeded.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hot_keys, own_place, saved

MAX_BLOCKS = 65_536
RANGE = 1 << 52
#: Sources that one task splits at a time.
GROUP = 4_096
#: Plans of up to so many sources are broadcast whole.
FEW_SOURCES = 2_000
#: Documents chosen from last blocks, a few numbers each, that may be broadcast.
FEW_CHOSEN = 200_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_tree(quotas: np.ndarray, shares: np.ndarray, seed: Iterable[int]) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows): columns add up to ``quotas``, rows to ``shares``."""
    out = np.zeros((len(shares), len(quotas)), np.int64)
    nodes = [(0, len(shares), quotas.astype(np.int64))]
    while nodes:
        low, high, have = nodes.pop()
        if high - low == 1:
            out[low] = have
            continue
        mid = (low + high) // 2
        draw = np.random.default_rng((*seed, low, high))
        left = draw.multivariate_hypergeometric(have, int(shares[low:mid].sum()), method="marginals")
        nodes += [(low, mid, left), (mid, high, have - left)]
    return out


def even(total: int, shards: int) -> np.ndarray:
    """``total`` blocks dealt to the shards as evenly as whole numbers allow."""
    return np.diff(np.arange(shards + 1, dtype=object) * int(total) // shards).astype(np.int64)


def targets(sources: DataFrame, weights: Iterable[int], max_repeats: int) -> DataFrame:
    """``sources`` (_source, _n, _docs) in code point order, null last, with _s (place in it), _group and _target.

    A target is the lesser of ``max_repeats`` times the size and of weight times
    a level; the level rises until no further source is cut off, each round one
    aggregate over the sources.
    """
    cycle = [float(w) for w in weights]
    parts = max(1, sources.count() // 100_000)
    dealt = saved(sources.withColumn("_last", F.col("_source").isNull()).repartitionByRange(parts, "_last", "_source").withColumn("_part", F.spark_partition_id()), "mix-order")
    found = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # at most ``parts`` rows
    before = dict(zip([p for p, _ in found], np.cumsum([0, *[n for _, n in found]]).tolist(), strict=False))
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_part")) if before else F.lit(0)
    place = offset + F.row_number().over(Window.partitionBy("_part").orderBy("_last", "_source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("_s") % len(cycle) + 1).cast("int"))
    ordered = saved(dealt.withColumn("_s", place.cast("long")).withColumn("_group", F.floor(F.col("_s") / GROUP)).withColumn("_weight", weight), "mix-sources")
    most, total, level, closed = F.col("_n") * float(max_repeats), None, 0.0, -1
    while True:
        over = F.col("_weight") * F.lit(level) > most
        row = ordered.agg(F.sum("_n"), F.sum(F.when(over, most).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_weight"))), F.sum(over.cast("int"))).first()
        if row[3] is None or row[3] == closed or not row[2]:
            break
        total, closed = float(row[0]), row[3]
        level = (total - row[1]) / row[2]
    return ordered.withColumn("_target", F.least(most, F.col("_weight") * F.lit(level))).drop("_last", "_part", "_weight")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a source's last block: the documents, in permuted order, that come nearest to what is left to take."""
    pdf = pdf.sort_values("_h")
    left, sizes = float(pdf["_left"].iloc[0]), pdf["_size"].to_numpy()
    taken = np.zeros(len(pdf), bool)
    for i, n in enumerate(sizes):
        if 0 < n <= left:
            taken[i] = True
            left -= n
    rest = np.where(taken, np.inf, np.abs(left - sizes))
    if len(rest) and rest.min() < left:
        taken[int(rest.argmin())] = True
    return pdf.loc[taken, ["_s", "_h"]].assign(_chosen=True)


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, keep: bool) -> DataFrame:
    key = F.col(f"`{id_col}`")
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep else []
    text = F.col(f"`{text_col}`")
    place = F.pmod(F.xxhash64(*own_place(key, text), F.lit(seed)), F.lit(RANGE))
    return docs.select(key.alias("_id"), F.col(f"`{source_col}`").alias("_source"), words(text).alias("_size"), place.alias("_h"), *kept)


def _placed(rows: DataFrame, plan: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of their source's plan."""
    plan = plan.select(F.col("_source").alias("_name"), *names)
    same = F.col("_source").eqNullSafe(F.col("_name"))
    if plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        return rows.join(F.broadcast(plan), same).drop("_name")
    hot = saved(hot_keys(plan.select("_name", F.col("_docs").alias("_n"))).select("_name", F.lit(True).alias("_hot")), "mix-hot")
    marked = plan.join(F.broadcast(hot.withColumnRenamed("_name", "_key")), F.col("_name").eqNullSafe(F.col("_key")), "left").drop("_key")
    near = rows.join(F.broadcast(marked.filter("_hot").drop("_hot")), same)
    apart = rows.join(F.broadcast(hot.select("_name")), same, "left_anti")
    return near.unionByName(apart.join(marked.filter("_hot is null").drop("_hot"), same)).drop("_name")


def _cuts(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """_s, _cuts: of each source the blocks that the shards up to each one take.  ``quotas``: _s, _group, _quota."""
    spark = quotas.sparkSession
    groups = sorted((r["_group"], int(r["n"])) for r in quotas.groupBy("_group").agg(F.sum("_quota").alias("n")).collect())  # a row for GROUP sources
    dealt = split_tree(np.array([n for _, n in groups], np.int64), even(sum(n for _, n in groups), shards), (seed,)) if groups else np.zeros((shards, 0), np.int64)
    shares = spark.createDataFrame([(g, [int(x) for x in dealt[:, i]]) for i, (g, _) in enumerate(groups)], "_group long, _shares array<long>")

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        cuts = np.cumsum(split_tree(pdf["_quota"].to_numpy(), np.asarray(pdf["_shares"].iloc[0]), (seed, int(pdf["_group"].iloc[0]) + 1)), axis=0)
        return pd.DataFrame({"_s": pdf["_s"], "_cuts": list(cuts.T)})

    return quotas.join(F.broadcast(shares), "_group").groupBy("_group").applyInPandas(split, "_s long, _cuts array<long>")


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Iterable[int], max_repeats: int, shards: int, seed: int, block_docs: int, keep: bool) -> DataFrame:
    """The rows with _source_size, _target and _shards, one shard for each time the row is taken."""
    slim = saved(_rows(docs, id_col, text_col, source_col, seed, False), "mix-sizes")
    sources = saved(slim.groupBy("_source").agg(F.sum("_size").alias("_n"), F.count(F.lit(1)).alias("_docs")), "mix-totals")
    # A node of the tree draws from fewer than 1e9 blocks, as numpy asks.
    number, held = sources.agg(F.count(F.lit(1)), F.sum("_docs")).first()
    most = max(1, min(MAX_BLOCKS, 300_000_000 // (max_repeats * min(max(1, number), GROUP))))
    block_docs = max(block_docs, max_repeats * (held or 0) // 500_000_000)
    passes = F.when(F.col("_n") > 0, F.least(F.lit(max_repeats), F.floor(F.col("_target") / F.col("_n")))).otherwise(0)
    plan = (
        targets(sources, weights, max_repeats)
        .withColumn("_k", F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("_docs") / block_docs))).cast("long"))
        .withColumn("_passes", passes.cast("long"))
        .withColumn("_rest", F.when(F.col("_passes") < max_repeats, F.greatest(F.lit(0.0), F.col("_target") - F.col("_passes") * F.col("_n"))).otherwise(0.0))
    )
    plan = saved(plan, "mix-plan")
    # A product of whole numbers would leave the 64 bits from 2,048 blocks of a source on.
    block = F.least(F.floor(F.col("_h").cast("double") * F.col("_k") / F.lit(float(RANGE))), F.col("_k") - 1)

    # One row for each source and block, at most MAX_BLOCKS of a source.
    run = Window.partitionBy("_s").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = _placed(slim, plan, ["_s", "_k", "_docs", "_rest"]).withColumn("_block", block).groupBy("_s", "_block", "_rest").agg(F.sum("_size").alias("_words"))
    sums = sums.filter("_rest > 0").withColumn("_before", F.coalesce(F.sum("_words").over(run), F.lit(0)))
    last = sums.filter((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_words")))
    last = last.select("_s", F.col("_block").alias("_last"), (F.col("_rest") - F.col("_before")).alias("_left"))
    plan = plan.join(last, "_s", "left").withColumn("_full", F.coalesce("_last", F.when(F.col("_rest") > 0, F.col("_k")).otherwise(0)))
    quota = F.col("_passes") * F.col("_k") + F.col("_full") + F.col("_last").isNotNull().cast("long")
    plan = saved(plan.withColumn("_quota", quota), "mix-quotas")
    plan = saved(plan.join(_cuts(plan.select("_s", "_group", "_quota"), shards, seed), "_s"), "mix-cuts")

    ends = _placed(slim, plan.filter("_last is not null"), ["_s", "_k", "_docs", "_last", "_left"]).filter(block == F.col("_last"))
    chosen = ends.groupBy("_s", "_h", "_left").agg(F.sum("_size").alias("_size")).groupBy("_s").applyInPandas(_fill, "_s long, _h long, _chosen boolean")
    chosen = saved(chosen.withColumnsRenamed({"_s": "_cs", "_h": "_ch"}), "mix-chosen")
    few = chosen.limit(FEW_CHOSEN + 1).count() <= FEW_CHOSEN

    rows = _rows(docs, id_col, text_col, source_col, seed, True) if keep else slim
    rows = _placed(rows, plan.withColumnsRenamed({"_n": "_source_size"}), ["_s", "_k", "_docs", "_passes", "_last", "_cuts", "_source_size", "_target"]).withColumn("_block", block)
    rows = rows.join(F.broadcast(chosen) if few else chosen, (F.col("_s") == F.col("_cs")) & (F.col("_h") == F.col("_ch")), "left")
    # A row stands at its block's place in every pass; the shard is the first whose run ends behind that place.
    # Beyond the quota there is none, and of the last block only what is chosen counts.
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_passes")), lambda t: t * F.col("_k") + F.col("_block"))
    at = F.filter(at, lambda p: ~F.col("_last").eqNullSafe(p - F.col("_passes") * F.col("_k")) | F.coalesce("_chosen", F.lit(False)))
    shard = F.transform(at, lambda p: F.size(F.filter("_cuts", lambda x: x <= p)))
    return rows.withColumn("_shards", F.filter(shard, lambda x: x < shards))


def decide(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Iterable[int] = (1, 2, 3), max_repeats: int = 3,
    shards: int = 64, seed: int = 7, block_docs: int = 256,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, shards (one for each time it is taken), taken."""
    rows = _planned(docs, id_col, text_col, source_col, tuple(weights), max_repeats, shards, seed, block_docs, False)
    return rows.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_shards").alias("shards"), (F.col("_size") * F.size("_shards")).alias("taken"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Iterable[int] = (1, 2, 3), max_repeats: int = 3,
    shards: int = 64, seed: int = 7, block_docs: int = 256,
) -> DataFrame:
    """The mixed rows, repeats included, with the columns of ``docs``: shard after shard, each shuffled."""
    rows = _planned(docs, id_col, text_col, source_col, tuple(weights), max_repeats, shards, seed, block_docs, True)
    rows = rows.select("_row", "_h", F.posexplode("_shards").alias("_pass", "_shard"))
    rows = rows.withColumn("_draw", F.xxhash64("_h", "_pass", F.lit(seed + 1)))
    return rows.repartitionByRange(shards, "_shard", "_draw").sortWithinPartitions("_shard", "_draw").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
