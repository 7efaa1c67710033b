"""Exact deduplication by content sort (DataFrame functions only).

Rows are range-partitioned by their normalised content, with splitters that
Spark samples; each partition is sorted externally, so that equal contents are
neighbours; a window over the sorted run compares neighbouring contents in full
and names the row that stays.

Splitters carry a short prefix, a 64-bit digest and a salt in place of whole
texts: what the sample brings to the driver is then at most about 60 bytes a
row, while equal texts still agree on all three and so meet in one run.  The
columns of the sort are written once; the sample and the sort read them.

A text held by very many rows would fill one partition.  Digests are counted
first (partial aggregates, 16 bytes a row); one that holds more than
1/``hot_share`` of the rows, or more than ``hot_rows``, is dealt to sorted runs
of about that many rows, row by row and whatever the ids.  A second content sort
over the runs' survivors, one for each run of a hot text, joins those runs.

Defined results
---------------
* Null and empty texts, and texts of white space alone, are all equal.
* Ties in length go to the smallest ``doc_id``; a null id sorts last.
* Repeated rows (same id and text): exactly one row is kept.
* An empty table gives an empty result.
* Further columns of the input are ignored by :func:`decide` and returned
  unchanged by :func:`deduplicate`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW_ROWS, SPACE, hot_keys, saved, shuffle_parts

PREFIX = 32


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def _content_sorted(rows: DataFrame, parts: int, content: Column) -> DataFrame:
    """Range-partition by content, sort, and compare neighbours: adds _norm (the content), _rank, _size, _best."""
    run = Window.partitionBy("_prefix", "_digest", "_salt", "_norm")
    best = run.orderBy(F.col("_len").desc(), F.col("_id").asc_nulls_last())
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        rows.repartitionByRange(parts, "_prefix", "_digest", "_salt")
        .withColumn("_norm", content)
        .withColumn("_rank", F.row_number().over(best))
        .withColumn("_size", F.sum("_n").over(whole))
        .withColumn("_best", F.first("_id").over(whole))
        .withColumn("_best_len", F.first("_len").over(whole))
    )


def _decided(docs: DataFrame, id_col: str, text_col: str, hot_share: int, hot_rows: int, keep: bool) -> DataFrame:
    """_id, _row (the input row, with ``keep``), _keep, _size, _kept, _sha."""
    parts = shuffle_parts(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    norm = normalised(text)
    # A row that is kept whole holds its text, from which the content is made again behind the shuffle.
    body = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep else [F.lit(None).cast("int").alias("_row"), norm.alias("_norm")]
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), *body, F.length(F.coalesce(text, F.lit(""))).alias("_len"), F.xxhash64(norm).alias("_digest"), F.substring(norm, 1, PREFIX).alias("_prefix"))
    rows = saved(rows, "exact-rows")
    counts = rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
    hot = saved(hot_keys(counts, share=hot_share, most=hot_rows).select("_digest", "_parts"), "exact-hot")
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts"))
    keyed = rows.withColumn("_hash", F.col("_digest")).join(F.broadcast(hot.withColumnRenamed("_digest", "_hash")), "_hash", "left").drop("_hash")
    keyed = keyed.withColumn("_salt", F.coalesce(deal, F.lit(0)).cast("int")).withColumn("_hot", F.col("_parts").isNotNull()).drop("_parts").withColumn("_n", F.lit(1).cast("long"))
    runs = _content_sorted(keyed, parts, normalised(F.col(f"_row.`{text_col}`")) if keep else F.col("_norm")).select(
        "_id", "_row", "_digest", "_prefix", "_salt", "_hot", "_rank", "_size", "_best", "_best_len",
        F.sha2(F.encode("_norm", "UTF-8"), 256).alias("_sha"),
        # Survivors of hot runs carry their text to the second sort.
        F.when(F.col("_hot") & (F.col("_rank") == 1), F.col("_norm")).alias("_norm"),
    )
    runs = saved(runs, "exact-runs")
    survivors = runs.filter(F.col("_hot") & (F.col("_rank") == 1)).select(
        "_digest", "_prefix", "_norm", F.col("_salt").alias("_run"), F.lit(0).alias("_salt"), F.col("_best").alias("_id"), F.col("_best_len").alias("_len"), F.col("_size").alias("_n"),
    )
    joined = _content_sorted(survivors, min(parts, hot_share), F.col("_norm")).select(
        "_digest", F.col("_run").alias("_salt"), F.sha2(F.encode("_norm", "UTF-8"), 256).alias("_sha"),
        F.col("_best").alias("_all_best"), F.col("_size").alias("_all_size"), (F.col("_rank") == 1).alias("_first_run"),
    )
    joined = saved(joined, "exact-joined")
    few = joined.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    out = runs.drop("_norm").join(F.broadcast(joined) if few else joined, ["_digest", "_salt", "_sha"], "left")
    return out.select(
        "_id", "_row",
        F.when(F.col("_first_run").isNull(), F.col("_best")).otherwise(F.col("_all_best")).alias("_keep"),
        F.coalesce("_all_size", "_size").alias("_size"),
        ((F.col("_rank") == 1) & F.coalesce("_first_run", F.lit(True))).alias("_kept"),
        "_sha",
    )


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = 200, hot_rows: int = 200_000) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    found = _decided(docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")), "i", "t", hot_share, hot_rows, False)
    return found.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = 200, hot_rows: int = 200_000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = _decided(docs, id_col, text_col, hot_share, hot_rows, True).filter("_kept")
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
