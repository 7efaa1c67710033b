"""What the training-data operators share: table access, word rules, samples, scratch tables, joins on hot keys.

Batches of whole texts need no setting: Spark ends an Arrow batch at
``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB unless set otherwise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the class body of a regular expression.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Tables of up to so many rows of a few numbers each may be broadcast.
FEW_ROWS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(id_col: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8")) % folds


def own_place(id_col: Column, text: Column) -> list[Column]:
    """What tells a row from others: id and text, and of a row without id also its place in the table.

    Copies without id thus differ; reruns over the same files agree.
    """
    return [id_col, text, F.when(id_col.isNull(), F.monotonically_increasing_id())]


def drawn(key: Column | str | list[Column], seed: str, share: Column | float) -> Column:
    """True for about ``share`` of the keys, chosen by a hash; shares down to 2^-52 count."""
    return F.pmod(F.xxhash64(*(key if isinstance(key, list) else [key]), F.lit(seed)), F.lit(1 << 52)) < F.lit(float(1 << 52)) * (F.lit(share) if isinstance(share, float) else share)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables between jobs.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset in
    a session of one local process, as in tests, a folder of our own is chosen.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints/stratiq"


def saved(df: DataFrame, name: str, into: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts lineage and survives lost executors.

    The path is appended to ``into``, for :func:`removed`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at_exit(spark, path)
    if into is not None:
        into.append(path)
    return spark.read.schema(df.schema).parquet(path)


def at_exit(spark: SparkSession, path: str) -> None:
    """Delete a scratch table when the driver's JVM ends: results may be read until then."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, n: str = "_n", share: int = 500, least: int = 64, most: int = 100_000) -> DataFrame:
    """Of ``counts`` (a row for each key, with its rows ``n``) the keys that would fill a task: over 1/share of all rows, or over ``most``.

    They number at most share + rows / most.  ``_parts`` says into how many parts of that size a key falls.
    """
    limit = counts.agg(F.least(F.greatest(F.sum(n) / F.lit(share), F.lit(float(least))), F.lit(float(most))).alias("_limit"))
    return counts.join(F.broadcast(limit), F.col(n) > F.col("_limit")).withColumn("_parts", F.ceil(F.col(n) / F.col("_limit")).cast("int")).drop("_limit")


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str, counts: DataFrame | None = None, scratch: list[str] | None = None, how: str = "inner") -> DataFrame:
    """``rows`` with ``value`` from a table that has each ``key`` at most once; rows without a match go, or with ``how="left"`` get null.

    No key is null.  Keys that many rows share meet their value by broadcast, the others by
    shuffle.  ``counts``: the rows of each key as ``_n``, where they are known.
    """
    counts = counts if counts is not None else rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    table = table.select(key, value)
    hot = saved(hot_keys(counts.select(key, "_n")).select(key).join(table, key, how), "hot-values", scratch)
    if hot.isEmpty():
        return rows.join(table, key, how)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key, how)
    return near.unionByName(far)
