"""Tables between the rounds of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs in one local process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints/stratiq"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, for files other than Spark's own."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Results may be read until the driver's JVM ends; then what lies at ``path`` goes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written out and read back: lineage ends here and lost executors cost no earlier round."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    removed_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`saved` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
