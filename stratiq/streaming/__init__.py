"""The station summaries on unbounded input: an extension, with the batch functions unchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stratiq.operators.temporal import tumbling


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """Parquet files of ``events`` as a stream of station rows."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return rows.select(F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("ws"))


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return tumbling(stream.withWatermark("ts", late), "ts", "1 hour")


def run_once(stream: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Drive a stream of summaries over what there is now; the last state of each key (columns of the stream) as a table.

    Each batch writes the keys that it changed to a folder of its own below
    ``path``, in the tasks, and a batch that runs again replaces its folder: the
    result passes neither through the driver's memory nor in twice.  Run again
    with the same ``path``, the stream goes on where it ended.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch_number={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    kind = StructType([*stream.schema.fields, StructField("batch_number", LongType())])
    rows = stream.sparkSession.read.schema(kind).parquet(f"{path}/batches")
    last = F.max_by(F.struct(*stream.columns), "batch_number").alias("_last")
    return rows.groupBy(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]).agg(last).select("_last.*")
