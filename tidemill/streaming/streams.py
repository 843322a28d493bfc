"""Structured Streaming: replay of a folder of files, duplicates told across batches and runs, append-only output.

A stream keeps its place in its checkpoint, so a second run goes on where the first one ended. Duplicates are told by the md5
of the normalised text: `deduplicated` keeps the keys in state, `deduplicate_into` in a table beside the output, so that
its state does not grow with the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.functions import text as T
from tidemill.sources import io


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 0) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def duplicate_key(c: Column) -> Column:
    return F.md5(T.fingerprint_key(T.text(c)))


def deduplicated(stream: DataFrame, c: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key; with an event time, keys older than the delay are forgotten."""
    keyed = stream.withColumn("_key", duplicate_key(F.col(c)))
    if event_time:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return keyed.dropDuplicates(["_key"]).drop("_key")


def run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, appended exactly once."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> None:
    """The whole result after each batch, as files in place of the ones before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def deduplicate_into(stream: DataFrame, c: str, order: str, path: str, checkpoint: str) -> None:
    """Append the rows whose key is not in the output yet; a batch that is run again adds nothing.

    The output is partitioned by the first two digits of the key, and a batch is compared with the keys of its own
    partitions only: one column of the files that can hold them.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("_key", duplicate_key(F.col(c)))
        first = keyed.groupBy("_key").agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("_key", "r.*")
        first = first.withColumn("_batch", F.lit(number)).withColumn("_part", F.substring("_key", 1, 2))
        have = io.read_if_there(spark, path, first.schema)
        if have is not None:
            parts = [r[0] for r in first.select("_part").distinct().collect()]  # at most 256
            first = first.join(have.where(F.col("_part").isin(parts)).select("_key"), "_key", "left_anti")
        first.write.mode("append").partitionBy("_part").parquet(path)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_totals(stream: DataFrame, time: str, value: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """An extension: counts and sums per tumbling window, closed by a watermark."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("window.start", "n", "total")
