"""Beyond the reference: the cache and review logs as streams.

The batch operators keep the last write of each key; here the same tables are
kept up to date from a stream, and writes are counted by event-time window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.relational import upsert_latest


def events(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 8) -> DataFrame:
    """A stream of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed_counts(stream: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Writes by window and key; rows later than the watermark are left out, and closed windows leave the state."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("writes")).select(F.col("w.start").alias("start"), by, "writes")


def once(stream: DataFrame, at: str, key: str, late: str = "2 hours") -> DataFrame:
    """Events without repeats of one key inside the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def keep_latest(stream: DataFrame, key: str, order: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch to the last row of a key and append it to ``target`` with its batch number.

    A batch that is tried again writes the same rows under the same number, so
    ``latest`` over the target is exact.
    """

    def write(batch: DataFrame, number: int) -> None:
        folded = upsert_latest(batch, key, *[F.col(c) for c in order]).withColumn("batch_no", F.lit(number))
        folded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str, order: list[str]) -> DataFrame:
    """The table that ``keep_latest`` maintains."""
    return upsert_latest(spark.read.parquet(target).drop("batch_no"), key, *[F.col(c) for c in order])


def drain(query: StreamingQuery, then: Callable[[], DataFrame]) -> DataFrame:
    """Wait until all that has arrived is processed."""
    query.awaitTermination()
    return then()
