"""Reads and expression records as streams.

The same operators as for stored tables, applied to micro-batches: support per
position is an aggregation with a watermark, so late records within it are
counted and state is dropped beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def record_sums(records: DataFrame, lateness: str = "7 days", width: str = "1 day") -> DataFrame:
    """(window, segment_index, n_records, value): finite values of 0 or more, by event time; repeated records count once."""
    ok = records.filter("segment_index is not null and made_at is not null and value >= 0 and value < double('infinity')").withWatermark("made_at", lateness)
    once = ok.dropDuplicatesWithinWatermark(["segment_index", "sample_id", "made_at", "value"])
    return once.groupBy(F.window("made_at", width), "segment_index").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.col("value").cast("double")).alias("value"))


def run_to_table(df: DataFrame, path: str, checkpoint: str, output_mode: str = "append") -> None:
    """Process all that is there, then stop; both folders must be shared by all executors."""
    df.writeStream.format("parquet").outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
