"""Matching in micro-batches: each run takes the files that came since the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def process_new(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], files_per_batch: int = 100) -> StreamingQuery:
    """Apply a batch transformation to new files and write each batch once.

    A batch writes its own folder, by its number, so that one that is run again replaces itself.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unscored_stream(pairs: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Streamed pairs whose contents no batch has scored yet, each once within the watermark's time."""
    fresh = pairs.join(cache.select(*keys).distinct(), keys, "left_anti")
    return fresh.withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(keys)


def finished(runs: DataFrame, expected: int) -> bool:
    """Whether all competitors of a run are done."""
    return runs.where(F.col("finished")).select("competitor").distinct().count() >= expected
