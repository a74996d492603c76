"""Idempotent incremental load: the checkpoint remembers what was loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.dates import board_from_path, ingest_date_from_path


def load_new_files(spark: SparkSession, folder: str, target: str, checkpoint: str, max_files: int = 10_000, pattern: str = "*.json") -> int:
    """Appends landed files that no earlier call has loaded to a Parquet table; returns their number.

    ``max_files`` bounds a micro-batch, so a backlog of any size is loaded in batches; the
    number counts what every batch wrote. Batches are folders of the table (column ``batch``).
    """
    stream = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder)
    path = F.col("_metadata.file_path")
    rows = stream.select(F.col("value").alias("raw_text"), path.alias("file_name"), F.current_timestamp().alias("loaded_at"), board_from_path(path).alias("board"), ingest_date_from_path(path).alias("ingest_date"))
    loaded = spark.sparkContext.accumulator(0)

    def append(batch: DataFrame, number: int) -> None:
        # A batch that is tried again after a failure replaces what it wrote before.
        part = f"{target.rstrip('/')}/batch={number}"
        batch.write.mode("overwrite").parquet(part)
        loaded.add(batch.sparkSession.read.parquet(part).count())

    rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return loaded.value
