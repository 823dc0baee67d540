"""Validation of a folder of files as they come: each file is validated by itself, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.validator import FileResults, Validator


def validate_stream(spark: SparkSession, schema, folder: str, errors_to: str, normalized_to: str, checkpoint: str, files_per_batch: int = 1000, available_now: bool = False) -> StreamingQuery:
    """Starts a query that appends errors and normalised rows, keyed by (file, row, seq), as Parquet. A batch
    that is run again after a failure overwrites its own folder, so nothing comes twice."""
    validator = Validator(schema)

    def each(batch: DataFrame, number: int) -> None:
        # as many names as a batch has files
        files = sorted(r.path for r in batch.select("path").collect())
        if files:
            found = FileResults(validator, batch.sparkSession, files)
            found.errors().write.mode("overwrite").parquet(f"{errors_to}/batch={number}")
            found.normalized().write.mode("overwrite").parquet(f"{normalized_to}/batch={number}")

    source = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    writer = source.select("path").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
