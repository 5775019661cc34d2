"""Incremental runs: new files of a folder through the same transforms as a batch, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def follow_folder(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Appends transform(new files) to Parquet at out, batch by batch, until all present files are done.

    A batch that runs again after a failure replaces what it wrote, as each has a folder of its own.
    """
    files = spark.readStream.schema(FILES).format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(path)

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
