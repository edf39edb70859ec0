"""Incremental ingestion (an extension): new files only, each batch written once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillstone.sources.documents import extract_pages


def stream(spark: SparkSession, directory: str, out: str, checkpoint: str, extractor=None, pattern: str = "*.[pP][dD][fF]"):
    """A streaming query over the files of a folder.

    Pages go to ``out`` by batch (``batch=N``).  A batch that is run again after a
    failure overwrites its own folder, so each file's pages stand there once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(directory)

    def write(batch, number):
        pages = extract_pages(batch.select(F.col("path").alias("filepath"), "content"), extractor)
        pages.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_once(spark: SparkSession, directory: str, out: str, checkpoint: str, extractor=None) -> None:
    """All files that have come since the last run, then stop."""
    stream(spark, directory, out, checkpoint, extractor).trigger(availableNow=True).start().awaitTermination()
