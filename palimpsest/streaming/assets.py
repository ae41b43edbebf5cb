"""New files as a stream, and suppression of repeated content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.sources.assets import SCHEMA, describe


def stream_assets(spark: SparkSession, folder: str, name_glob: str | None = None) -> DataFrame:
    """Files that arrive in a folder, with size, digest and kind."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return describe(reader.load(folder))


def dedupe_assets(stream: DataFrame, digest: str = "sha256", at: str = "modificationTime", delay: str = "1 day") -> DataFrame:
    """One row per digest within the delay; state older than the watermark is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([digest])
