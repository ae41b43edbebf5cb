"""Raw pages as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: default cap on the bytes of one page.
MAX_BYTES = 512 * 1024


def page_cap(body: Column, max_bytes: int = MAX_BYTES) -> Column:
    return F.when(body.isNull() | (F.octet_length(body) == 0), "EMPTY").when(
        F.octet_length(body) > max_bytes, "RESPONSE_TOO_LARGE").otherwise("OK")


def scan_pages(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Page files decoded as UTF-8 with replacement; too large files keep their row without a body."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    body = F.when(F.col("length") <= max_bytes, F.make_valid_utf8(F.col("content").cast("string")))
    status = F.when(F.col("length") > max_bytes, "RESPONSE_TOO_LARGE").otherwise("OK")
    return files.select("path", F.col("length").alias("size_bytes"), body.alias("html"), status.alias("status"))
