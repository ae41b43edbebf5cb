"""Package parts as rows, from a table of unpacked parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators.packages import select_parts

SCHEMA = "asset string, part_name string, size_bytes bigint, encrypted boolean, xml string"


def scan_parts(spark: SparkSession, path: str) -> DataFrame:
    """All parts of all packages."""
    return spark.read.schema(SCHEMA).parquet(path)


def scan_header_parts(spark: SparkSession, path: str) -> DataFrame:
    """Header and footer parts only; the name pattern is applied at the scan."""
    return select_parts(scan_parts(spark, path))
