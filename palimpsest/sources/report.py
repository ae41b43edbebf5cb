"""Report sink and the check of a stored report against a recomputed one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str) -> None:
    """Write rows as JSON documents, one file per task."""
    df.write.mode("overwrite").json(path)


def golden_diff(recomputed: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows found on one side only, counting copies. Empty means the stored report is current."""
    columns = stored.columns
    fresh = recomputed.select(*columns)
    return (stored.exceptAll(fresh).withColumn("status", F.lit("ONLY_STORED"))
            .unionByName(fresh.exceptAll(stored).withColumn("status", F.lit("ONLY_RECOMPUTED"))))


def check_golden(recomputed: DataFrame, stored: DataFrame) -> None:
    """Refuse a stale stored report."""
    if not golden_diff(recomputed, stored).isEmpty():
        raise ValueError("STALE_REPORT")
