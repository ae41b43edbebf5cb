"""Stored records: JSON columns, and tables that may gain columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_record(df: DataFrame, column: str, schema: str, name: str) -> DataFrame:
    """Decode a JSON text column; malformed text gives null fields instead of an error."""
    return df.withColumn(name, F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}))


def decode_variant(df: DataFrame, column: str, fields: dict[str, tuple[str, str]], status: str = "record_status") -> DataFrame:
    """Fields of JSON records whose shape differs from version to version, read from one parsed VARIANT.

    `fields` gives name: (path, type), such as {"k": ("$.k", "bigint")}. A field that a record lacks, or holds in a form that
    the type cannot take, is null. The status is OK, EMPTY for a null text and MALFORMED for text that is no JSON; none of them fails the job.
    """
    record = F.try_parse_json(F.col(column))
    parsed = df.withColumn("_record", record)
    state = F.when(F.col(column).isNull(), "EMPTY").when(F.col("_record").isNull(), "MALFORMED").otherwise("OK")
    values = {name: F.try_variant_get(F.col("_record"), path, kind) for name, (path, kind) in fields.items()}
    return parsed.withColumns({**values, status: state}).drop("_record")


def record_schema(df: DataFrame, column: str) -> DataFrame:
    """One row (record_schema, n_records, n_malformed): the shape that covers all records of a JSON column."""
    record = F.try_parse_json(F.col(column))
    return df.agg(F.schema_of_variant_agg(record).alias("record_schema"), F.count(record).alias("n_records"),
                  F.count_if(F.col(column).isNotNull() & record.isNull()).alias("n_malformed"))


def save(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """Append rows to a parquet table; later writes may bring more columns."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read a table with the union of the columns ever written; older rows have nulls."""
    return spark.read.option("mergeSchema", "true").parquet(path)
