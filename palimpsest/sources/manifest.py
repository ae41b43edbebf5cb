"""Corpus and prediction files: one JSON object with a version and a list of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def read_manifest(spark: SparkSession, path: str, sample: str, header: str | None = None, rows: str = "samples") -> DataFrame:
    """The rows of manifest files with a status per file.

    `sample` is the schema of one row, `header` an optional "name struct<...>" field that
    is repeated on each row. A file that cannot be read, has another version or no rows
    gives one row with its status and null fields.
    """
    extra = f", {header}" if header else ""
    schema = f"schema_version int{extra}, {rows} array<struct<{sample}>>, _corrupt string"
    files = (spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("file_path", F.input_file_name()))
    status = (F.when(F.col("_corrupt").isNotNull(), "INVALID_JSON")
              .when(~F.col("schema_version").eqNullSafe(F.lit(VERSION)), "UNSUPPORTED_SCHEMA")
              .when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "EMPTY_CORPUS").otherwise("OK"))
    usable = F.when(status == "OK", F.col(rows))
    kept = [header.split()[0]] if header else []
    return (files.select("file_path", *kept, status.alias("status"), F.posexplode_outer(usable).alias("row_no", "_s"))
            .select("file_path", *kept, "status", "row_no", "_s.*"))
