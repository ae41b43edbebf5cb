"""Row identity for tables without a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPY_BLOCK = 10_000


def number_copies(df: DataFrame, columns: list[str], name: str = "copy") -> DataFrame:
    """Give every row a copy number, 0 for the first of its kind.

    Identical rows are first counted (combined before the shuffle) and then written
    out again. A row with very many copies is cut into blocks that are spread over
    the tasks before they unroll, so even a third of the table being copies of one
    row neither meets in one window nor unrolls in one task.
    """
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    few = counted.filter(F.col("_n") <= COPY_BLOCK).select(
        *columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias(name))
    last_block = F.floor((F.col("_n") - 1) / COPY_BLOCK)
    blocks = counted.filter(F.col("_n") > COPY_BLOCK).select(
        *columns, "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)).alias("_block"))
    first = F.col("_block") * COPY_BLOCK
    end = F.least(first + COPY_BLOCK, F.col("_n")) - 1
    many = blocks.repartition(*columns, "_block").select(*columns, F.explode(F.sequence(first, end)).alias(name))
    return few.unionByName(many)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def mark_duplicates(df: DataFrame, keys: list[str], flag: str = "is_duplicate") -> DataFrame:
    """Flag the rows whose key is not unique, by a join with the repeated keys only."""
    repeated = duplicate_keys(df, keys).select(*keys, F.lit(True).alias(flag))
    return df.join(repeated, keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def require_unique(df: DataFrame, keys: list[str], code: str = "DUPLICATE_KEY") -> DataFrame:
    """Pass rows through; fail the job on the first repeated key."""
    marked = mark_duplicates(df, keys, "_dup")
    checked = F.when(F.col("_dup"), F.raise_error(F.lit(code)).cast("boolean")).otherwise(F.lit(True))
    return marked.filter(checked).drop("_dup")


def reject_split(df: DataFrame, status: str = "status", ok: str = "OK") -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the status column, and rejected rows with it."""
    return df.filter(F.col(status) == ok).drop(status), df.filter(F.col(status) != ok)


def strict(df: DataFrame, status: str = "status", ok: str = "OK") -> DataFrame:
    """Fail the job on the first rejected row."""
    passed: Column = F.when(F.col(status) == ok, F.lit(True)).otherwise(
        F.raise_error(F.col(status)).cast("boolean"))
    return df.filter(passed).drop(status)
