"""Joins of many rows with a table of one row per key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000  # a key with more than 1/HOT of all rows is hot, so fewer than HOT keys can be


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """`rows` with the columns of `table` (one row per value of `key`) beside them; every row must have its key there.

    `count` is the column of `table` with the number of rows of a key, `total` the sum of it. Hot keys, fewer than
    HOT by their definition, are broadcast and leave the shuffle, whose largest key then has 1/HOT of the rows.
    A null key is a key like others. Both inputs are read twice: pass written tables.
    """
    rest = [c for c in table.columns if c not in (key, count)]
    table = table.select(F.col(key).alias("__key"), count, *rest)
    hot = table.where(F.col(count) > F.lit(total) / HOT)
    cold = table.where(F.col(count) <= F.lit(total) / HOT)
    same = F.col(key).eqNullSafe(F.col("__key"))
    many = rows.join(F.broadcast(hot), same).drop("__key", count)
    few = rows.join(F.broadcast(hot.select("__key")), same, "left_anti").join(cold, same).drop("__key", count)
    return many.unionByName(few)
