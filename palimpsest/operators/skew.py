"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import cut_lineage

BLOCK = 8_000
SALTS = ["_ls", "_rs"]


def spread(left: DataFrame, right: DataFrame, keys: list[str], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Add salt columns `_ls` and `_rs`, so that a crowded key is shared by many tasks.

    Where the rows of a key on both sides make more than block x block comparisons, each
    side is cut into groups of about `block` rows, and every left group meets every right
    group exactly once: a left row is repeated per right group and the other way round.
    Other keys stay as they are; the sizes are measured first, and without crowded keys
    nothing is added to the plan. Salts are hashes of the row, so repeated tasks agree on
    them, and the table of crowded keys is small because each of them has many rows.
    """
    def rows(df: DataFrame, mine: int) -> DataFrame:
        return df.select(*keys, F.lit(mine).alias("_l"), F.lit(1 - mine).alias("_r"))

    def groups(name: str) -> Column:
        return F.ceil(F.col(name) / block).cast("int")

    sizes = rows(left, 1).unionByName(rows(right, 0)).groupBy(*keys).agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"))
    crowded = cut_lineage(sizes.filter(F.col("_nl").cast("double") * F.col("_nr") > float(block) * block)
                          .select(*keys, groups("_nl").alias("_gl"), groups("_nr").alias("_gr")))
    if crowded.isEmpty():
        return tuple(df.withColumns({salt: F.lit(0) for salt in SALTS}) for df in (left, right))

    def salted(df: DataFrame, own: str, own_groups: str, other: str, other_groups: str) -> DataFrame:
        mine, others = F.coalesce(F.col(own_groups), F.lit(1)), F.coalesce(F.col(other_groups), F.lit(1))
        return (df.join(crowded, keys, "left").withColumn(own, F.pmod(F.xxhash64(*df.columns), mine).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), others - 1))).drop("_gl", "_gr"))

    return salted(left, "_ls", "_gl", "_rs", "_gr"), salted(right, "_rs", "_gr", "_ls", "_gl")
