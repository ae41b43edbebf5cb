"""Comparing two versions of a table without shuffling what they have in common.

Rows are dealt to buckets by their keys. A bucket's digest is its number of rows and the sums of eight 28-bit pieces of the rows' SHA-256
digests, so it does not depend on order, is added up inside the tasks, and counts copies. Two different buckets of one digest
would need eight equal sums of independent pieces, 224 bits together; nothing short of that many tries finds them by chance. Only rows of
buckets that differ are joined. A version is read twice, and of equal buckets only the digests travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.audit import key_diff
from palimpsest.operators.fragments import unchanged
from palimpsest.session import cut_lineage
from palimpsest.sources.report import golden_diff

BUCKETS = 1 << 16  # more than the changes expected, as one changed row makes its whole bucket travel
PIECES = 8


def bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    """The bucket of a row; -1 if one of its keys is null, for rows that are to be joined anyway."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return F.when(known, F.pmod(F.xxhash64(*keys), F.lit(buckets))).otherwise(-1)


def bucket_digests(rows: DataFrame, keys: list[str], values: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, d): rows and digest of every bucket that has rows."""
    hexed = F.sha2(F.to_json(F.struct(*keys, *values)), 256)
    pieces = [F.conv(F.substring("_h", 1 + 7 * i, 7), 16, 10).cast("bigint") for i in range(PIECES)]
    return (rows.select(bucket(keys, buckets).alias("bucket"), hexed.alias("_h")).groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(p) for p in pieces]).alias("d")))


def differing(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The buckets that are not the same on both sides, and -1: one long each, at most `buckets` + 1."""
    sides = bucket_digests(left, keys, values, buckets).unionByName(bucket_digests(right, keys, values, buckets))
    odd = sides.groupBy("bucket").agg(F.count(F.lit(1)).alias("sides"), F.count_distinct("n", "d").alias("kinds"))
    return odd.where("bucket = -1 OR sides < 2 OR kinds > 1").select("bucket")


def within(rows: DataFrame, buckets_of: DataFrame, keys: list[str], buckets: int = BUCKETS, inside: bool = True) -> DataFrame:
    """The rows in (or outside) some buckets. The list of buckets is broadcast, as it has `buckets` + 1 longs at most."""
    listed = F.broadcast(buckets_of.select(F.col("bucket").alias("_bucket")))
    return rows.join(listed, bucket(keys, buckets) == F.col("_bucket"), "left_semi" if inside else "left_anti")


def unchanged_by_digest(before: DataFrame, after: DataFrame, selected: DataFrame, keys: list[str], content: str, buckets: int = BUCKETS) -> DataFrame:
    """The result of `fragments.unchanged` for keys that are unique on each side; what lies in equal buckets without a selected row is not joined."""
    chosen = selected.select(bucket(keys, buckets).alias("bucket"))
    noisy = cut_lineage(differing(before, after, keys, [content], buckets).unionByName(chosen).distinct())

    def noisy_part(df: DataFrame) -> DataFrame:
        return within(df.select(*keys, content), noisy, keys, buckets)

    compared = unchanged(noisy_part(before), noisy_part(after), selected, keys, content)
    quiet = within(before.select(*keys), noisy, keys, buckets, inside=False)
    return compared.unionByName(quiet.withColumn("status", F.lit("UNCHANGED")))


def key_diff_by_digest(expected: DataFrame, actual: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The result of `audit.key_diff`; equal buckets of keys are left out before anything is made distinct."""
    noisy = cut_lineage(differing(expected, actual, keys, [], buckets))
    return key_diff(*[within(side.select(*keys), noisy, keys, buckets) for side in (expected, actual)], keys)


def golden_diff_by_digest(recomputed: DataFrame, stored: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The result of `report.golden_diff`, copies counted; `keys` deal the rows to buckets and need not be unique."""
    values = [c for c in stored.columns if c not in keys]
    noisy = cut_lineage(differing(recomputed, stored, keys, values, buckets))
    return golden_diff(*[within(side.select(*stored.columns), noisy, keys, buckets) for side in (recomputed, stored)])
