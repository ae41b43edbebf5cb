"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_GROUP = 50_000
ACCURACY = 10_000
MARGIN = 1e-3
CHUNKS = 4_096


def exact_percentiles(df: DataFrame, keys: list[str], values: Mapping[str, Column], p: float) -> DataFrame:
    """Linear-interpolated percentile of several columns per key, equal to a full sort of each group.

    Equal values are counted first. A mergeable sketch then gives two bounds that are
    known to enclose the wanted ranks (its rank error is a tenth of the margin taken);
    only the values between them are ordered, in chunks of the range between the
    bounds. Groups of up to `SMALL_GROUP` values are ordered whole.
    """
    group = [*keys, "_name"]
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), v.cast("double").alias("v")) for n, v in values.items()]))
    rows = df.select(*keys, stacked.alias("_s")).select(*keys, F.col("_s.n").alias("_name"), F.col("_s.v").alias("_v"))
    counted = rows.filter("_v IS NOT NULL").groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    bounds = rows.filter("_v IS NOT NULL").groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", max(0.0, p - MARGIN), ACCURACY).alias("_low"),
        F.percentile_approx("_v", min(1.0, p + MARGIN), ACCURACY).alias("_high"))
    whole = F.col("_n") <= SMALL_GROUP
    place = F.floor(F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low")) * CHUNKS)
    # Values below the bounds are only counted: one row per group takes their place.
    chunk = (F.when(whole, 0).when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), CHUNKS + 1)
             .otherwise(F.coalesce(place, F.lit(0))))
    sized = (counted.join(bounds, group).withColumn("_chunk", chunk.cast("int")).filter(F.col("_chunk") <= CHUNKS)
             .withColumn("_v", F.when(F.col("_chunk") >= 0, F.col("_v")))
             .groupBy(*group, "_n", "_chunk", "_v").agg(F.sum("_c").alias("_c")))
    inside = Window.partitionBy(*group, "_chunk").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumn("_in", F.sum("_c").over(inside))
    earlier = sized.groupBy(*group, "_chunk").agg(F.sum("_c").alias("_t")).select(
        *group, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_pre"))
    ranked = (local.join(earlier, [*group, "_chunk"]).filter("_v IS NOT NULL")
              .withColumn("_upto", F.col("_in") + F.col("_pre")).withColumn("_pos", (F.col("_n") - 1) * F.lit(p)))
    # The wanted ranks, counted from 0, fall into the run of equal values [_upto - _c, _upto).
    low, high = F.floor("_pos"), F.ceil("_pos")
    first = F.col("_upto") - F.col("_c")

    def holds(rank: Column) -> Column:
        return (rank >= first) & (rank < F.col("_upto"))

    ends = ranked.filter(holds(low) | holds(high)).groupBy(*group).agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_b"),
        F.max(F.col("_pos") - low).alias("_w"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")
    return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, value)).alias(n) for n in values])
