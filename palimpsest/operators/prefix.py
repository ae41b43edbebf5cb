"""Running values over ordered groups of any size.

A plain window puts a whole group into one task. Here the order key is cut into
chunks by a rule on its value, each chunk gets its own window, and what the
earlier chunks contribute is carried in from a table of chunk totals. The chunk
is computed from the row alone or, without a rule, by range partitions that are written once, so a task that is
run again gives the same answer.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import cut_lineage

CHUNK = 65_536
MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def chunk_of(position: Column, size: int = CHUNK) -> Column:
    """Chunk number of an integer position."""
    return F.floor(position / size)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    chunk: Column | None,
    values: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
    whole: int = CHUNK,
) -> DataFrame:
    """Add running aggregates per key.

    Without a chunk rule keys of up to CHUNK rows, counted first, have a plain window. The rows of larger keys are range-partitioned by key and
    order, from a sample, and written once; a partition is a chunk then. That follows any distribution but equal order values.

    `values` maps an output name to ("sum" | "max" | "min", expression). `chunk`
    must not decrease along `order`. Without rows before it, a sum is 0 and a
    max or min is null when the current row is excluded.
    """
    if chunk is None and keys:
        large = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > whole).select(
            *[F.col(k).alias(f"_{k}") for k in keys]))
        if large.isEmpty():
            return _windowed(df, keys, order, values, inclusive)
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        usual = _windowed(df.join(large, same, "left_anti"), keys, order, values, inclusive)
        return usual.unionByName(_chunked(df.join(large, same, "left_semi"), keys, order, None, values, inclusive))
    return _chunked(df, keys, order, chunk, values, inclusive)


def _windowed(df: DataFrame, keys: list[str], order: list[Column], values: Mapping[str, tuple[str, Column]], inclusive: bool) -> DataFrame:
    """Running aggregates of keys that fit in a task."""
    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = {name: MERGE[kind](value).over(rows) for name, (kind, value) in values.items()}
    return df.select("*", *[(F.coalesce(v, F.lit(0)) if values[name][0] == "sum" else v).alias(name) for name, v in out.items()])


def _chunked(df: DataFrame, keys: list[str], order: list[Column], chunk: Column | None, values: Mapping[str, tuple[str, Column]],
             inclusive: bool) -> DataFrame:
    """Running aggregates chunk by chunk, with what earlier chunks contribute."""
    if chunk is None:
        ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
        source = cut_lineage(ranged.withColumn("_chunk", F.spark_partition_id()))
    else:
        source = df.withColumn("_chunk", chunk)
    inside = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = source.select(
        "*", *[MERGE[kind](value).over(inside).alias(f"_in_{name}") for name, (kind, value) in values.items()]
    )
    before = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    totals = source.groupBy(*keys, "_chunk").agg(
        *[MERGE[kind](value).alias(f"_all_{name}") for name, (kind, value) in values.items()]
    )
    carried = totals.select(
        *keys, "_chunk",
        *[MERGE[kind](F.col(f"_all_{name}")).over(before).alias(f"_pre_{name}")
          for name, (kind, _) in values.items()],
    )
    joined = local.join(carried, [*keys, "_chunk"], "left")
    combined = []
    for name, (kind, _) in values.items():
        own, earlier = F.col(f"_in_{name}"), F.col(f"_pre_{name}")
        if kind == "sum":
            value = F.coalesce(own, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        else:
            value = (F.greatest if kind == "max" else F.least)(own, earlier)
        combined.append(value.alias(name))
    return joined.select(*df.columns, *combined)


def numbered(df: DataFrame, keys: list[str], order: list[Column], chunk: Column | None, name: str) -> DataFrame:
    """Zero-based row number per key."""
    return running(df, keys, order, chunk, {name: ("sum", F.lit(1))}, inclusive=False)
