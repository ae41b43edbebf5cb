"""Extension points: user functions over batches, gated and checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.masks import both, layered, run_blocks

BatchFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def with_boxes(df: DataFrame, fn: BatchFn, schema: str) -> DataFrame:
    """Run a localizer over Arrow batches; a model is loaded once per task by the function."""
    return df.mapInPandas(fn, schema)


def gated(df: DataFrame, gate: DataFrame, keys: list[str], flag: str, fn: BatchFn, schema: str) -> DataFrame:
    """Run the function only on rows that passed the gate; all others give one empty row each. One pass over the rows."""
    flags = df.join(gate.select(*keys, F.coalesce(F.col(flag), F.lit(False)).alias("_ok")), keys, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped: list[pd.DataFrame] = []

        def passed() -> Iterator[pd.DataFrame]:
            for batch in batches:
                ok = batch["_ok"].fillna(False).astype(bool)
                stopped.append(batch.loc[~ok, keys])
                yield batch.loc[ok].drop(columns="_ok").reset_index(drop=True)

        def empty(left: pd.DataFrame) -> pd.DataFrame:
            rows = left.reindex(columns=names).astype(object)
            return rows.where(rows.notna(), None)

        for found in fn(passed()):
            yield found
            while stopped:
                yield empty(stopped.pop())
        for left in stopped:
            yield empty(left)

    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]
    return flags.mapInPandas(run, schema)


def with_masks(images: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], image: list[str],
               width: str, height: str) -> DataFrame:
    """Run a refiner image by image; it returns runs (image, y, x0, x1) that must fit the image.

    Images are rows, and the function sees one bounded batch at a time. Runs outside
    the image come back with status WRONG_DIMENSIONS instead of being cut.
    """
    fields = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in image)
    schema = f"{fields}, y bigint, x0 bigint, x1 bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    found = images.mapInPandas(run, schema).join(images.select(*image, width, height), image)
    fits = (F.col("y").between(0, F.col(height) - 1) & (F.col("x0") >= 0) & (F.col("x1") <= F.col(width)) & (F.col("x0") < F.col("x1")))
    return found.withColumn("status", F.when(fits, "OK").otherwise("WRONG_DIMENSIONS")).drop(width, height)


def clipped(mask_runs: DataFrame, candidate_blocks: DataFrame, image: list[str]) -> DataFrame:
    """The blocks of refined masks, cut to the candidate boxes (role cand)."""
    blocks = run_blocks(mask_runs, image, "mask").unionByName(candidate_blocks)
    return (layered(blocks, image, ["mask", "cand"]).select(*image, "lv", "bx", "by", "sign", both("mask", "cand").alias("bits"))
            .filter("bits <> 0"))
