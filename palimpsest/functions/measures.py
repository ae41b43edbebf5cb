"""Guarded ratios, scores and small numeric rules, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, default: float = 1.0) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(default))


def prf_cols(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall (1 on an empty denominator) and F1 (0 when both are 0)."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": ratio(precision * recall * 2, precision + recall, 0.0),
    }


def entropy_cols(n: Column) -> Column:
    """Base-2 entropy over histogram rows with counts `n`, as an aggregate: log2 N - sum(n log2 n) / N; 0 without rows. Rows without count add nothing."""
    total = F.sum(F.when(n > 0, n))
    return F.coalesce(F.log2(total) - F.sum(F.when(n > 0, n * F.log2(n))) / total, F.lit(0.0))


def correction_reduction(candidate: Column, refined: Column) -> Column:
    """Share of correction work saved, clamped to [0, 1]; without any work to do, 1."""
    saved = F.lit(1.0) - F.try_divide(refined, candidate)
    return (F.when(candidate == 0, F.when(refined == 0, 1.0).otherwise(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), saved))))


def elapsed_seconds(start: Column, end: Column, is_open: Column, now: Column) -> Column:
    """Seconds from start to end; an open row runs until `now`; never negative."""
    stop = F.when(is_open, now).otherwise(end)
    return F.greatest((F.unix_micros(stop) - F.unix_micros(start)) / F.lit(1_000_000.0), F.lit(0.0))


def declared_dimension(text: Column, limit: int = 100_000) -> Column:
    """ASCII digits with a value in 1..limit, else null."""
    value = F.when(text.rlike(r"^[0-9]+$"), text.try_cast("bigint"))
    return F.when((value > 0) & (value <= limit), value)


def orientation(value: Column) -> Column:
    """EXIF orientation, 1 where absent or out of range."""
    return F.when(value.between(1, 8), value).otherwise(1)


def display_dims(width: Column, height: Column, turn: Column) -> tuple[Column, Column]:
    swapped = orientation(turn).between(5, 8)
    return F.when(swapped, height).otherwise(width), F.when(swapped, width).otherwise(height)


def grade(masked_mae: Column) -> Column:
    return (F.when(masked_mae <= 5, "excellent").when(masked_mae <= 15, "good")
            .when(masked_mae <= 30, "review").otherwise("poor"))


def structure_status(source: Column, output: Column) -> Column:
    """How a structure count changed between source and output; null means the probe failed."""
    return (F.when(source.isNull() | output.isNull(), "unavailable")
            .when((source == 0) & (output == 0), "absent")
            .when(source == output, "count_unchanged")
            .when((source > 0) & (output == 0), "removed")
            .when(output < source, "count_reduced")
            .when(source == 0, "created")
            .otherwise("count_increased"))
