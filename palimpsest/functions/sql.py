"""The scores as functions for SQL text, with the same edge cases as the column builders in `measures`."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, result type and body; aggregates over rows are written as functions of their counts.
FUNCTIONS = (
    ("safe_ratio", "n DOUBLE, d DOUBLE, fallback DOUBLE", "DOUBLE", "coalesce(try_divide(n, d), fallback)"),
    ("precision_of", "tp DOUBLE, fp DOUBLE", "DOUBLE", "safe_ratio(tp, tp + fp, 1)"),
    ("recall_of", "tp DOUBLE, fn DOUBLE", "DOUBLE", "safe_ratio(tp, tp + fn, 1)"),
    ("f1_of", "tp DOUBLE, fp DOUBLE, fn DOUBLE", "DOUBLE",
     "safe_ratio(2 * precision_of(tp, fp) * recall_of(tp, fn), precision_of(tp, fp) + recall_of(tp, fn), 0)"),
    ("entropy_of", "counts ARRAY<DOUBLE>", "DOUBLE",
     "coalesce(log2(aggregate(counts, 0D, (a, n) -> a + n)) - aggregate(filter(counts, n -> n > 0), 0D, (a, n) -> a + n * log2(n)) "
     "/ nullif(aggregate(counts, 0D, (a, n) -> a + n), 0), 0)"),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL, those that others build on first; their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
