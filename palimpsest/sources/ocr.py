"""Recognised words from tab-separated OCR output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_CONFIDENCE = 30


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The raw columns as text, with the file they came from."""
    return (spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
            .withColumn("file", F.input_file_name()))


def ocr_words(rows: DataFrame, pixel_w: Column, pixel_h: Column, page_w: Column, page_h: Column,
              keep: list[str], min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Non-blank words of enough confidence with a positive box, scaled to page units."""
    n = {c: F.col(c).try_cast("double") for c in ("left", "top", "width", "height", "conf")}
    text = F.trim("text")
    wanted = (F.length(text) > 0) & (n["conf"] >= min_confidence) & (n["width"] > 0) & (n["height"] > 0)
    readable = n["left"].isNotNull() & n["top"].isNotNull()
    return rows.filter(wanted & readable).select(
        *keep, text.alias("text"), (n["left"] / pixel_w * page_w).alias("x0"), (n["top"] / pixel_h * page_h).alias("y0"),
        ((n["left"] + n["width"]) / pixel_w * page_w).alias("x1"), ((n["top"] + n["height"]) / pixel_h * page_h).alias("y1"))
