"""Decoded pictures as pixel rows or gray arrays (formats of the built-in image source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with status OK, or IMAGE_UNREADABLE and no size for what cannot be decoded."""
    rows = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    good = F.coalesce(F.col("width") > 0, F.lit(False))
    return rows.select(F.col("origin").alias("image_id"), *[F.when(good, F.col(c)).alias(c) for c in ("width", "height", "nChannels", "data")],
                       F.when(good, "OK").otherwise("IMAGE_UNREADABLE").alias("status"))


def channel(pos: Column, offset: Column | int) -> Column:
    """One byte of the picture data; channels are stored blue, green, red."""
    at = pos * F.col("nChannels") + offset + 1
    return F.conv(F.hex(F.substring(F.col("data"), at.cast("int"), F.lit(1))), 16, 10).cast("int")


def rgb(pos: Column) -> tuple[Column, Column, Column]:
    colour = F.col("nChannels") >= 3
    blue = channel(pos, 0)
    return F.when(colour, channel(pos, 2)).otherwise(blue), F.when(colour, channel(pos, 1)).otherwise(blue), blue


def luma(r: Column, g: Column, b: Column) -> Column:
    """Gray value with the usual 14-bit weights, rounded."""
    return F.shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14)


def scan_pixels(images: DataFrame) -> DataFrame:
    """One row per pixel with colours and gray value."""
    pixels = images.where("status = 'OK'").withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    r, g, b = rgb(F.col("pos"))
    placed = pixels.select("image_id", "width", F.col("pos"), r.alias("r"), g.alias("g"), b.alias("b"))
    return placed.select("image_id", F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), (F.col("pos") % F.col("width")).alias("x"),
                         "r", "g", "b", luma(F.col("r"), F.col("g"), F.col("b")).alias("gray"))


def gray_arrays(images: DataFrame) -> DataFrame:
    """Pictures with their gray values as an array in row order, for the tile operators."""
    gray = F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda pos: luma(*rgb(pos)))
    return images.where("status = 'OK'").select("image_id", "width", "height", gray.alias("gray"))
