"""Validity of regions, masks and proposal boxes: the first failed check gives the code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.boxes import Box, finite, poly_area
from palimpsest.operators.identity import mark_duplicates
from palimpsest.session import room_for

MAX_COVERAGE, MAX_BOXES = 0.30, 100


def leaves(box: Box, width: Column, height: Column) -> Column:
    """Outside the frame, or without positive extent."""
    return ((box.x0 < 0) | (box.y0 < 0) | (box.x1 > width) | (box.y1 > height)
            | (box.x0 >= box.x1) | (box.y0 >= box.y1))


def region_status(regions: DataFrame, frames: DataFrame, page: list[str]) -> DataFrame:
    """INVALID_REGION for unknown pages and non-numbers, PLAN_STALE for another frame or bounds.

    Frames bring `width`, `height` and `frame_id`, one row per page.
    """
    joined = regions.join(frames.select(*page, "width", "height", "frame_id"), page, "left")
    b = Box.of()
    return joined.withColumn(
        "status",
        F.when(F.col("frame_id").isNull(), "INVALID_REGION").when(~finite(*b), "INVALID_REGION")
        .when(~F.col("transform_id").eqNullSafe(F.col("frame_id")) | leaves(b, F.col("width"), F.col("height")),
              "PLAN_STALE").otherwise("OK")).drop("width", "height", "frame_id")


def mask_status(rects: DataFrame, polys: DataFrame, frames: DataFrame, mask: str) -> DataFrame:
    """One code per mask of the frame list: shapes are checked in order, rectangles first.

    `rects` and `polys` carry the mask key, `shape_no` and `transform_id`; polygons
    have `points`. A mask without shapes is invalid.
    """
    b, points = Box.of(), F.col("points")
    other_frame = ~F.col("transform_id").eqNullSafe(F.col("frame_id"))
    sides = frames.select(mask, "width", "height", "frame_id")
    rect = rects.join(sides, mask).select(
        mask, F.lit(0).alias("_kind"), "shape_no",
        F.when(~finite(*b), "INVALID_MASK")
        .when(other_frame | leaves(b, F.col("width"), F.col("height")), "PLAN_STALE").alias("_bad"))
    poly = polys.join(sides, mask).select(
        mask, F.lit(1).alias("_kind"), "shape_no",
        F.when(F.exists(points, lambda p: ~finite(p["x"], p["y"])), "INVALID_MASK")
        .when(other_frame | F.exists(points, lambda p: (p["x"] < 0) | (p["y"] < 0)
                                     | (p["x"] > F.col("width")) | (p["y"] > F.col("height"))), "PLAN_STALE")
        .when(poly_area(points) < 1, "INVALID_MASK").alias("_bad"))
    first = rect.unionByName(poly).groupBy(mask).agg(
        F.count(F.lit(1)).alias("n_shapes"),
        F.min(F.when(F.col("_bad").isNotNull(), F.struct("_kind", "shape_no", "_bad")))["_bad"].alias("_bad"))
    return frames.select(mask).join(first, mask, "left").select(
        mask, F.coalesce("n_shapes", F.lit(0)).alias("n_shapes"),
        F.when(F.col("n_shapes").isNull(), "INVALID_MASK").otherwise(F.coalesce("_bad", F.lit("OK"))).alias("status"))


def redaction_status(regions: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """Regions for execution: unknown pages, bad bounds, and exact duplicates on a page."""
    joined = room_for(regions).join(pages.select(*page, "width", "height"), page, "left")
    marked = mark_duplicates(joined, [*page, "x0", "y0", "x1", "y1"], "_dup")
    return marked.withColumn(
        "status", F.when(F.col("width").isNull(), "UNKNOWN_PAGE").when(F.col("_dup"), "DUPLICATE_REGION")
        .when(leaves(Box.of(), F.col("width"), F.col("height")), "OUT_OF_BOUNDS").otherwise("OK")
    ).drop("width", "height", "_dup")


def box_status(box: Box, label: Column, confidence: Column, width: Column, height: Column) -> Column:
    """First rule a localization box breaks."""
    return (F.when(~finite(*box), "NOT_FINITE")
            .when((box.x0 < 0) | (box.y0 < 0) | (box.x1 <= box.x0) | (box.y1 <= box.y0), "BAD_GEOMETRY")
            .when(F.coalesce(F.length(F.trim(label)) == 0, F.lit(True)), "EMPTY_LABEL")
            .when(~finite(confidence) | ~confidence.between(0, 1), "BAD_CONFIDENCE")
            .when((box.x1 > width) | (box.y1 > height), "LEAVES_IMAGE").otherwise("OK"))


def cap_coverage(boxes: DataFrame, sample: list[str], width: Column, height: Column,
                 max_share: float = MAX_COVERAGE, max_boxes: int = MAX_BOXES) -> DataFrame:
    """Proposal status: samples with too many boxes are refused whole, large boxes are dropped."""
    crowded = (boxes.groupBy(*sample).agg(F.count(F.lit(1)).alias("_n"))
               .filter(F.col("_n") > max_boxes).select(*sample, F.lit(True).alias("_crowded")))
    b = Box.of()
    return boxes.join(crowded, sample, "left").withColumn(
        "status", F.when(F.col("_crowded"), "TOO_MANY_BOXES")
        .when(~finite(*b) | leaves(b, width, height), "INVALID_BOX")
        .when(b.area / (width * height) > max_share, "DROPPED_COVERAGE").otherwise("OK")).drop("_crowded")
