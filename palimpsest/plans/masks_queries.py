"""Queries over masks as pixel blocks and over merged intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.measures import correction_reduction
from palimpsest.operators import masks
from palimpsest.operators.audit import gates
from palimpsest.plans.registry import Tables, query
from palimpsest.plans.roles import BOXES, CANDIDATES, boxes, candidates

WIDTH, HEIGHT = 50, 40
IMAGE = ["page"]


def blocks(df: DataFrame, role) -> DataFrame:
    return masks.rect_blocks(df, IMAGE, F.lit(WIDTH), F.lit(HEIGHT), role)


def per_page(shapes: DataFrame, role, solve) -> DataFrame:
    return masks.per_image(shapes, IMAGE, F.lit(WIDTH), F.lit(HEIGHT), role, solve)


def marks(t: Tables, role) -> DataFrame:
    """Boxes with their role, and candidates."""
    return boxes(t).withColumn("role", role).drop("line").unionByName(candidates(t).withColumn("role", F.lit("cand")))


PIXELS = f"""
grid AS (SELECT gx.x, gy.y FROM (SELECT unnest(range(0, {WIDTH})) AS x) gx, (SELECT unnest(range(0, {HEIGHT})) AS y) gy),
px AS (SELECT page, line, x, y FROM boxes JOIN grid ON x >= x0 AND x < x1 AND y >= y0 AND y < y1)
"""


@query("mask_algebra", f"""
WITH {BOXES}, {PIXELS},
m AS (SELECT DISTINCT page, x, y FROM px WHERE line % 2 = 1), p AS (SELECT DISTINCT page, x, y FROM px WHERE line % 2 = 0),
e AS (SELECT * FROM m EXCEPT SELECT * FROM p)
SELECT page, count(*) AS effective_pixels, CAST(sum(y * 1000 + x) AS BIGINT) AS position_sum FROM e GROUP BY page""")
def mask_algebra(t: Tables) -> DataFrame:
    """Odd lines are masked, even lines protected; pixels left per order and a sum of their positions."""
    role = F.when(F.col("line") % 2 == 1, "mask").otherwise("protect")
    return per_page(boxes(t), role, lambda b, top: masks.coordinate_sums(masks.effective(b, IMAGE, top=top), IMAGE)).select(
        "page", F.col("pixels").alias("effective_pixels"), (F.col("y_sum") * 1000 + F.col("x_sum")).alias("position_sum"))


@query("mask_polygons", f"""
WITH {BOXES}, {PIXELS},
l AS (SELECT page, x0, y0, x1, y1, (x0 + x1) // 2 AS xm, (y0 + y1) // 2 AS ym FROM boxes WHERE line % 2 = 1),
m AS (SELECT DISTINCT page, x, y FROM l JOIN grid ON x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 AND (y <= ym OR x <= xm)),
e AS (SELECT * FROM m EXCEPT SELECT DISTINCT page, x, y FROM px WHERE line % 2 = 0)
SELECT page, count(*) AS effective_pixels FROM e GROUP BY page""")
def mask_polygons(t: Tables) -> DataFrame:
    """L-shaped masks in the boxes of odd lines, outline included, without the pixels that even lines protect."""
    def corner(x: str, y: str):
        return F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))

    xm, ym = "floor((x0 + x1) / 2)", "floor((y0 + y1) / 2)"
    shape = F.array(*[corner(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", ym), (xm, ym), (xm, "y1"), ("x0", "y1"))])
    polys = boxes(t).filter("line % 2 = 1").select("page", shape.alias("points"))
    protect = boxes(t).filter("line % 2 = 0")
    shapes = masks.polygon_blocks(polys, IMAGE, F.lit(WIDTH), F.lit(HEIGHT), "mask").unionByName(blocks(protect, "protect"))
    top = masks.rect_top(protect, F.lit(WIDTH), F.lit(HEIGHT))
    return masks.coordinate_sums(masks.effective(shapes, IMAGE, top=top), IMAGE).select("page", F.col("pixels").alias("effective_pixels"))


@query("mask_clip", f"""
WITH {BOXES}, {CANDIDATES}, {PIXELS},
c AS (SELECT page, x, y FROM cands JOIN grid ON x >= x0 AND x < x1 AND y >= y0 AND y < y1)
SELECT page, count(*) AS clipped_pixels FROM (SELECT DISTINCT page, x, y FROM px) SEMI JOIN c USING (page, x, y) GROUP BY page""")
def mask_clip(t: Tables) -> DataFrame:
    """Pixels of an order's lines that lie in its candidate box."""
    return per_page(marks(t, F.lit("mask")), F.col("role"), lambda b, top: masks.set_sizes(
        b, IMAGE, ["mask", "cand"], {"clipped_pixels": masks.both("mask", "cand")}, top)).filter("clipped_pixels > 0")


@query("xor_size", f"""
WITH {BOXES}, {PIXELS},
f AS (SELECT page, x, y, bool_or(line = 1) AS a, bool_or(line <> 1) AS b FROM px GROUP BY ALL)
SELECT page, count(*) FILTER (a <> b) AS xor_pixels FROM f GROUP BY page""")
def xor_size(t: Tables) -> DataFrame:
    return per_page(boxes(t), F.when(F.col("line") == 1, "a").otherwise("b"), lambda b, top: masks.set_sizes(
        b, IMAGE, ["a", "b"], {"xor_pixels": F.col("a").bitwiseXOR(F.col("b"))}, top))


MASK_SCORE = f"""
{PIXELS},
c AS (SELECT page, x, y FROM cands JOIN grid ON x >= x0 AND x < x1 AND y >= y0 AND y < y1),
f AS (SELECT page, x, y, bool_or(role = 't') AS t, bool_or(role = 'p') AS p, bool_or(role = 'c') AS c FROM (
  SELECT page, x, y, CASE WHEN line = 1 THEN 't' ELSE 'p' END AS role FROM px UNION ALL SELECT page, x, y, 'c' FROM c) GROUP BY page, x, y),
s AS (SELECT page, count(*) FILTER (t AND p) AS true_positive_pixels, count(*) FILTER (p AND NOT t) AS false_positive_pixels,
  count(*) FILTER (t AND NOT p) AS false_negative_pixels, count(*) FILTER (c <> t) AS candidate_correction_pixels,
  count(*) FILTER (p <> t) AS refined_correction_pixels, count(*) FILTER (p AND NOT c) AS outside_candidate_pixels FROM f GROUP BY page)
"""
RATES = """
round(CASE WHEN true_positive_pixels + false_positive_pixels + false_negative_pixels = 0 THEN 1 ELSE true_positive_pixels / (true_positive_pixels + false_positive_pixels + false_negative_pixels) END, 6) AS iou,
round(CASE WHEN true_positive_pixels + false_positive_pixels = 0 THEN 1 ELSE true_positive_pixels / (true_positive_pixels + false_positive_pixels) END, 6) AS precision,
round(CASE WHEN true_positive_pixels + false_negative_pixels = 0 THEN 1 ELSE true_positive_pixels / (true_positive_pixels + false_negative_pixels) END, 6) AS recall,
round(CASE WHEN candidate_correction_pixels = 0 THEN CASE WHEN refined_correction_pixels = 0 THEN 1.0 ELSE 0.0 END
  ELSE greatest(0.0, least(1.0, 1 - refined_correction_pixels / candidate_correction_pixels)) END::DOUBLE, 6) AS correction_reduction
"""


def scored(t: Tables) -> DataFrame:
    shapes = marks(t, F.when(F.col("line") == 1, "truth").otherwise("pred"))
    return per_page(shapes, F.col("role"), lambda b, top: masks.mask_score(b, IMAGE, top))


@query("mask_score", f"WITH {BOXES}, {CANDIDATES}, {MASK_SCORE} SELECT *, {RATES} FROM s")
def mask_score(t: Tables) -> DataFrame:
    """First lines = truth, other lines = prediction, the order's box = candidate."""
    return scored(t)


@query("correction_reduction", """
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN (l_suppkey % 5) = 0 THEN CASE WHEN (l_partkey % 7) = 0 THEN 1.0 ELSE 0.0 END
 ELSE round(greatest(0.0, least(1.0, 1 - (l_partkey % 7) / (l_suppkey % 5))), 6) END AS DOUBLE) AS reduction FROM lineitem""")
def correction_reduction_query(t: Tables) -> DataFrame:
    value = correction_reduction(F.col("l_suppkey") % 5, F.col("l_partkey") % 7)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(value, 6).alias("reduction"))


GATE_NAMES = {"iou": 0.75, "precision": 0.8, "recall": 0.8, "correction_reduction": 0.25, "sample_count": 8}


@query("gates", f"""
WITH {BOXES}, {CANDIDATES}, {MASK_SCORE},
tot AS (SELECT count(*) AS sample_count, """ + ", ".join(f"sum({n})::BIGINT AS {n}" for n in (
    "true_positive_pixels", "false_positive_pixels", "false_negative_pixels", "candidate_correction_pixels",
    "refined_correction_pixels", "outside_candidate_pixels")) + f""" FROM s),
r AS (SELECT *, {RATES} FROM tot)
SELECT gate, round(value, 6) AS value, threshold, passed FROM (
  SELECT 'iou' AS gate, iou AS value, 0.75::DOUBLE AS threshold, iou >= 0.75 AS passed FROM r
  UNION ALL SELECT 'precision', precision, 0.8, precision >= 0.8 FROM r UNION ALL SELECT 'recall', recall, 0.8, recall >= 0.8 FROM r
  UNION ALL SELECT 'correction_reduction', correction_reduction, 0.25, correction_reduction >= 0.25 FROM r
  UNION ALL SELECT 'sample_count', sample_count, 8, sample_count >= 8 FROM r
  UNION ALL SELECT 'outside_candidate_pixels', outside_candidate_pixels, 0, outside_candidate_pixels = 0 FROM r)""")
def gates_query(t: Tables) -> DataFrame:
    """Micro totals over all masks against the default gates, one row per gate."""
    return gates(masks.mask_totals(scored(t)), GATE_NAMES, {"outside_candidate_pixels": 0})


@query("merge_intervals", f"""
WITH {BOXES},
p AS (SELECT page, x0, x1, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM boxes),
g AS (SELECT *, sum(CASE WHEN reached IS NULL OR x0 > reached THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM p)
SELECT page, min(x0) AS start, max(x1) AS "end" FROM g GROUP BY page, island""")
def merge_intervals(t: Tables) -> DataFrame:
    """Merged horizontal extents per order."""
    spans = boxes(t).select("page", F.col("x0").alias("start"), F.col("x1").alias("end"))
    return masks.merge_intervals(spans, ["page"])


@query("coverage_area", f"""
WITH {BOXES}, {PIXELS}, f AS (SELECT page, x, y, bool_or(line <> 2) AS m, bool_or(line = 2) AS p FROM px GROUP BY page, x, y)
SELECT page, count(*) FILTER (m) AS union_area, count(*) FILTER (m AND NOT p) AS effective_area FROM f GROUP BY page""")
def coverage_area(t: Tables) -> DataFrame:
    """Union of an order's boxes, and the same without what its second lines protect."""
    return masks.coverage(boxes(t), IMAGE, F.lit(WIDTH), F.lit(HEIGHT), F.col("line") == 2)
