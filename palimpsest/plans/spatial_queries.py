"""Queries over boxes: validity, overlap, matching and confirmation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import boxes as geo
from palimpsest.functions.boxes import Box
from palimpsest.functions.ids import transform_id
from palimpsest.operators import audit, matching, overlap, regions
from palimpsest.plans.registry import Tables, query
from palimpsest.plans.roles import (
    BOXES, CANDIDATES, FRAMES, KNOWN, PAIR_AREA, PAIR_IOU, PAIR_OVERLAP, boxes, candidates, frames, identified, placed)
from palimpsest.session import cut_lineage, room_for


LEAVES = "(x0 < 0 OR y0 < 0 OR x1 > width OR y1 > height OR x0 >= x1 OR y0 >= y1)"


@query("region_status", f"""
WITH {BOXES}, {FRAMES},
s AS (SELECT page, line, y0, x1, y1, CASE WHEN f.width IS NULL OR l_quantity = 50 THEN 'INVALID_REGION'
  WHEN l_tax > 0.07 OR {LEAVES} THEN 'PLAN_STALE' ELSE 'OK' END AS status
  FROM boxes LEFT JOIN (SELECT page, width, height FROM frames WHERE o_orderstatus <> 'P') f USING (page))
SELECT * FROM s""")
def region_status(t: Tables) -> DataFrame:
    """Orders in process have no frame, quantity 50 gives a non-number, high tax another frame."""
    frame_id = transform_id(F.col("page"), F.col("width"), F.col("height"), F.lit(0), F.lit(0), F.lit(0))
    known = frames(t, "o_orderstatus").filter("o_orderstatus <> 'P'").withColumn("frame_id", frame_id)
    rows = boxes(t, "l_quantity", "l_tax").join(
        known.select("page", F.col("frame_id").alias("_own")), "page", "left")
    rows = (rows.withColumn("transform_id", F.when(F.col("l_tax") > 0.07, "older").otherwise(F.col("_own")))
            .withColumn("x0", F.when(F.col("l_quantity") == 50, F.lit(float("nan"))).otherwise(F.col("x0").cast("double"))))
    checked = regions.region_status(rows, known, ["page"])
    return checked.select("page", "line", "y0", "x1", "y1", "status")


@query("mask_status", f"""
WITH {BOXES}, {FRAMES},
s AS (SELECT page, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS kind, l_extendedprice AS shape_no,
  CASE WHEN l_returnflag = 'A' AND (x0 > width OR x1 > width OR y1 > height) THEN 'PLAN_STALE'
       WHEN l_returnflag = 'A' AND line = 7 THEN 'INVALID_MASK'
       WHEN l_returnflag <> 'A' AND {LEAVES} THEN 'PLAN_STALE' END AS bad
  FROM boxes JOIN frames USING (page)),
g AS (SELECT page, count(*) AS n_shapes, arg_min(bad, (kind, shape_no)) FILTER (bad IS NOT NULL) AS bad FROM s GROUP BY page)
SELECT page, coalesce(n_shapes, 0) AS n_shapes, CASE WHEN n_shapes IS NULL THEN 'INVALID_MASK' ELSE coalesce(bad, 'OK') END AS status
FROM frames LEFT JOIN g USING (page)""")
def mask_status(t: Tables) -> DataFrame:
    """Returned lines are triangles (flat ones on line 7), the others rectangles; order = mask."""
    shapes = boxes(t, "l_returnflag", F.col("l_extendedprice").alias("shape_no"), F.lit("f").alias("transform_id"))
    top = F.when(F.col("line") == 7, F.col("y0")).otherwise(F.col("y1")).cast("double")

    def point(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    points = F.array(point(F.col("x0"), F.col("y0")), point(F.col("x1"), F.col("y0")), point(F.col("x0"), top))
    # A flat triangle still counts its corner for the frame check, as the SQL twin does.
    points = F.when(F.col("line") == 7, F.array(
        point(F.col("x0"), F.col("y1")), point(F.col("x1"), F.col("y1")), point(F.col("x0"), F.col("y1")))).otherwise(points)
    rects = shapes.filter("l_returnflag <> 'A'").drop("l_returnflag")
    polys = shapes.filter("l_returnflag = 'A'").select("page", "shape_no", "transform_id", points.alias("points"))
    return regions.mask_status(rects, polys, frames(t).withColumn("frame_id", F.lit("f")), "page")


@query("redaction_dups", f"""
WITH {BOXES}, {FRAMES}
SELECT page, line, x0, y0, x1, y1, CASE WHEN width IS NULL THEN 'UNKNOWN_PAGE'
  WHEN count(*) OVER (PARTITION BY page, x0, y0, x1, y1) > 1 THEN 'DUPLICATE_REGION'
  WHEN {LEAVES} THEN 'OUT_OF_BOUNDS' ELSE 'OK' END AS status
FROM boxes LEFT JOIN (SELECT page, width, height FROM frames WHERE o_orderstatus <> 'P') f USING (page)""")
def redaction_dups(t: Tables) -> DataFrame:
    known = frames(t, "o_orderstatus").filter("o_orderstatus <> 'P'")
    return regions.redaction_status(boxes(t), known, ["page"])


@query("box_status", f"""
WITH {BOXES}, {FRAMES}
SELECT page, line, x0, y0, x1, y1, CASE WHEN trim(CASE WHEN l_returnflag = 'N' AND l_quantity < 3 THEN ' ' ELSE l_returnflag END) = '' THEN 'EMPTY_LABEL'
  WHEN l_discount * 11 > 1 THEN 'BAD_CONFIDENCE' WHEN x1 > width OR y1 > height THEN 'LEAVES_IMAGE' ELSE 'OK' END AS status
FROM boxes JOIN frames USING (page)""")
def box_status(t: Tables) -> DataFrame:
    rows = boxes(t, "l_discount", "l_returnflag", "l_quantity").join(frames(t), "page")
    label = F.when((F.col("l_returnflag") == "N") & (F.col("l_quantity") < 3), " ").otherwise(F.col("l_returnflag"))
    status = regions.box_status(Box.of(), label, F.col("l_discount") * 11, F.col("width"), F.col("height"))
    return rows.select("page", "line", "x0", "y0", "x1", "y1", status.alias("status"))


@query("coverage_cap", f"""
WITH {BOXES}, n AS (SELECT page, count(*) AS c FROM boxes GROUP BY page)
SELECT page, line, x0, y0, x1, y1, CASE WHEN c > 8 THEN 'TOO_MANY_BOXES' WHEN x1 > 56 OR y1 > 42 THEN 'INVALID_BOX'
  WHEN (x1 - x0) * (y1 - y0) / (56.0 * 42.0) > 0.05 THEN 'DROPPED_COVERAGE' ELSE 'OK' END AS status
FROM boxes JOIN n USING (page)""")
def coverage_cap(t: Tables) -> DataFrame:
    """All proposals on a 56 x 42 image; at most 8 per order and 5 percent of the area each."""
    return regions.cap_coverage(boxes(t), ["page"], F.lit(56), F.lit(42), 0.05, 8)


@query("overlap_join", f"""
WITH {BOXES}
SELECT a.page, a.x0, a.y0, a.x1, a.y1, b.line AS content_line, b.x0 AS cx0, b.y0 AS cy0, {PAIR_AREA} AS intersection_area
FROM boxes a JOIN boxes b ON a.page = b.page AND a.line = 1 AND b.line <> 1 AND {PAIR_OVERLAP}""")
def overlap_join(t: Tables) -> DataFrame:
    """First lines of an order as regions, its other lines as protected content."""
    pairs = overlap.region_overlaps(boxes(t).filter("line = 1"), boxes(t).filter("line <> 1"), ["page"])
    return pairs.select("page", "x0", "y0", "x1", "y1", F.col("r_line").alias("content_line"),
                        F.col("r_x0").alias("cx0"), F.col("r_y0").alias("cy0"), "intersection_area")


@query("spatial_anti", f"""
WITH {BOXES}
SELECT page, line, x0, y0, x1, y1 FROM boxes a WHERE line <> 1
AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page = a.page AND b.line = 1 AND {PAIR_OVERLAP})""")
def spatial_anti(t: Tables) -> DataFrame:
    """Lines that touch none of their order's first lines."""
    return overlap.outside(boxes(t).filter("line <> 1"), boxes(t).filter("line = 1"), ["page"])


@query("iou_pairs", f"""
WITH {BOXES}
SELECT a.page, a.line, a.x0, a.y0, b.x0 AS ex0, b.y0 AS ey0, round({PAIR_IOU}, 6) AS iou
FROM boxes a JOIN boxes b ON a.page = b.page AND a.line <> 1 AND b.line = 1 AND {PAIR_OVERLAP}""")
def iou_pairs(t: Tables) -> DataFrame:
    pairs = overlap.iou_pairs(boxes(t).filter("line <> 1"), boxes(t).filter("line = 1"), ["page"])
    return pairs.select("page", "line", "x0", "y0", F.col("r_x0").alias("ex0"), F.col("r_y0").alias("ey0"),
                        F.round("iou", 6).alias("iou"))


MATCHES = f"""
edges AS (SELECT a.page, a.row_id AS p, b.row_id AS t, {PAIR_IOU} AS iou,
  row_number() OVER (PARTITION BY a.page ORDER BY a.confidence DESC, a.row_id, {PAIR_IOU} DESC, b.price DESC, b.row_id) AS k
  FROM known a JOIN known b ON a.page = b.page AND a.line <> 1 AND b.line = 1 AND {PAIR_OVERLAP}
  WHERE {PAIR_IOU} >= 0.3),
walk AS (
  SELECT DISTINCT page, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, '' AS p, '' AS t, CAST(0 AS DOUBLE) AS iou, false AS hit,
    CAST([] AS VARCHAR[]) AS done FROM edges
  UNION ALL
  SELECT w.page, e.k,
    CASE WHEN NOT list_contains(w.used, e.t) AND NOT list_contains(w.done, e.p) THEN list_append(w.used, e.t) ELSE w.used END,
    e.p, e.t, e.iou, NOT list_contains(w.used, e.t) AND NOT list_contains(w.done, e.p),
    CASE WHEN NOT list_contains(w.used, e.t) AND NOT list_contains(w.done, e.p) THEN list_append(w.done, e.p) ELSE w.done END
  FROM walk w JOIN edges e ON e.page = w.page AND e.k = w.k + 1),
matches AS (SELECT page, p, t, iou FROM walk WHERE hit)
"""


def matched(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = placed(room_for(t.lineitem))
    pred, truth = rows.filter("l_linenumber <> 1"), rows.filter("l_linenumber = 1")
    near = cut_lineage(identified(matching.matchable(pred, truth, ["page"], 0.3)))
    found = matching.match_boxes(
        near.withColumnRenamed("row_id", "pred_id").drop("price"),
        identified(truth).withColumnRenamed("row_id", "truth_id").drop("confidence"),
        ["page"], "confidence", "pred_id", "truth_id", "price", 0.3)
    return pred, truth, found


@query("greedy_match", f"WITH RECURSIVE {KNOWN}, {MATCHES} SELECT page, p AS pred_id, t AS truth_id, round(iou, 6) AS iou FROM matches")
def greedy_match(t: Tables) -> DataFrame:
    """First lines are the truth, the others predictions ranked by discount; IoU of at least 0.3."""
    return matched(t)[2].withColumn("iou", F.round("iou", 6))


SCORES = """
scored AS (SELECT o.o_orderkey AS page, o.o_orderpriority AS scene_kind, o.o_custkey AS pair_id,
  coalesce(e.n, 0) AS expected_count, coalesce(r.n, 0) AS predicted_count, coalesce(m.n, 0) AS true_positive, coalesce(m.s, 0) AS iou_sum
  FROM orders o LEFT JOIN (SELECT page, count(*) AS n FROM known WHERE line = 1 GROUP BY page) e ON e.page = o_orderkey
  LEFT JOIN (SELECT page, count(*) AS n FROM known WHERE line <> 1 GROUP BY page) r ON r.page = o_orderkey
  LEFT JOIN (SELECT page, count(*) AS n, sum(iou) AS s FROM matches GROUP BY page) m ON m.page = o_orderkey),
results AS (SELECT *, predicted_count - true_positive AS false_positive, expected_count - true_positive AS false_negative,
  CASE WHEN expected_count > 0 THEN 'positive' ELSE 'negative' END AS kind FROM scored)
"""


def results(t: Tables) -> DataFrame:
    """Localization scores per order: priority = scene, customer = pair."""
    pred, truth, found = matched(t)
    corpus = t.orders.select(F.col("o_orderkey").alias("page"), F.col("o_orderpriority").alias("scene_kind"),
                             F.col("o_custkey").alias("pair_id"))
    return matching.sample_scores(corpus, pred, truth, found, ["page"])


@query("localization_report", f"""WITH RECURSIVE {KNOWN}, {MATCHES}, {SCORES},
t AS (SELECT count(*) AS sample_count, count(*) FILTER (kind = 'positive') AS positive_count, count(*) FILTER (kind = 'negative') AS negative_count,
 CAST(sum(true_positive) AS BIGINT) AS true_positive, CAST(sum(false_positive) AS BIGINT) AS false_positive, CAST(sum(false_negative) AS BIGINT) AS false_negative,
 count(DISTINCT scene_kind) AS scene_count, count(DISTINCT pair_id) AS pair_count, sum(iou_sum) AS s FROM results),
u AS (SELECT *, true_positive / (true_positive + false_positive) AS p, true_positive / (true_positive + false_negative) AS r FROM t)
SELECT sample_count, positive_count, negative_count, true_positive, false_positive, false_negative, scene_count, pair_count, round(p, 6) AS precision,
 round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(s / true_positive, 6) AS mean_matched_iou, p >= 0.75 AND r >= 0.85 AS metric_gate,
 sample_count >= 20 AND negative_count >= 10 AND scene_count >= 4 AND pair_count >= 7 AS evidence_gate, false AS release_claim_allowed FROM u""")
def localization_report(t: Tables) -> DataFrame:
    """The headline figures of the localization audit; the boxes are no model's output, so no claim is allowed."""
    return audit.localization_report(results(t), "scene_kind", "pair_id", False)


BEST = f"""
best AS (SELECT a.page, coalesce(max(({PAIR_IOU})), 0) AS best_iou,
  coalesce(max(({PAIR_AREA}) / ((b.x1-b.x0)*(b.y1-b.y0))), 0) AS best_detection_containment,
  coalesce(max(((b.x1-b.x0)*(b.y1-b.y0)) / ((a.x1-a.x0)*(a.y1-a.y0))), 0) AS best_detection_area_ratio,
  coalesce(bool_or(({PAIR_AREA}) / ((b.x1-b.x0)*(b.y1-b.y0)) >= 0.9 AND ((b.x1-b.x0)*(b.y1-b.y0)) / ((a.x1-a.x0)*(a.y1-a.y0)) >= 0.15), false) AS contained
  FROM cands a LEFT JOIN boxes b ON a.page = b.page GROUP BY a.page)
"""


@query("best_match", f"""WITH {BOXES}, {CANDIDATES}, {BEST}
SELECT page, round(best_iou, 6) AS best_iou, round(best_detection_containment, 6) AS best_detection_containment,
 round(best_detection_area_ratio, 6) AS best_detection_area_ratio FROM best""")
def best_match(t: Tables) -> DataFrame:
    best = matching.best_match(candidates(t), boxes(t), ["page"])
    return best.select("page", *[F.round(c, 6).alias(c) for c in (
        "best_iou", "best_detection_containment", "best_detection_area_ratio")])


@query("confirm_gate", f"""WITH {BOXES}, {CANDIDATES}, {BEST}
SELECT page, best_iou >= 0.5 OR contained AS accepted, CASE WHEN best_iou >= 0.5 THEN 'iou' WHEN contained THEN 'contained_detection'
 ELSE 'no_match' END AS decision_reason FROM best""")
def confirm_gate(t: Tables) -> DataFrame:
    return matching.confirm(candidates(t), boxes(t), ["page"]).select("page", "accepted", "decision_reason")


@query("gate_apply", f"""WITH {BOXES}, {CANDIDATES}, {BEST}
SELECT o_orderkey AS page, CASE WHEN best_iou >= 0.5 OR contained THEN sha256(CAST(o_orderkey AS VARCHAR)) ELSE '' END AS mask_sha
FROM orders LEFT JOIN best ON page = o_orderkey""")
def gate_apply(t: Tables) -> DataFrame:
    """Every order's mask digest, blank where the confirmation gate rejects it."""
    masks = t.orders.select(F.col("o_orderkey").alias("page"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("mask_sha"))
    decisions = matching.confirm(candidates(t), boxes(t), ["page"])
    return matching.apply_gate(masks, decisions, ["page"], "mask_sha", F.lit(""))


@query("best_mask", """
SELECT l_orderkey AS page, arg_max(l_partkey, (l_extendedprice, -l_linenumber)) AS mask, max(l_extendedprice) AS score FROM lineitem GROUP BY l_orderkey""")
def best_mask(t: Tables) -> DataFrame:
    """The dearest line of an order stands for its best-scored mask."""
    masks = t.lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("mask"),
                              F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("idx"))
    return matching.best_mask(masks, ["page"], "mask", "score", "idx").drop("idx")


@query("box_metrics", f"""
WITH {BOXES}, {CANDIDATES}
SELECT a.page, b.line, b.x0, b.y0, round({PAIR_IOU}, 6) AS iou, round(({PAIR_AREA}) / ((b.x1-b.x0)*(b.y1-b.y0)), 6) AS containment,
 round(((b.x1-b.x0)*(b.y1-b.y0)) / ((a.x1-a.x0)*(a.y1-a.y0)), 6) AS area_ratio FROM cands a JOIN boxes b ON a.page = b.page""")
def box_metrics(t: Tables) -> DataFrame:
    cands = candidates(t).toDF("page", "c_x0", "c_y0", "c_x1", "c_y1")
    c, d = Box.of("c_"), Box.of()
    return boxes(t).join(cands, "page").select(
        "page", "line", "x0", "y0", F.round(geo.iou(c, d), 6).alias("iou"),
        F.round(geo.containment(d, c), 6).alias("containment"), F.round(geo.area_ratio(d, c), 6).alias("area_ratio"))


@query("poly", f"""
WITH {BOXES}
SELECT page, line, x0, y0, (x1 - x0) * (y1 - y0) / 2.0 + 3.0 * (x1 - x0) / 2 AS area, y0 - 3 AS low, y1 AS high,
 x0 AS left_x, x1 AS right_x FROM boxes""")
def poly(t: Tables) -> DataFrame:
    """A quadrilateral per line: two triangles above and below the box's lower edge."""
    def point(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    x0, y0, x1, y1 = Box.of()
    points = F.array(point(x0, y0), point(x0, y0 - 3), point(x1, y0), point(x0, y1))
    b = geo.poly_bounds(F.col("points"))
    rows = boxes(t).withColumn("points", points)
    return rows.select("page", "line", "x0", "y0", geo.poly_area(F.col("points")).alias("area"),
                       b.y0.cast("bigint").alias("low"), b.y1.cast("bigint").alias("high"),
                       b.x0.cast("bigint").alias("left_x"), b.x1.cast("bigint").alias("right_x"))


REGION = "greatest(x0 - 5.5, 0.0) AS rx0, greatest(y0 - 3.25, 0.0) AS ry0, least(x1 - 5.5, 48.0) AS rx1, least(y1 - 3.25, 36.0) AS ry1"


@query("page_region", f"""
WITH {BOXES}, r AS (SELECT page, line, {REGION} FROM boxes)
SELECT page, line, CAST(least(rx0, rx1) AS DOUBLE) AS rx0, CAST(least(ry0, ry1) AS DOUBLE) AS ry0,
 CAST(greatest(rx0, rx1) AS DOUBLE) AS rx1, CAST(greatest(ry0, ry1) AS DOUBLE) AS ry1 FROM r""")
def page_region(t: Tables) -> DataFrame:
    """Box corners on a 48 x 36 page whose crop box starts at (5.5, 3.25)."""
    def point(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    x0, y0, x1, y1 = Box.of()
    r = geo.page_region(F.array(point(x1, y0), point(x0, y1)), F.lit(48.0), F.lit(36.0), F.lit(5.5), F.lit(3.25))
    return boxes(t).select("page", "line", r.x0.alias("rx0"), r.y0.alias("ry0"), r.x1.alias("rx1"), r.y1.alias("ry1"))


@query("expand", f"""
WITH {BOXES}, {FRAMES}
SELECT page, line, CAST(greatest(x0 - 5.0, 0) AS DOUBLE) AS ex0, CAST(greatest(y0 - 5.0, 0) AS DOUBLE) AS ey0,
 CAST(least(x1 + 5.0, width) AS DOUBLE) AS ex1, CAST(least(y1 + 5.0, height) AS DOUBLE) AS ey1 FROM boxes JOIN frames USING (page)""")
def expand(t: Tables) -> DataFrame:
    e = geo.expand(Box.of(), 5.0, F.col("width"), F.col("height"))
    return boxes(t).join(frames(t), "page").select(
        "page", "line", e.x0.alias("ex0"), e.y0.alias("ey0"), e.x1.alias("ex1"), e.y1.alias("ey1"))


@query("to_pixels", f"""
WITH {BOXES}
SELECT page, line, greatest(CAST(floor(x0 / 60.0 * 127) AS BIGINT), 0) AS px0, greatest(CAST(floor((45.0 - y1) / 45.0 * 95) AS BIGINT), 0) AS py0,
 least(CAST(ceil(x1 / 60.0 * 127) AS BIGINT), 127) AS px1, least(CAST(ceil((45.0 - y0) / 45.0 * 95) AS BIGINT), 95) AS py1
FROM (SELECT page, line, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM boxes)""")
def to_pixels(t: Tables) -> DataFrame:
    """A 60 x 45 point page rendered at 127 x 95 pixels."""
    px = geo.to_pixels(Box.of(), F.lit(60.0), F.lit(45.0), F.lit(127), F.lit(95))
    return boxes(t).select("page", "line", px.x0.alias("px0"), px.y0.alias("py0"), px.x1.alias("px1"), px.y1.alias("py1"))


@query("transform_id", """
SELECT o_orderkey, substr(sha256(printf('%d|%.6f|%.6f|%d|%.6f|%.6f', o_orderkey, o_totalprice / 100, (o_custkey % 6 + 38) * 1.0::DOUBLE,
 (o_custkey % 4) * 90, (o_custkey % 8) / 3::DOUBLE, 0.0::DOUBLE)), 1, 24) AS frame_id FROM orders""")
def transform_id_query(t: Tables) -> DataFrame:
    frame = transform_id(F.col("o_orderkey"), F.col("o_totalprice") / 100, F.col("o_custkey") % 6 + 38,
                         F.col("o_custkey") % 4 * 90, F.col("o_custkey") % 8 / 3, F.lit(0.0))
    return t.orders.select("o_orderkey", frame.alias("frame_id"))
