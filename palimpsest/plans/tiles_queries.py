"""Queries over 64-value vectors read as 8 x 8 gray tiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import extension, tiles as px
from palimpsest.plans.registry import Tables, query
from palimpsest.plans.roles import BOXES, boxes

GRID = px.Grid(8, 8)
KEY = ["vec_id"]


def gray_tiles(t: Tables, factor: float = 127.5) -> DataFrame:
    """Vectors as gray values 0..255, with a 2 x 2 region per tile; a larger factor spreads the values around the middle."""
    gray = F.transform("embedding", lambda e: F.least(F.greatest(F.floor(
        (e.cast("double") + 1) * factor - (factor - 127.5)), F.lit(0)), F.lit(255)).cast("int"))
    x0, y0 = (F.col("vec_id") % 7).cast("int"), (F.floor(F.col("vec_id") / 7) % 7).cast("int")
    return t.embeddings.select("vec_id", "label", gray.alias("gray"), x0.alias("x0"), y0.alias("y0"),
                               (x0 + 2).alias("x1"), (y0 + 2).alias("y1"))


TILES = """
unrolled AS (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
pixels AS (SELECT vec_id, label, pos, pos % 8 AS x, pos // 8 AS y, CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS gray FROM unrolled),
tiles AS (SELECT vec_id, list(gray ORDER BY pos) AS g FROM pixels GROUP BY vec_id),
near AS (SELECT p.*, g, CASE WHEN x = 0 THEN 1 ELSE x - 1 END AS xm, CASE WHEN x = 7 THEN 6 ELSE x + 1 END AS xp,
  CASE WHEN y = 0 THEN 1 ELSE y - 1 END AS ym, CASE WHEN y = 7 THEN 6 ELSE y + 1 END AS yp,
  vec_id % 7 AS x0, (vec_id // 7) % 7 AS y0 FROM pixels p JOIN tiles USING (vec_id)),
sobel AS (SELECT *, g[ym*8+xp+1] + 2*g[y*8+xp+1] + g[yp*8+xp+1] - g[ym*8+xm+1] - 2*g[y*8+xm+1] - g[yp*8+xm+1] AS gx,
  g[yp*8+xm+1] + 2*g[yp*8+x+1] + g[yp*8+xp+1] - g[ym*8+xm+1] - 2*g[ym*8+x+1] - g[ym*8+xp+1] AS gy FROM near),
grads AS (SELECT *, sqrt(gx*gx + gy*gy) AS mag, least(17, floor((atan2(gy, gx) + pi()) / (2 * pi() / 18))) AS bin FROM sobel),
grayhist AS (SELECT vec_id, gray, count(*) AS n FROM pixels GROUP BY ALL),
lum AS (SELECT vec_id, -sum(n / 64.0::DOUBLE * log2(n / 64.0::DOUBLE)) AS luminance_entropy FROM grayhist GROUP BY vec_id),
colors AS (SELECT vec_id, count(DISTINCT (gray // 16) * 256 + (g[(pos + 1) % 64 + 1] // 16) * 16 + g[(pos + 2) % 64 + 1] // 16) AS color_count FROM near GROUP BY vec_id),
sds AS (SELECT vec_id, stddev_pop(gray) AS luma_deviation FROM pixels GROUP BY vec_id),
flats AS (SELECT vec_id, avg(CASE WHEN mag < 10 THEN 1.0 ELSE 0.0 END) AS flat_ratio FROM grads GROUP BY vec_id),
ohist AS (SELECT vec_id, bin, count(*) AS n, sum(count(*)) OVER (PARTITION BY vec_id) AS total FROM grads WHERE mag >= 20 GROUP BY vec_id, bin),
orients AS (SELECT vec_id, -sum(n / total * log2(n / total)) AS orientation_entropy FROM ohist GROUP BY vec_id),
stats AS (SELECT vec_id, luminance_entropy, color_count, luma_deviation, flat_ratio, coalesce(orientation_entropy, 0) AS orientation_entropy
  FROM lum JOIN colors USING (vec_id) JOIN sds USING (vec_id) JOIN flats USING (vec_id) LEFT JOIN orients USING (vec_id))
"""


SPREAD_FACTOR = 300.0
SPREAD = TILES.replace("* 127.5", f"* {SPREAD_FACTOR} - ({SPREAD_FACTOR} - 127.5)")


def statistics(t: Tables, factor: float = 127.5) -> DataFrame:
    """Red is the gray value, green and blue are those of the next two positions."""
    def turned(k: int):
        return F.concat(F.slice("gray", k + 1, 64), F.slice("gray", 1, k))

    with_rgb = gray_tiles(t, factor).withColumn("green", turned(1)).withColumn("blue", turned(2))
    return px.photo_statistics(with_rgb, KEY, GRID, "gray", ("gray", "green", "blue"))


@query("entropy", f"WITH {TILES} SELECT vec_id, round(luminance_entropy, 4) AS entropy FROM lum")
def entropy(t: Tables) -> DataFrame:
    pixels = px.unroll(gray_tiles(t), GRID)
    hist = px.histograms(pixels, KEY, {"gray": F.get("gray", F.col("pos"))})
    return hist.groupBy("vec_id").agg(F.round(px.entropy_of("gray"), 4).alias("entropy"))


@query("color_count", f"WITH {TILES} SELECT vec_id, color_count FROM colors")
def color_count(t: Tables) -> DataFrame:
    pixels, color = colored(t)
    return px.histograms(pixels, KEY, {"color": color}).groupBy("vec_id").agg(F.count(F.lit(1)).alias("color_count"))


def colored(t: Tables):
    """Pixels of the tiles, and their quantised colour."""
    gray = F.col("gray")
    turned = [gray, *[F.concat(F.slice(gray, k + 1, 64), F.slice(gray, 1, k)) for k in (1, 2)]]
    pixels = px.unroll(gray_tiles(t).withColumns({f"c{i}": c for i, c in enumerate(turned)}), GRID)
    r, g, b = [F.floor(F.get(f"c{i}", F.col("pos")) / px.COLOR_STEP) for i in range(3)]
    return pixels, r * 256 + g * 16 + b


@query("color_rollup", f"""WITH {TILES}
SELECT label, count(DISTINCT vec_id) AS n_images, count(DISTINCT (gray // 16) * 256 + (g[(pos + 1) % 64 + 1] // 16) * 16 + g[(pos + 2) % 64 + 1] // 16) AS exact_colors,
 true AS within_bound FROM near GROUP BY label""")
def color_rollup(t: Tables) -> DataFrame:
    """Colours over all tiles of a label from one sketch a tile, held against the exact count and the bound of 4.9 %."""
    pixels, color = colored(t)
    every = pixels.select("vec_id", "label", color.cast("bigint").alias("color"))
    guess = px.color_rollup(px.color_sketches(every, ["vec_id", "label"]), ["label"])
    exact = every.select("label", "color").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("exact_colors"))
    other = exact.select(F.col("label").alias("_label"), "exact_colors")
    return guess.join(other, F.col("label").eqNullSafe(F.col("_label"))).select(
        "label", "n_images", "exact_colors", (F.abs(F.col("colors") - F.col("exact_colors")) <= 0.049 * F.col("exact_colors")).alias("within_bound"))


@query("luma_sd", f"WITH {TILES} SELECT vec_id, round(luma_deviation, 4) AS luma_sd FROM sds")
def luma_sd(t: Tables) -> DataFrame:
    pixels = px.unroll(gray_tiles(t), GRID)
    return pixels.groupBy("vec_id").agg(F.round(F.stddev_pop(F.get("gray", F.col("pos"))), 4).alias("luma_sd"))


@query("gradient_stats", f"WITH {TILES} SELECT vec_id, round(flat_ratio, 6) AS flat_ratio, round(orientation_entropy, 4) AS orientation_entropy FROM stats")
def gradient_stats(t: Tables) -> DataFrame:
    hist = px.histograms(px.with_gradient(px.unroll(gray_tiles(t), GRID), GRID, "gray"), KEY, px.gradient_bins())
    flat = F.sum(F.when((F.col("kind") == "flat") & (F.col("bin") == 1), F.col("n")).otherwise(0)) / 64
    return hist.groupBy("vec_id").agg(F.round(flat, 6).alias("flat_ratio"),
                                      F.round(px.entropy_of("orientation"), 4).alias("orientation_entropy"))


ROUTES = """
routes AS (SELECT vec_id, concat_ws(',', CASE WHEN luminance_entropy >= 4.5 AND color_count >= 128 THEN 'color-diversity' END,
 CASE WHEN luma_deviation >= 25 AND flat_ratio <= 0.75 THEN 'continuous-tone' END,
 CASE WHEN luminance_entropy >= 3.4 AND luma_deviation >= 25 AND orientation_entropy >= 3.9 THEN 'distributed-detail' END) AS routes FROM stats)
"""


@query("photo_routes", f"WITH {SPREAD}, {ROUTES} SELECT vec_id, routes, routes <> '' AS eligible FROM routes")
def photo_routes(t: Tables) -> DataFrame:
    return px.photo_routes(statistics(t, SPREAD_FACTOR)).select("vec_id", F.array_join("matched_routes", ",").alias("routes"), "eligible")


BOX_SCHEMA = "vec_id bigint, x0 double, y0 double, x1 double, y1 double, label string, confidence double"


@query("localize", f"""WITH {TILES}, m AS (SELECT vec_id, gray, x, y, row_number() OVER (PARTITION BY vec_id ORDER BY gray DESC, pos) AS n FROM pixels)
SELECT vec_id, x::DOUBLE AS x0, y::DOUBLE AS y0, x + 1.0::DOUBLE AS x1, y + 1.0::DOUBLE AS y1, 'mark' AS label, gray::DOUBLE AS confidence FROM m WHERE n = 1""")
def localize(t: Tables) -> DataFrame:
    """A stand-in localizer on all tiles: a box around the brightest pixel, the first one on ties."""
    return extension.with_boxes(gray_tiles(t).select("vec_id", "gray"), brightest(), BOX_SCHEMA)


@query("gated_call", f"""WITH {SPREAD}, {ROUTES},
m AS (SELECT vec_id, max(gray) AS top FROM pixels GROUP BY vec_id)
SELECT vec_id, CASE WHEN routes <> '' THEN 1::BIGINT ELSE 0 END AS n_boxes, CASE WHEN routes <> '' THEN top ELSE -1 END AS best FROM routes JOIN m USING (vec_id)""")
def gated_call(t: Tables) -> DataFrame:
    """A stand-in localizer runs on eligible tiles only and marks their brightest value."""
    gate = px.photo_routes(statistics(t, SPREAD_FACTOR)).select("vec_id", "eligible")
    boxes_found = extension.gated(gray_tiles(t, SPREAD_FACTOR).select("vec_id", "gray"), gate, KEY, "eligible", brightest(), BOX_SCHEMA)
    return boxes_found.groupBy("vec_id").agg(
        F.count("confidence").alias("n_boxes"), F.coalesce(F.max("confidence").cast("bigint"), F.lit(-1)).alias("best"))


def brightest():
    """A batch function: one box per tile around its brightest pixel, with its gray value as confidence.

    It is made here, inside a function, so that it travels to the executors by value.
    """
    def run(batches):
        import numpy as np
        import pandas as pd

        for frame in batches:
            stack = np.stack(frame["gray"].to_numpy()) if len(frame) else np.zeros((0, 64))
            at = stack.argmax(axis=1)
            x, y = at % 8, at // 8
            yield pd.DataFrame({"vec_id": frame["vec_id"], "x0": x * 1.0, "y0": y * 1.0, "x1": x + 1.0, "y1": y + 1.0,
                                "label": "mark", "confidence": stack.max(axis=1).astype(float)})

    return run


RING = "NOT (x >= x0 - 2 AND x < x0 + 4 AND y >= y0 - 2 AND y < y0 + 4)"
TEXTURE = f"""
smooth AS (SELECT vec_id, pos, (g[ym*8+xm+1] + 2*g[ym*8+x+1] + g[ym*8+xp+1] + 2*g[y*8+xm+1] + 4*g[y*8+x+1] + 2*g[y*8+xp+1]
  + g[yp*8+xm+1] + 2*g[yp*8+x+1] + g[yp*8+xp+1] + 8) // 16 AS s FROM near),
sg AS (SELECT vec_id, list(s ORDER BY pos) AS s FROM smooth GROUP BY vec_id),
lap AS (SELECT vec_id, x, y, x0, y0, abs(s[ym*8+x+1] + s[yp*8+x+1] + s[y*8+xm+1] + s[y*8+xp+1] - 4*s[y*8+x+1]) AS l FROM near JOIN sg USING (vec_id)),
texture AS (SELECT vec_id, count(*) AS context_pixels, least(1.0, quantile_cont(l, 0.9) / 30) AS texture_score FROM lap WHERE {RING} GROUP BY vec_id),
edges AS (SELECT vec_id, avg(CASE WHEN gx*gx + gy*gy >= 14400 THEN 1.0 ELSE 0.0 END) AS edge_density FROM sobel WHERE {RING} GROUP BY vec_id)
"""


@query("texture_p90", f"WITH {TILES}, {TEXTURE} SELECT vec_id, context_pixels, round(texture_score, 4) AS texture_score FROM texture")
def texture_p90(t: Tables) -> DataFrame:
    return px.texture_p90(gray_tiles(t), KEY, GRID, "gray").withColumn("texture_score", F.round("texture_score", 4))


WEIGHTS = [math.exp(-((i - 4) ** 2) / (2 * 1.7**2)) for i in range(9)]  # an eighth of 64 values, made odd
WEIGHTS = [w / sum(WEIGHTS) for w in WEIGHTS]
TREND = " + ".join(f"{w!r}::DOUBLE * g[CASE WHEN pos + ({k - 4}) < 0 THEN -(pos + ({k - 4})) WHEN pos + ({k - 4}) > 63 THEN 126 - (pos + ({k - 4})) ELSE pos + ({k - 4}) END + 1]"
                   for k, w in enumerate(WEIGHTS))
PERIODIC = f"""
detrended AS (SELECT vec_id, pos, gray - ({TREND}) AS v FROM near),
energy AS (SELECT vec_id, sum(v * v) AS e FROM detrended GROUP BY vec_id),
lags AS (SELECT a.vec_id, b.pos - a.pos AS lag, sum(a.v * b.v) AS ab, sqrt(sum(a.v * a.v) * sum(b.v * b.v)) AS d
  FROM detrended a JOIN detrended b ON a.vec_id = b.vec_id AND b.pos - a.pos BETWEEN 3 AND 32 GROUP BY ALL),
periodic AS (SELECT vec_id, least(1.0, coalesce(max(CASE WHEN e >= 0.001 AND d > 0.000001 THEN abs(ab) / d END), 0.0)) AS periodicity
  FROM lags JOIN energy USING (vec_id) GROUP BY vec_id)
"""


@query("periodicity", f"WITH {TILES}, {PERIODIC} SELECT vec_id, round(periodicity, 4) AS periodicity FROM periodic")
def periodicity(t: Tables) -> DataFrame:
    """The whole vector as one signal."""
    return px.periodicity(gray_tiles(t), KEY, "gray").withColumn("periodicity", F.round("periodicity", 4))


@query("complexity_level", f"""WITH {TILES.replace("vec_id % 7 AS x0, (vec_id // 7) % 7 AS y0", "CASE WHEN label = 0 THEN 0 ELSE vec_id % 7 END AS x0, CASE WHEN label = 0 THEN 0 ELSE (vec_id // 7) % 7 END AS y0")},
{TEXTURE.replace("x0 + 4", "x0 + CASE WHEN label = 0 THEN 10 ELSE 4 END").replace("y0 + 4", "y0 + CASE WHEN label = 0 THEN 10 ELSE 4 END").replace("SELECT vec_id, x, y, x0, y0, abs", "SELECT vec_id, label, x, y, x0, y0, abs")}
SELECT e.vec_id, CASE WHEN context_pixels IS NULL THEN 'review' WHEN e.label / 40.0 >= 0.3 OR edge_density >= 0.2 THEN 'high'
 WHEN texture_score >= 0.35 OR edge_density >= 0.08 THEN 'review' ELSE 'low' END AS risk
FROM embeddings e LEFT JOIN texture USING (vec_id) LEFT JOIN edges USING (vec_id)""")
def complexity_level(t: Tables) -> DataFrame:
    """Texture, edges and strips around the region, which fills the tile where the label is 0; strips of 8 values are too
    short to be periodic. The structure score is taken from the label column."""
    whole = F.col("label") == 0
    source = gray_tiles(t).withColumns({c: F.when(whole, v).otherwise(F.col(c)) for c, v in (("x0", 0), ("y0", 0), ("x1", 8), ("y1", 8))})
    joined = (px.texture_p90(source, KEY, GRID, "gray").join(px.edge_density(source, KEY, GRID, "gray", 120.0), KEY)
              .join(px.context_periodicity(source, KEY, GRID, "gray"), KEY).join(source.select("vec_id", "label"), KEY))
    level = px.complexity_level(F.col("texture_score"), F.col("edge_density"), F.col("periodicity"), F.col("label") / 40.0, F.col("context_pixels"))
    return joined.select("vec_id", level.alias("risk"))


@query("luma_delta", f"""WITH {TILES},
d AS (SELECT vec_id, round(abs(avg(gray) FILTER (x >= x0 AND x < x0 + 2 AND y >= y0 AND y < y0 + 2)
  - avg(gray) FILTER (NOT (x >= x0 AND x < x0 + 2 AND y >= y0 AND y < y0 + 2))) / 255, 4) AS mean_luma_delta FROM near GROUP BY vec_id)
SELECT *, mean_luma_delta < 0.04 AS low_contrast FROM d""")
def luma_delta(t: Tables) -> DataFrame:
    return px.luma_delta(gray_tiles(t), KEY, GRID, "gray")


MASKED = "x >= vec_id % 4 AND x < vec_id % 4 + 4 AND y >= (vec_id // 4) % 4 AND y < (vec_id // 4) % 4 + 4"


@query("recon_metrics", f"""WITH {TILES},
m AS (SELECT vec_id, x, y, gray AS c, {MASKED} AS inside, least(255, gray + 20 + label) AS mk,
  (g[ym*8+x+1] + g[yp*8+x+1] + g[y*8+xm+1] + g[y*8+xp+1]) // 4 AS avg4 FROM near),
p AS (SELECT vec_id, x, y, c, inside, CASE WHEN inside THEN mk ELSE c END AS marked,
  CASE WHEN inside THEN avg4 WHEN x = 7 AND y = 7 AND vec_id % 10 = 0 THEN c + 1 ELSE c END AS repaired FROM m),
e AS (SELECT a.*, inside AND EXISTS (SELECT 1 FROM p b WHERE b.vec_id = a.vec_id AND NOT b.inside AND abs(b.x - a.x) <= 2 AND abs(b.y - a.y) <= 2) AS edge FROM p a),
s AS (SELECT vec_id, avg(abs(marked - c)) FILTER (inside) AS input_masked_mae, avg(abs(repaired - c)) FILTER (inside) AS masked_mae,
 sqrt(avg((repaired - c) * (repaired - c)) FILTER (inside)) AS masked_rmse, avg(abs(repaired - c)) FILTER (edge) AS boundary_mae,
 avg(abs(repaired - c)) FILTER (NOT inside) AS outside_mae, avg(CASE WHEN repaired <> marked THEN 1.0 ELSE 0.0 END) FILTER (inside) AS changed_mask_ratio FROM e GROUP BY vec_id)
SELECT vec_id, round(input_masked_mae, 4) AS input_masked_mae, round(masked_mae, 4) AS masked_mae, round(masked_rmse, 4) AS masked_rmse,
 round(boundary_mae, 4) AS boundary_mae, round(outside_mae, 4) AS outside_mae, round(changed_mask_ratio, 4) AS changed_mask_ratio,
 round(CASE WHEN masked_rmse = 0 THEN 99 ELSE 20 * log10(255 / masked_rmse) END, 4) AS masked_psnr_db,
 round(CASE WHEN input_masked_mae = 0 THEN 0 ELSE (input_masked_mae - masked_mae) / input_masked_mae * 100 END, 2) AS improvement_percent,
 CASE WHEN masked_mae <= 5 THEN 'excellent' WHEN masked_mae <= 15 THEN 'good' WHEN masked_mae <= 30 THEN 'review' ELSE 'poor' END AS grade FROM s""")
def recon_metrics(t: Tables) -> DataFrame:
    """A 4 x 4 mark brightened by a constant and repaired with the mean of the four neighbours."""
    mx, my = (F.col("vec_id") % 4).cast("int"), (F.floor(F.col("vec_id") / 4) % 4).cast("int")
    source = gray_tiles(t)
    mask = F.transform(GRID.positions, lambda pos: GRID.inside(pos, mx, my, mx + 4, my + 4))
    spot = source.withColumn("mask", mask)
    cross = [[0, 1, 0], [1, 0, 1], [0, 1, 0]]

    def pick(inside, outside):
        return F.transform(GRID.positions, lambda pos: F.when(F.get("mask", pos), inside(pos)).otherwise(outside(pos)).cast("int"))

    own = lambda pos: F.get("gray", pos)
    slip = lambda pos: own(pos) + F.when((pos == 63) & (F.col("vec_id") % 10 == 0), 1).otherwise(0)
    ready = spot.select(
        "vec_id", "gray", "mask", pick(lambda pos: F.least(own(pos) + 20 + F.col("label"), F.lit(255)), own).alias("marked"),
        pick(lambda pos: F.floor(GRID.weighted(F.col("gray"), pos, cross) / 4), slip).alias("repaired"))
    return px.reconstruction(ready, KEY, GRID, ["gray"], ["marked"], ["repaired"], "mask")


@query("worst_level", """
SELECT l_orderkey AS page, CASE max(CASE WHEN l_quantity > 45 THEN 2 WHEN l_quantity > 25 THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'review' ELSE 'low' END AS level
FROM lineitem GROUP BY l_orderkey""")
def worst_level(t: Tables) -> DataFrame:
    """Quantity bands as region levels, the order as the image."""
    level = F.when(F.col("l_quantity") > 45, "high").when(F.col("l_quantity") > 25, "review").otherwise("low")
    return px.worst_level(t.lineitem.select(F.col("l_orderkey").alias("page"), level.alias("level")), ["page"], "level")


@query("image_warnings", f"""
WITH {BOXES}, r AS (SELECT page, line, (x1 - x0) * (y1 - y0) / 600.0 AS c, l_tax < 0.02 AS low, CASE WHEN l_quantity > 45 THEN 'high' WHEN l_quantity > 25 THEN 'review' ELSE 'low' END AS level, x0, y0 FROM boxes),
w AS (SELECT *, list_filter([{{'code': 'IMAGE_OUTPUT_PNG', 'ack': false}},
  CASE WHEN c > 0.25 THEN {{'code': 'IMAGE_MASK_OVER_25_PERCENT', 'ack': true}} WHEN c >= 0.1 THEN {{'code': 'IMAGE_MASK_OVER_10_PERCENT', 'ack': true}} END,
  CASE WHEN low THEN {{'code': 'IMAGE_LOW_CONTRAST_SELECTION', 'ack': true}} END,
  CASE level WHEN 'high' THEN {{'code': 'IMAGE_COMPLEXITY_HIGH', 'ack': true}} WHEN 'review' THEN {{'code': 'IMAGE_COMPLEXITY_REVIEW', 'ack': false}} END], lambda z: z IS NOT NULL) AS ws FROM r),
u AS (SELECT page, line, x0, y0, unnest(ws) AS z, generate_subscripts(ws, 1) - 1 AS position FROM w)
SELECT page, line, x0, y0, CAST(position AS INTEGER) AS position, z.code AS code, z.ack AS requires_acknowledgement FROM u""")
def image_warnings(t: Tables) -> DataFrame:
    level = F.when(F.col("l_quantity") > 45, "high").when(F.col("l_quantity") > 25, "review").otherwise("low")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    risk = boxes(t, "l_tax", "l_quantity").withColumn("coverage_ratio", area / 600.0).withColumn(
        "low_contrast", F.col("l_tax") < 0.02).withColumn("complexity_level", level)
    return px.image_warnings(risk, ["page", "line", "x0", "y0"])


def _blur(pick: str) -> str:
    """A pass of the blur in SQL; `pick` is the neighbour at a distance {d}."""
    weights = px.gaussian_weights(px.TEXT_BLUR)
    return "(" + " + ".join(f"{w} * {pick.format(d=k - len(weights) // 2)}" for k, w in enumerate(weights)) + f" + {px.WHOLE // 2}) // {px.WHOLE}"


@query("text_contrast", f"""WITH {TILES},
b AS (SELECT vec_id, pos, x, y, g, gray, vec_id % 2 AS bx0, vec_id % 6 AS by0, vec_id % 2 + 6 AS bx1, vec_id % 6 + 1 + CAST(vec_id % 3 = 0 AS INTEGER) AS by1 FROM near),
h AS (SELECT vec_id, list({_blur("g[y * 8 + least(greatest(x + ({d}), bx0), bx1 - 1) + 1]")} ORDER BY pos) AS h FROM b GROUP BY vec_id),
m AS (SELECT b.*, {_blur("h[least(greatest(y + ({d}), by0), by1 - 1) * 8 + x + 1]")} AS blur FROM b JOIN h USING (vec_id))
SELECT vec_id, count(*) FILTER ((bx1 - bx0) / (by1 - by0) >= 5 AND x >= bx0 AND x < bx1 AND y >= by0 AND y < by1 AND abs(gray - blur) >= 20) AS text_pixels FROM m GROUP BY vec_id""")
def text_contrast(t: Tables) -> DataFrame:
    """Boxes of 6 x 1 pixels, and 6 x 2 on every third tile, which are not long enough."""
    vec = F.col("vec_id").cast("int")
    tall = (vec % 3 == 0).cast("int")
    source = gray_tiles(t).withColumns({"x0": vec % 2, "y0": vec % 6, "x1": vec % 2 + 6, "y1": vec % 6 + 1 + tall})
    return px.text_contrast(source, KEY, GRID, ["gray"])


@query("neighbourhood", f"""WITH {TILES}
SELECT vec_id, x, y, coalesce(lag(gray) OVER r, -1) AS "left", coalesce(lead(gray) OVER r, -1) AS "right",
 coalesce(lag(gray) OVER c, -1) AS up, coalesce(lead(gray) OVER c, -1) AS down FROM pixels
WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)""")
def neighbourhood(t: Tables) -> DataFrame:
    pos = F.col("pos")
    pixels = px.unroll(gray_tiles(t), GRID).select(
        "vec_id", GRID.x(pos).cast("bigint").alias("x"), GRID.y(pos).cast("bigint").alias("y"),
        F.get("gray", pos).cast("bigint").alias("gray"))
    around = px.neighbourhood(pixels, KEY)
    return around.select("vec_id", "x", "y", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("left", "right", "up", "down")])


