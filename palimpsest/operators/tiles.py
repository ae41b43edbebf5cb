"""Pixel statistics of images held as one array of gray values per row.

Pixels are unrolled by position while the array stays beside them in the same
code-generated stage: a neighbour is an index into the array, so 3x3 filters need
no window and no shuffle, and only per-image partial sums leave the task. Pixel
tables without arrays have `neighbourhood`, which uses windows over pixel rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.measures import entropy_cols, grade

# Thresholds of the photo-evidence routes.
ENTROPY_MIN, COLORS_MIN, COLOR_STEP = 4.5, 128, 16
DEVIATION_MIN, FLAT_MAGNITUDE, FLAT_MAX = 25.0, 10.0, 0.75
DARK_ENTROPY_MIN, ORIENTATION_MAGNITUDE, ORIENTATION_BINS, ORIENTATION_MIN = 3.4, 20.0, 18, 3.9
# Thresholds of the complexity level and of selection risk.
TEXTURE_NORM, STRUCTURE_NORM = 30.0, 0.04
PERIODIC_MIN, PERIODIC_TEXTURE_MIN, STRUCTURE_MIN, EDGE_HIGH = 0.8, 0.1, 0.30, 0.2
TEXTURE_REVIEW, EDGE_REVIEW = 0.35, 0.08
LOW_CONTRAST, LARGE_SELECTION, HUGE_SELECTION = 0.04, 0.10, 0.25
# Shape and contrast limits of the text test.
TEXT_ASPECT, TEXT_DELTA, TEXT_BLUR = 5.0, 20, 1.5


class Grid:
    """Index arithmetic on a width x height array; edges mirror without repeating the edge pixel.

    Width and height are numbers or the names of columns, so that one table may hold pictures of any sizes.
    """

    def __init__(self, width: int | str, height: int | str) -> None:
        self._sides = (width, height)

    @property
    def width(self) -> Column:
        return F.col(self._sides[0]) if isinstance(self._sides[0], str) else F.lit(self._sides[0])

    @property
    def height(self) -> Column:
        return F.col(self._sides[1]) if isinstance(self._sides[1], str) else F.lit(self._sides[1])

    @property
    def positions(self) -> Column:
        return F.sequence(F.lit(0), F.lit(self.width * self.height - 1))

    def x(self, pos: Column) -> Column:
        return pos % self.width

    def y(self, pos: Column) -> Column:
        return F.floor(pos / self.width).cast("int")

    def cut(self, low: Column, high: Column, size: Column) -> tuple[Column, Column]:
        """Whole pixels of an interval, inside the picture."""
        return F.greatest(F.floor(low).cast("int"), F.lit(0)), F.least(F.ceil(high).cast("int"), size)

    def snapped(self, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
        """Corners of a region on whole pixels: low ones down, high ones up, cut to the picture."""
        (left, right), (top, bottom) = self.cut(x0, x1, self.width), self.cut(y0, y1, self.height)
        return left, top, right, bottom

    @staticmethod
    def mirror(i: Column, n: Column) -> Column:
        return F.when(n == 1, 0).when(i < 0, -i).when(i >= n, n * 2 - 2 - i).otherwise(i)

    def at(self, values: Column, pos: Column, dx: int, dy: int) -> Column:
        index = (self.mirror(self.y(pos) + dy, self.height) * self.width + self.mirror(self.x(pos) + dx, self.width))
        return F.get(values, index.cast("int"))

    def weighted(self, values: Column, pos: Column, kernel: list[list[float]]) -> Column:
        """Sum of the neighbourhood under an odd-sized kernel."""
        r, s = len(kernel) // 2, len(kernel[0]) // 2
        terms = [self.at(values, pos, i - s, j - r) * w for j, row in enumerate(kernel) for i, w in enumerate(row) if w]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total

    @staticmethod
    def near(values: Column, dx: int, dy: int) -> Column:
        """Neighbour at distance 1 of an unrolled pixel, from the indices `unroll` prepared."""
        return F.get(values, F.col(("_up", "_row", "_down")[dy + 1]) + F.col(("_left", "_x", "_right")[dx + 1]))

    def sobel(self, values: Column) -> tuple[Column, Column]:
        n = lambda dx, dy: self.near(values, dx, dy)
        gx = n(1, -1) + n(1, 0) * 2 + n(1, 1) - n(-1, -1) - n(-1, 0) * 2 - n(-1, 1)
        gy = n(-1, 1) + n(0, 1) * 2 + n(1, 1) - n(-1, -1) - n(0, -1) * 2 - n(1, -1)
        return gx, gy

    def laplacian(self, values: Column) -> Column:
        n = lambda dx, dy: self.near(values, dx, dy)
        return n(0, -1) + n(-1, 0) + n(1, 0) + n(0, 1) - n(0, 0) * 4

    def blurred(self, values: Column) -> Column:
        """The 3x3 smoothing with weights 1-2-1, rounded to whole gray values."""
        kernel = [[1, 2, 1], [2, 4, 2], [1, 2, 1]]
        return F.transform(self.positions, lambda pos: F.floor((self.weighted(values, pos, kernel) + 8) / 16))

    def inside(self, pos: Column, x0: Column, y0: Column, x1: Column, y1: Column, grow: int = 0) -> Column:
        x, y = self.x(pos), self.y(pos)
        return (x >= x0 - grow) & (x < x1 + grow) & (y >= y0 - grow) & (y < y1 + grow)

    def eroded(self, flags: Column, radius: int) -> Column:
        """Flags whose whole square neighbourhood inside the image is set, first along rows, then along columns."""
        def along(values: Column, step: Column, place, size: Column) -> Column:
            def all_set(pos: Column) -> Column:
                near = F.sequence(F.greatest(place(pos) - radius, F.lit(0)), F.least(place(pos) + radius, size - 1).cast("int"))
                return F.forall(near, lambda i: F.get(values, (pos + (i - place(pos)) * step).cast("int")))

            return F.transform(self.positions, all_set)

        return along(along(flags, F.lit(1), self.x, self.width), self.width, self.y, self.height)


def unroll(tiles: DataFrame, grid: Grid) -> DataFrame:
    """One row per pixel with its position and the indices of its neighbours; the arrays stay available."""
    placed = (tiles.withColumn("pos", F.explode(grid.positions))
              .withColumns({"_x": grid.x(F.col("pos")), "_y": grid.y(F.col("pos"))}))
    x, y, w, h = F.col("_x"), F.col("_y"), grid.width, grid.height
    return placed.withColumns({
        "_left": grid.mirror(x - 1, w), "_right": grid.mirror(x + 1, w), "_row": y * w,
        "_up": grid.mirror(y - 1, h) * w, "_down": grid.mirror(y + 1, h) * w})


def with_gradient(pixels: DataFrame, grid: Grid, gray: str) -> DataFrame:
    """Add the gradient of unrolled pixels, each part computed once."""
    gx, gy = grid.sobel(F.col(gray))
    return (pixels.withColumns({"_gx": gx.cast("double"), "_gy": gy.cast("double")})
            .withColumn("_size", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))))


def histograms(pixels: DataFrame, image: list[str], bins: Mapping[str, Column]) -> DataFrame:
    """Counts per image, kind and bin for several kinds in one aggregation; null bins are left out."""
    kinds = F.explode(F.array(*[
        F.struct(F.lit(name).alias("kind"), value.cast("bigint").alias("bin")) for name, value in bins.items()]))
    return (pixels.select(*image, kinds.alias("_k")).filter("_k.bin IS NOT NULL")
            .groupBy(*image, F.col("_k.kind").alias("kind"), F.col("_k.bin").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def entropy_of(kind: str) -> Column:
    """Base-2 entropy from histogram rows of one kind: log2 N - sum(n log2 n) / N; 0 without rows."""
    return entropy_cols(F.when(F.col("kind") == kind, F.col("n")))


def color_sketches(colors: DataFrame, image: list[str], color: str = "color", precision: int = 12) -> DataFrame:
    """(image, sketch): a mergeable HyperLogLog sketch of the colours of each picture, some 2 ** precision bytes at most."""
    return colors.groupBy(*image).agg(F.hll_sketch_agg(color, F.lit(precision)).alias("sketch"))


def color_rollup(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_images, colors): different colours over all pictures of a group, from their sketches alone.

    With precision 12 the relative standard error is 1.04 / sqrt(4096) = 1.6 %; three times that, 4.9 %, holds for nearly all groups.
    """
    merged = sketches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_images"), F.hll_union_agg("sketch").alias("_all"))
    return merged.select(*keys, "n_images", F.hll_sketch_estimate("_all").alias("colors"))


def gradient_bins() -> dict[str, Column]:
    """Bins of the gradient: flat or not, and one of 18 directions where it is strong."""
    turn = F.floor((F.atan2("_gy", "_gx") + math.pi) / (2 * math.pi / ORIENTATION_BINS))
    return {"flat": F.when(F.col("_size") < FLAT_MAGNITUDE, 1).otherwise(0),
            "orientation": F.when(F.col("_size") >= ORIENTATION_MAGNITUDE, F.least(turn, F.lit(ORIENTATION_BINS - 1)))}


def photo_statistics(tiles: DataFrame, image: list[str], grid: Grid, gray: str, rgb: tuple[str, str, str]) -> DataFrame:
    """Entropy, colours, deviation and gradient figures per image from one histogram pass."""
    pos = F.col("pos")
    r, g, b = [F.floor(F.get(F.col(c), pos) / COLOR_STEP) for c in rgb]
    bins = {"gray": F.get(F.col(gray), pos), "color": r * 256 + g * 16 + b,
            **gradient_bins()}
    is_gray, n = F.col("kind") == "gray", F.col("n")
    pixels = F.sum(F.when(is_gray, n))
    mean = F.sum(F.when(is_gray, n * F.col("bin"))) / pixels
    square = F.sum(F.when(is_gray, n * F.col("bin") * F.col("bin"))) / pixels
    flat = F.sum(F.when((F.col("kind") == "flat") & (F.col("bin") == 1), n).otherwise(0))
    return histograms(with_gradient(unroll(tiles, grid), grid, gray), image, bins).groupBy(*image).agg(
        entropy_of("gray").alias("luminance_entropy"), F.count_if(F.col("kind") == "color").alias("color_count"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("luma_deviation"), (flat / pixels).alias("flat_ratio"),
        entropy_of("orientation").alias("orientation_entropy"))


def photo_routes(stats: DataFrame) -> DataFrame:
    """The evidence routes a picture meets; any of them makes it eligible."""
    entropy, deviation = F.col("luminance_entropy"), F.col("luma_deviation")
    routes = F.array_compact(F.array(
        F.when((entropy >= ENTROPY_MIN) & (F.col("color_count") >= COLORS_MIN), "color-diversity"),
        F.when((deviation >= DEVIATION_MIN) & (F.col("flat_ratio") <= FLAT_MAX), "continuous-tone"),
        F.when((entropy >= DARK_ENTROPY_MIN) & (deviation >= DEVIATION_MIN)
               & (F.col("orientation_entropy") >= ORIENTATION_MIN), "distributed-detail")))
    return stats.withColumn("matched_routes", routes).withColumn("eligible", F.size("matched_routes") > 0)


AREA = Grid("_aw", "_ah")


def around(tiles: DataFrame, grid: Grid, gray: str) -> DataFrame:
    """Each region (columns x0, y0, x1, y1) with the part of its picture that judges it: the region and a padding of
    two fifths of its longer side, 16 at least. `gray` is cut to it, the corners are whole pixels in it, and _aw and
    _ah are its size; all pixels are kept, at any size."""
    x0, y0, x1, y1 = grid.snapped(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    region = tiles.withColumns({"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1, "_w": grid.width, "_h": grid.height})
    padding = F.greatest(F.lit(16), F.bround(F.greatest(F.expr("_x1 - _x0"), F.expr("_y1 - _y0")) * 0.4).cast("int"))
    sides = region.withColumn("_pad", padding).withColumns({
        "_ax": F.greatest(F.expr("_x0 - _pad"), F.lit(0)), "_ay": F.greatest(F.expr("_y0 - _pad"), F.lit(0)),
        "_aw": F.least(F.expr("_x1 + _pad"), F.col("_w")), "_ah": F.least(F.expr("_y1 + _pad"), F.col("_h"))})
    sides = sides.withColumns({"_aw": F.expr("_aw - _ax"), "_ah": F.expr("_ah - _ay")})
    rows = F.transform(F.sequence(F.lit(0), F.expr("_ah - 1")), lambda y: F.slice(gray, ((F.col("_ay") + y) * F.col("_w") + F.col("_ax") + 1).cast("int"), F.col("_aw")))
    return sides.withColumns({
        gray: F.flatten(rows), "x0": F.expr("_x0 - _ax"), "x1": F.expr("_x1 - _ax"), "y0": F.expr("_y0 - _ay"), "y1": F.expr("_y1 - _ay"),
    }).drop("_x0", "_y0", "_x1", "_y1", "_pad", "_ax", "_ay", "_w", "_h")


def ring() -> Column:
    """Whether a pixel of the area is more than two away from the region."""
    return ~AREA.inside(F.col("pos"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")], grow=2)


def texture_p90(tiles: DataFrame, image: list[str], grid: Grid, gray: str) -> DataFrame:
    """Pixels of the context, and the 90th percentile of their smoothed Laplacian as a share of 30 (0 without context).

    The percentile is taken from counts of at most 1,021 whole values per region.
    """
    area = around(tiles, grid, gray)
    smooth = area.select(*image, "_aw", "_ah", "x0", "y0", "x1", "y1", AREA.blurred(F.col(gray)).alias("_s"))
    value = F.when(ring(), F.abs(AREA.laplacian(F.col("_s"))).cast("int"))
    counts = unroll(smooth, AREA).select(*image, value.alias("_v")).groupBy(*image, "_v").agg(F.count(F.lit(1)).alias("_n"))
    context = F.col("_v").isNotNull()
    return counts.groupBy(*image).agg(
        F.coalesce(F.sum(F.when(context, F.col("_n"))), F.lit(0)).alias("context_pixels"),
        F.least(F.coalesce(F.percentile("_v", 0.9, F.col("_n")) / TEXTURE_NORM, F.lit(0.0)), F.lit(1.0)).alias("texture_score"))


def edge_density(tiles: DataFrame, image: list[str], grid: Grid, gray: str, magnitude: float) -> DataFrame:
    """Share of context pixels whose gradient reaches a magnitude."""
    area = around(tiles, grid, gray).select(*image, "_aw", "_ah", "x0", "y0", "x1", "y1", gray)
    strong = F.col("_size") >= magnitude
    return with_gradient(unroll(area, AREA), AREA, gray).groupBy(*image).agg(
        F.coalesce(F.avg(F.when(ring(), strong.cast("double"))), F.lit(0.0)).alias("edge_density"))


def context_periodicity(tiles: DataFrame, image: list[str], grid: Grid, gray: str) -> DataFrame:
    """The largest periodicity of the strips around a region: above and below over the whole width of the area, left and
    right beside it, each averaged along rows and along columns; 0 without context."""
    area = around(tiles, grid, gray).select(*image, "_aw", "_ah", "x0", "y0", "x1", "y1", gray)
    x, y = F.col("_x"), F.col("_y")
    strip = (F.when(y < F.col("y0"), 0).when(y >= F.col("y1"), 1).when(x < F.col("x0"), 2).when(x >= F.col("x1"), 3))
    lines = F.explode(F.array(F.struct(F.lit(0).alias("along"), x.alias("at")), F.struct(F.lit(1).alias("along"), y.alias("at"))))
    means = (unroll(area, AREA).select(*image, strip.alias("_strip"), lines.alias("_l"), F.get(gray, F.col("pos")).alias("_v")).where("_strip IS NOT NULL")
             .groupBy(*image, "_strip", "_l").agg(F.avg("_v").alias("_v")))
    signals = means.groupBy(*image, "_strip", "_l.along").agg(  # as long as a side of the area
        F.transform(F.sort_array(F.collect_list(F.struct("_l.at", "_v"))), lambda v: v["_v"]).alias("_signal"))
    found = periodicity(signals, [*image, "_strip", "along"], "_signal").groupBy(*image).agg(F.max("periodicity").alias("periodicity"))
    return tiles.select(*image).distinct().join(found, image, "left").fillna(0.0, ["periodicity"])


def complexity_level(texture: Column, edges: Column, periodic: Column, structure: Column, context: Column) -> Column:
    """high, review or low; without context pixels nothing can be told, which is for review."""
    high = (((periodic >= PERIODIC_MIN) & (texture >= PERIODIC_TEXTURE_MIN)) | (structure >= STRUCTURE_MIN) | (edges >= EDGE_HIGH))
    return (F.when(context == 0, "review").when(high, "high")
            .when((texture >= TEXTURE_REVIEW) | (edges >= EDGE_REVIEW), "review").otherwise("low"))


# The usual integer-weight kernels for the small sizes.
SMALL_KERNELS = {3: [1.0, 2.0, 1.0], 5: [1.0, 4.0, 6.0, 4.0, 1.0], 7: [1.0, 3.5, 7.0, 9.0, 7.0, 3.5, 1.0]}


def smoothing_weights(length: Column) -> Column:
    """Weights that add up to one for the trend of a signal of the given length: an eighth of it, odd, 3 at least."""
    size = F.greatest(F.lit(3), F.floor(length / 8).cast("int").bitwiseOR(F.lit(1)))
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    half = F.floor(size / 2)
    weights = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.exp(-F.pow(i - half, F.lit(2)) / (2 * sigma * sigma)))
    for n, small in SMALL_KERNELS.items():
        weights = F.when(size == n, F.array(*[F.lit(w) for w in small])).otherwise(weights)
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.transform(weights, lambda w: w / total)


def periodicity(signals: DataFrame, image: list[str], signal: str) -> DataFrame:
    """Largest absolute autocorrelation over lags 3..32, at most half the length, after the trend is taken out; 0 below 12 values."""
    rows = signals.select(*image, F.col(signal).alias("_s"), F.size(signal).alias("_n"))
    rows = rows.withColumn("_k", smoothing_weights(F.col("_n"))).withColumn("_half", F.floor(F.size("_k") / 2).cast("int"))
    line = Grid("_n", 1)

    def trend(pos: Column) -> Column:
        parts = F.transform("_k", lambda w, i: w * F.get("_s", line.mirror(pos + i - F.col("_half"), F.col("_n")).cast("int")))
        return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)

    rest = rows.select(*image, "_n", F.transform("_s", lambda v, pos: v - trend(pos)).alias("_v"))
    energy = F.aggregate("_v", F.lit(0.0), lambda acc, v: acc + v * v)
    lags = F.when(F.col("_n") >= 12, F.sequence(F.lit(3), F.least(F.lit(32), F.floor(F.col("_n") / 2).cast("int"))))
    pairs = (rest.withColumn("_energy", energy).withColumn("_lag", F.explode_outer(lags))
             .withColumn("_i", F.explode_outer(F.sequence(F.lit(0), F.col("_n") - 1 - F.col("_lag")))))
    a, b = F.get("_v", F.col("_i")), F.get("_v", F.col("_i") + F.col("_lag"))
    sums = pairs.groupBy(*image, "_lag").agg(
        F.sum(a * b).alias("_ab"), F.sqrt(F.sum(a * a) * F.sum(b * b)).alias("_d"), F.max("_energy").alias("_e"))
    score = F.when((F.col("_e") >= 1e-3) & (F.col("_d") > 1e-6), F.abs("_ab") / F.col("_d"))
    return sums.groupBy(*image).agg(F.least(F.coalesce(F.max(score), F.lit(0.0)), F.lit(1.0)).alias("periodicity"))


def luma_delta(tiles: DataFrame, image: list[str], grid: Grid, gray: str) -> DataFrame:
    """Difference of mean luma inside the region and in its padded surroundings, and the low-contrast flag."""
    pos = F.col("pos")
    tiles = tiles.withColumns(dict(zip(("x0", "y0", "x1", "y1"), grid.snapped(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]), strict=True)))
    sides = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    longer = F.greatest(sides[2] - sides[0], sides[3] - sides[1])
    padding = F.greatest(F.lit(16), F.bround(longer * 0.4).cast("int"))
    inner = grid.inside(pos, *sides)
    outer = grid.inside(pos, sides[0] - padding, sides[1] - padding, sides[2] + padding, sides[3] + padding) & ~inner
    value = F.get(F.col(gray), pos)
    difference = F.abs(F.avg(F.when(inner, value)) - F.avg(F.when(outer, value))) / 255
    means = unroll(tiles, grid).groupBy(*image).agg(F.round(F.coalesce(difference, F.lit(0.0)), 4).alias("mean_luma_delta"))
    return means.withColumn("low_contrast", F.col("mean_luma_delta") < LOW_CONTRAST)


def reconstruction(tiles: DataFrame, image: list[str], grid: Grid, clean: list[str], marked: list[str], repaired: list[str], mask: str) -> DataFrame:
    """Errors of a repaired picture against the clean one inside, around and outside the mask, averaged over the channels.

    Pictures are one array per channel. A pixel counts as changed if any of its channels is.
    """
    pos = F.col("pos")
    c, m, r = [[F.get(F.col(name), pos) for name in names] for names in (clean, marked, repaired)]

    def mean(values: list[Column]) -> Column:
        total = values[0]
        for v in values[1:]:
            total = total + v
        return total / len(values)

    inside = F.get(F.col(mask), pos)
    edge = inside & ~F.get("_core", pos)
    error = mean([F.abs(x - y) for x, y in zip(r, c, strict=True)])
    square = mean([(x - y) * (x - y) for x, y in zip(r, c, strict=True)])
    before = mean([F.abs(x - y) for x, y in zip(m, c, strict=True)])
    changed = F.greatest(F.lit(0), *[(x != y).cast("int") for x, y in zip(r, m, strict=True)])
    cored = tiles.withColumn("_core", grid.eroded(F.col(mask), 2))
    sums = unroll(cored, grid).groupBy(*image).agg(
        F.avg(F.when(inside, before)).alias("input_masked_mae"), F.avg(F.when(inside, error)).alias("masked_mae"),
        F.sqrt(F.avg(F.when(inside, square))).alias("masked_rmse"), F.avg(F.when(edge, error)).alias("boundary_mae"),
        F.coalesce(F.avg(F.when(~inside, error)), F.lit(0.0)).alias("outside_mae"),
        F.avg(F.when(inside, changed.cast("double"))).alias("changed_mask_ratio"))
    psnr = F.when(F.col("masked_rmse") == 0, 99.0).otherwise(20 * F.log10(F.try_divide(F.lit(255.0), F.col("masked_rmse"))))
    better = F.coalesce(F.try_divide(F.col("input_masked_mae") - F.col("masked_mae"), F.col("input_masked_mae")) * 100, F.lit(0.0))
    shown = [F.round(n, 4).alias(n) for n in ("input_masked_mae", "masked_mae", "masked_rmse", "boundary_mae", "outside_mae", "changed_mask_ratio")]
    return sums.select(*image, *shown, F.round(psnr, 4).alias("masked_psnr_db"), F.round(better, 2).alias("improvement_percent"),
                       grade(F.col("masked_mae")).alias("grade"))


def image_warnings(risk: DataFrame, keep: list[str]) -> DataFrame:
    """Warnings per picture in reporting order, each with whether it must be acknowledged."""
    cover, level = F.col("coverage_ratio"), F.col("complexity_level")

    def warn(code: str, ack: bool) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(ack).alias("requires_acknowledgement"))

    found = F.array_compact(F.array(
        warn("IMAGE_OUTPUT_PNG", False),
        F.when(cover > HUGE_SELECTION, warn("IMAGE_MASK_OVER_25_PERCENT", True))
        .when(cover >= LARGE_SELECTION, warn("IMAGE_MASK_OVER_10_PERCENT", True)),
        F.when(F.col("low_contrast"), warn("IMAGE_LOW_CONTRAST_SELECTION", True)),
        F.when(level == "high", warn("IMAGE_COMPLEXITY_HIGH", True))
        .when(level == "review", warn("IMAGE_COMPLEXITY_REVIEW", False))))
    return risk.select(*keep, F.posexplode(found).alias("position", "_w")).select(*keep, "position", "_w.*")


def worst_level(df: DataFrame, image: list[str], level: str, order: tuple[str, ...] = ("low", "review", "high")) -> DataFrame:
    """The worst level over an image's regions."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(level))
    return df.groupBy(*image).agg(F.max_by(level, rank).alias(level))


WHOLE = 1 << 16


def gaussian_weights(radius: float) -> list[int]:
    """Whole-number weights of a Gaussian of this standard deviation, out of WHOLE, over three deviations each way; the middle takes the rounding."""
    reach = math.ceil(3 * radius)
    raw = [math.exp(-k * k / (2 * radius * radius)) for k in range(-reach, reach + 1)]
    weights = [round(WHOLE * w / sum(raw)) for w in raw]
    weights[reach] += WHOLE - sum(weights)
    return weights


def blurred_line(value: Callable[[int], Column], radius: float) -> Column:
    """One pass of a separable Gaussian, rounded to whole values; `value` gives the neighbour at a distance."""
    weights = gaussian_weights(radius)
    total = F.lit(WHOLE // 2)
    for i, w in enumerate(weights):
        total = total + value(i - len(weights) // 2) * w
    return F.floor(total / WHOLE)


def text_contrast(tiles: DataFrame, image: list[str], grid: Grid, channels: list[str], radius: float = TEXT_BLUR) -> DataFrame:
    """Pixels of long boxes that stand out, in any channel, from the Gaussian blur of the box.

    The blur is separable: one pass along the rows, kept as an array beside the picture, and one along the columns. Beyond
    the box its border pixels are repeated. Each pass is rounded to whole values.
    """
    pos = F.col("pos")
    x0, y0, x1, y1 = [F.col(c) for c in ("x0", "y0", "x1", "y1")]

    def within(v: Column, low: Column, high: Column) -> Column:
        return F.least(F.greatest(v, low), high - 1)

    def across(channel: str) -> Column:
        return F.transform(grid.positions, lambda p: blurred_line(
            lambda d: F.get(channel, (grid.y(p) * grid.width + within(grid.x(p) + d, x0, x1)).cast("int")), radius))

    def delta(channel: str) -> Column:
        blur = blurred_line(lambda d: F.get(f"_blur_{channel}", (within(grid.y(pos) + d, y0, y1) * grid.width + grid.x(pos)).cast("int")), radius)
        return F.abs(F.get(F.col(channel), pos) - blur)

    tiles = tiles.withColumns({f"_blur_{c}": across(c) for c in channels})

    long_box = (x1 - x0) / (y1 - y0) >= TEXT_ASPECT
    hit = long_box & grid.inside(pos, x0, y0, x1, y1) & (F.greatest(F.lit(0), *[delta(c) for c in channels]) >= TEXT_DELTA)
    return unroll(tiles, grid).groupBy(*image).agg(F.count_if(hit).alias("text_pixels"))


def neighbourhood(pixels: DataFrame, image: list[str], value: str = "gray") -> DataFrame:
    """Left, right, upper and lower neighbours in a pixel table; null at the edge.

    Windows run along one pixel row or column, so no group exceeds an image side.
    """
    row = Window.partitionBy(*image, "y").orderBy("x")
    column = Window.partitionBy(*image, "x").orderBy("y")
    return pixels.select("*", F.lag(value).over(row).alias("left"), F.lead(value).over(row).alias("right"),
                         F.lag(value).over(column).alias("up"), F.lead(value).over(column).alias("down"))
