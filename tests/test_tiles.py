import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import extension, tiles as px
from tests.conftest import rows

W, H = 13, 9


def picture(seed=0, high=256):
    return np.random.default_rng(seed).integers(0, high, size=(H, W))


def frame(spark, *images, **extra):
    data = [(i, [int(v) for v in img.ravel()]) for i, img in enumerate(images)]
    df = spark.createDataFrame(data, "img int, gray array<int>")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def sobel(img):
    p = np.pad(img, 1, mode="reflect").astype(float)
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return gx, gy


def entropy(counts):
    share = counts[counts > 0] / counts.sum()
    return float(-(share * np.log2(share)).sum())


def test_photo_statistics_equal_arrays(spark):
    img = picture(1, 40)
    got = px.photo_statistics(frame(spark, img), ["img"], px.Grid(W, H), "gray", ("gray", "gray", "gray")).first()
    gx, gy = sobel(img)
    size = np.hypot(gx, gy)
    strong = size >= 20
    hist = np.histogram(np.arctan2(gy[strong], gx[strong]), bins=18, range=(-np.pi, np.pi))[0].astype(float)
    assert abs(got.luminance_entropy - entropy(np.bincount(img.ravel()).astype(float))) < 1e-9
    assert got.color_count == np.unique(img // 16).size
    assert abs(got.luma_deviation - img.std()) < 1e-9
    assert abs(got.flat_ratio - (size < 10).mean()) < 1e-12
    assert abs(got.orientation_entropy - entropy(hist)) < 1e-9


def test_routes(spark):
    stats = spark.createDataFrame([(4.5, 128, 0.0, 1.0, 0.0), (3.4, 1, 25.0, 0.76, 3.9), (1.0, 1, 25.0, 0.75, 0.0), (4.4, 500, 24.9, 0.1, 4.0)],
                                  ["luminance_entropy", "color_count", "luma_deviation", "flat_ratio", "orientation_entropy"])
    got = [(list(r.matched_routes), r.eligible) for r in px.photo_routes(stats).collect()]
    assert got == [(["color-diversity"], True), (["distributed-detail"], True), (["continuous-tone"], True), ([], False)]


def test_texture_and_luma(spark):
    img = picture(2)
    src = frame(spark, img, x0=4, y0=2, x1=7, y1=5)
    p = np.pad(img, 1, mode="reflect").astype(float)
    smooth = sum(w * p[1 + dy:1 + dy + H, 1 + dx:1 + dx + W] for (dy, dx), w in {
        (a, b): (2 - abs(a)) * (2 - abs(b)) for a in (-1, 0, 1) for b in (-1, 0, 1)}.items())
    smooth = np.floor((smooth + 8) / 16)
    q = np.pad(smooth, 1, mode="reflect")
    lap = np.abs(q[:-2, 1:-1] + q[2:, 1:-1] + q[1:-1, :-2] + q[1:-1, 2:] - 4 * smooth)
    ring = np.ones((H, W), bool)
    ring[0:7, 2:9] = False
    got = px.texture_p90(src, ["img"], px.Grid(W, H), "gray").first()
    assert got.context_pixels == ring.sum()
    assert abs(got.texture_score - min(1, np.percentile(lap[ring], 90) / 30)) < 1e-9
    inner = np.zeros((H, W), bool)
    inner[2:5, 4:7] = True
    delta = px.luma_delta(src, ["img"], px.Grid(W, H), "gray").first()
    assert abs(delta.mean_luma_delta - round(abs(img[inner].mean() - img[~inner].mean()) / 255, 4)) < 1e-9
    whole = px.luma_delta(frame(spark, img, x0=0, y0=0, x1=W, y1=H), ["img"], px.Grid(W, H), "gray").first()
    assert (whole.mean_luma_delta, whole.low_contrast) == (0.0, True)


def test_periodicity_finds_stripes(spark):
    n = 64
    stripes = [int(100 + 50 * (i % 4 < 2)) for i in range(n)]
    flat = [7] * n
    df = spark.createDataFrame([(0, stripes), (1, flat)], "img int, gray array<int>")
    got = dict(rows(px.periodicity(df, ["img"], "gray")))
    assert got[0] > 0.95 and got[1] == 0.0
    assert dict(rows(px.periodicity(df.withColumn("gray", F.slice("gray", 1, 11)), ["img"], "gray"))) == {0: 0.0, 1: 0.0}


def test_reconstruction(spark):
    clean, mask = picture(3), np.zeros((H, W), bool)
    mask[1:8, 2:9] = True
    marked = np.where(mask, np.minimum(clean + 30, 255), clean)
    repaired = np.where(mask, clean + 3, clean)
    core = np.zeros_like(mask)
    core[3:6, 4:7] = True
    df = spark.createDataFrame([(1, *[[int(v) for v in a.ravel()] for a in (clean, marked, repaired)], [bool(v) for v in mask.ravel()])],
                               "img int, c array<int>, m array<int>, r array<int>, mask array<boolean>")
    got = px.reconstruction(df, ["img"], px.Grid(W, H), ["c"], ["m"], ["r"], "mask").first()
    error = np.abs(repaired - clean)
    assert got.masked_mae == 3.0 and got.outside_mae == 0.0 and got.grade == "excellent"
    assert got.boundary_mae == error[mask & ~core].mean() and got.changed_mask_ratio == round((repaired != marked)[mask].mean(), 4)
    assert abs(got.masked_psnr_db - round(20 * np.log10(255 / 3), 4)) < 1e-9
    same = px.reconstruction(df, ["img"], px.Grid(W, H), ["c"], ["c"], ["c"], "mask").first()
    assert (same.masked_psnr_db, same.improvement_percent) == (99.0, 0.0)
    at_corner = mask.copy()
    at_corner[0:4, 0:4] = True
    flags = frame(spark, at_corner.astype(int)).withColumn("f", F.transform("gray", lambda v: v == 1))
    eroded = np.array(flags.select(px.Grid(W, H).eroded(F.col("f"), 2).alias("e")).first().e).reshape(H, W)
    padded = np.pad(at_corner, 2, constant_values=True)
    wanted = np.all([padded[2 + dy:2 + dy + H, 2 + dx:2 + dx + W] for dy in range(-2, 3) for dx in range(-2, 3)], axis=0)
    assert (eroded == wanted).all()


def test_warning_thresholds(spark):
    risk = spark.createDataFrame([(0, 0.25, False, "low"), (1, 0.10, True, "high"), (2, 0.0999, False, "review"), (3, 0.2501, False, "low")],
                                 "img int, coverage_ratio double, low_contrast boolean, complexity_level string")
    got = px.image_warnings(risk, ["img"]).filter("code <> 'IMAGE_OUTPUT_PNG'").orderBy("img", "position").select("img", "code", "requires_acknowledgement")
    assert [tuple(r) for r in got.collect()] == [
        (0, "IMAGE_MASK_OVER_10_PERCENT", True), (1, "IMAGE_MASK_OVER_10_PERCENT", True), (1, "IMAGE_LOW_CONTRAST_SELECTION", True),
        (1, "IMAGE_COMPLEXITY_HIGH", True), (2, "IMAGE_COMPLEXITY_REVIEW", False), (3, "IMAGE_MASK_OVER_25_PERCENT", True)]


def test_gated_call_skips_rejected_rows(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "img int")
    gate = spark.createDataFrame([(1, True), (2, False)], "img int, ok boolean")

    def localize(batches):
        for batch in batches:
            assert set(batch["img"]) <= {1}
            yield batch.assign(label="mark")

    got = extension.gated(images, gate, ["img"], "ok", localize, "img int, label string")
    assert rows(got) == [(1, "mark"), (2, None), (3, None)]


def test_worst_level_and_neighbours(spark):
    levels = spark.createDataFrame([(1, "low"), (1, "high"), (1, "review"), (2, "low")], ["img", "level"])
    assert rows(px.worst_level(levels, ["img"], "level")) == [(1, "high"), (2, "low")]
    grid = spark.createDataFrame([(1, y, x, 10 * y + x) for y in range(2) for x in range(2)], ["img", "y", "x", "gray"])
    got = px.neighbourhood(grid, ["img"]).filter("y = 0 AND x = 1").select("left", "right", "up", "down").first()
    assert tuple(got) == (0, None, None, 11)


def sized(spark, *images, regions):
    data = [(i, [int(v) for v in img.ravel()], img.shape[1], img.shape[0], *map(float, r)) for i, (img, r) in enumerate(zip(images, regions, strict=True))]
    return spark.createDataFrame(data, "img int, gray array<int>, w int, h int, x0 double, y0 double, x1 double, y1 double")


def context(img, region):
    """The padded area around a region on whole pixels, its ring mask, and the region inside it."""
    h, w = img.shape
    x0, y0, x1, y1 = max(0, int(np.floor(region[0]))), max(0, int(np.floor(region[1]))), min(w, int(np.ceil(region[2]))), min(h, int(np.ceil(region[3])))
    pad = max(16, round(max(x1 - x0, y1 - y0) * 0.4))
    ax, ay = max(0, x0 - pad), max(0, y0 - pad)
    area = img[ay:min(h, y1 + pad), ax:min(w, x1 + pad)]
    inner = (x0 - ax, y0 - ay, x1 - ax, y1 - ay)
    ring = np.ones(area.shape, bool)
    ring[max(0, inner[1] - 2):inner[3] + 2, max(0, inner[0] - 2):inner[2] + 2] = False
    return area, ring, inner


def test_pictures_of_any_size_in_one_table(spark):
    images = [np.random.default_rng(5).integers(0, 256, size=(40, 70)), np.random.default_rng(6).integers(0, 90, size=(64, 1)), picture(7)]
    regions = [(30.5, 20.2, 33.0, 22.0), (0, 0, 1, 64), (4, 2, 7, 5)]
    src, grid = sized(spark, *images, regions=regions), px.Grid("w", "h")
    stats = {r.img: r for r in px.photo_statistics(src, ["img"], grid, "gray", ("gray", "gray", "gray")).collect()}
    texture = {r.img: r for r in px.texture_p90(src, ["img"], grid, "gray").collect()}
    edges = dict(rows(px.edge_density(src, ["img"], grid, "gray", 120.0)))
    periods = dict(rows(px.context_periodicity(src, ["img"], grid, "gray")))
    for i, (img, region) in enumerate(zip(images, regions, strict=True)):
        assert abs(stats[i].luma_deviation - img.std()) < 1e-9
        area, ring, inner = context(img, region)
        assert texture[i].context_pixels == ring.sum()
        if not ring.any():
            assert texture[i].texture_score == edges[i] == periods[i] == 0.0
            continue
        p = np.pad(area, 1, mode="reflect").astype(float)
        smooth = sum((2 - abs(a)) * (2 - abs(b)) * p[1 + a:1 + a + area.shape[0], 1 + b:1 + b + area.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1))
        q = np.pad(np.floor((smooth + 8) / 16), 1, mode="reflect")
        lap = np.abs(q[:-2, 1:-1] + q[2:, 1:-1] + q[1:-1, :-2] + q[1:-1, 2:] - 4 * q[1:-1, 1:-1])
        assert abs(texture[i].texture_score - min(1, np.percentile(lap[ring], 90) / 30)) < 1e-9
        gx, gy = sobel(area)
        assert abs(edges[i] - (np.hypot(gx, gy)[ring] >= 120).mean()) < 1e-9
    level = src.select("img", px.complexity_level(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0)).alias("risk"))
    assert {r.risk for r in level.collect()} == {"review"}


def test_stripes_beside_a_region(spark):
    stripes = np.tile(np.where(np.arange(90) % 6 < 3, 40, 200), (60, 1))
    flat = np.full((60, 90), 9)
    got = dict(rows(px.context_periodicity(sized(spark, stripes, flat, regions=[(40, 25, 50, 35)] * 2), ["img"], px.Grid("w", "h"), "gray")))
    assert got[0] > 0.9 and got[1] == 0.0


def test_regions_are_whole_pixels(spark):
    img = picture(8)
    got = px.luma_delta(sized(spark, img, regions=[(4.5, 2.0, 6.2, 5.0)]), ["img"], px.Grid("w", "h"), "gray").first()
    inner = np.zeros((H, W), bool)
    inner[2:5, 4:7] = True
    assert got.mean_luma_delta == round(abs(img[inner].mean() - img[~inner].mean()) / 255, 4)


def test_channels_count_together(spark):
    clean = [[10, 20, 30, 40]] * 3
    repaired = [[10, 20, 30, 40], [10, 26, 30, 40], [10, 20, 33, 40]]
    df = spark.createDataFrame([(1, *clean, *repaired, [False, True, True, False])], "img int, a array<int>, b array<int>, c array<int>, "
                               "x array<int>, y array<int>, z array<int>, mask array<boolean>")
    got = px.reconstruction(df, ["img"], px.Grid(2, 2), ["a", "b", "c"], ["a", "b", "c"], ["x", "y", "z"], "mask").first()
    assert got.masked_mae == 1.5 and got.changed_mask_ratio == 1.0 and got.masked_rmse == round((45 / 6) ** 0.5, 4)
    one = spark.createDataFrame([(1, [0] * 12, [0, 99] * 6, 0, 0, 12, 1)], "img int, r array<int>, g array<int>, x0 int, y0 int, x1 int, y1 int")
    assert px.text_contrast(one, ["img"], px.Grid(12, 1), ["r"]).first().text_pixels == 0
    assert px.text_contrast(one, ["img"], px.Grid(12, 1), ["r", "g"]).first().text_pixels == 12


def test_the_blur_is_a_separable_gaussian(spark):
    """Against plain Python on whole numbers: clamped borders, boxes inside a larger picture."""
    import random

    weights = px.gaussian_weights(1.5)
    assert sum(weights) == px.WHOLE and weights == weights[::-1] and len(weights) == 11 and weights[5] == max(weights)
    rng = random.Random(3)
    w, h, (x0, y0, x1, y1) = 20, 6, (2, 1, 17, 4)
    g = [rng.randrange(256) for _ in range(w * h)]

    def one(pick):
        return (sum(k * pick(d - 5) for d, k in enumerate(weights)) + px.WHOLE // 2) // px.WHOLE

    rows_ = [one(lambda d, x=i % w, y=i // w: g[y * w + min(max(x + d, x0), x1 - 1)]) for i in range(w * h)]
    wanted = sum(abs(g[y * w + x] - one(lambda d, x=x, y=y: rows_[min(max(y + d, y0), y1 - 1) * w + x])) >= 20 for x in range(x0, x1) for y in range(y0, y1))
    tile = spark.createDataFrame([(1, g, x0, y0, x1, y1)], "img int, r array<int>, x0 int, y0 int, x1 int, y1 int")
    assert px.text_contrast(tile, ["img"], px.Grid(w, h), ["r"]).first().text_pixels == wanted > 0


@pytest.mark.parametrize("n", [0, 1, 200, 4000])
def test_color_sketches_merge_within_their_bound(spark, n):
    colors = spark.range(n * 3).selectExpr("id % 4 AS img", "id % 2 AS source", f"cast(id % greatest({n}, 1) AS bigint) AS color")
    got = px.color_rollup(px.color_sketches(colors, ["img", "source"]), ["source"]).collect()
    exact = {r[0]: r[1] for r in colors.groupBy("source").agg(F.count_distinct("color")).collect()}
    assert {r["source"] for r in got} == set(exact)
    assert all(abs(r["colors"] - exact[r["source"]]) <= 0.049 * exact[r["source"]] + 0.5 for r in got)
