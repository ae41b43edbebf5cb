import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import boxes as geo
from palimpsest.functions.boxes import Box
from palimpsest.operators import matching, overlap, regions
from tests.conftest import rows

BOX = "page int, x0 double, y0 double, x1 double, y1 double"


def table(spark, data, extra=""):
    return spark.createDataFrame(data, BOX + extra)


def test_touching_edges_do_not_overlap(spark):
    regions_ = table(spark, [(1, 0.0, 0.0, 10.0, 10.0)])
    content = table(spark, [(1, 10.0, 0.0, 20.0, 10.0), (1, 9.0, 9.0, 11.0, 11.0), (2, 1.0, 1.0, 2.0, 2.0)])
    got = overlap.region_overlaps(regions_, content, ["page"]).select("r_x0", "intersection_area")
    assert rows(got) == [(9.0, 1.0)]


def random_boxes(n, seed, pages=3, span=300.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.uniform(0, span), rng.uniform(0, span)
        out.append((0 if i % 3 == 0 else rng.randrange(pages), x, y, x + rng.uniform(1, 60), y + rng.uniform(1, 60)))
    return out


@pytest.mark.parametrize("cell,cap", [(16, 100_000), (64, 5), (10_000, 3)])
def test_grid_size_and_salts_do_not_change_pairs(spark, cell, cap):
    a, b = random_boxes(120, 1), random_boxes(150, 2)
    wanted = sorted((p, x0, q0) for p, x0, y0, x1, y1 in a for q, q0, r0, q1, r1 in b
                    if p == q and x0 < q1 and x1 > q0 and y0 < r1 and y1 > r0)
    got = overlap.box_pairs(table(spark, a), table(spark, b), ["page"], cell, cap).select("page", "x0", "r_x0")
    assert rows(got) == wanted
    outside = overlap.outside(table(spark, a), table(spark, b), ["page"], cell).select("page", "x0")
    hit = {(p, x0) for p, x0, _ in wanted}
    assert rows(outside) == sorted((p, x0) for p, x0, *_ in a if (p, x0) not in hit)


def sized_boxes(n, seed):
    """Boxes from a unit to ten million units, thin ones among them, on two pages."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w, h = 10 ** rng.uniform(0, 7), 10 ** rng.uniform(0, 7)
        x, y = rng.uniform(-1e7, 1e7), rng.uniform(-1e7, 1e7)
        if i % 3 == 0:  # near the origin, where small boxes meet
            x, y = rng.uniform(-300, 300), rng.uniform(-300, 300)
        out.append((i % 2, x, y, x + w, y + h))
    return [*out, (0, -1e7, -1e7, 1e7, 1e7), (1, 0.0, 0.0, 256.0, 256.0), (1, 256.0, 256.0, 1280.0, 257.0), (0, 5.0, 5.0, 5.0, 9.0)]


@pytest.mark.parametrize("block", [8_000, 6])
def test_boxes_of_all_sizes(spark, block):
    a, b = sized_boxes(150, 11), sized_boxes(170, 12)
    left, right = table(spark, a), table(spark, b)
    wanted = sorted((p, x0, q0) for p, x0, y0, x1, y1 in a for q, q0, r0, q1, r1 in b
                    if p == q and x0 < q1 and x1 > q0 and y0 < r1 and y1 > r0)
    assert rows(overlap.box_pairs(left, right, ["page"], block=block).select("page", "x0", "r_x0")) == wanted
    hit = {(p, x0) for p, x0, _ in wanted}
    assert rows(overlap.outside(left, right, ["page"], block=block).select("page", "x0")) == sorted((p, x0) for p, x0, *_ in a if (p, x0) not in hit)


def test_rows_of_a_box_do_not_grow_with_its_size(spark):
    sides = [table(spark, sized_boxes(300, seed)) for seed in (1, 2)]
    renamed = sides[1].select("page", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    mine, theirs = overlap.levels_of(sides[0], renamed, overlap.CELL)
    assert len(mine) <= 81
    left = overlap.cells(sides[0], Box.of(), overlap.CELL, theirs, False).groupBy("page", "x0", "y0").count()
    assert left.agg(F.max("count")).first()[0] <= 4 * len(theirs)
    huge = table(spark, [(1, 0.0, 0.0, 1e9, 1e9)])
    _, own = overlap.levels_of(huge, huge.select("page", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")]), overlap.CELL)
    assert overlap.cells(huge, Box.of(), overlap.CELL, own, False).count() <= 4
    assert overlap.box_pairs(huge, huge, ["page"]).count() == 1
    assert overlap.box_pairs(huge, huge.where("false"), ["page"]).count() == overlap.box_pairs(huge.where("false"), huge, ["page"]).count() == 0


def assert_greedy(pred, truth, found, threshold):
    """What defines the matching: one to one, enough overlap, and no prediction that a free box would have suited better.

    `pred` and `truth` are (box, order): the smaller order goes first or is preferred. A box is free for a prediction if no
    earlier one holds it.
    """
    def share(a, b):
        inner = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        return inner / sum((c[2] - c[0]) * (c[3] - c[1]) for c in (a, b)) if inner == 0 else inner / (
            sum((c[2] - c[0]) * (c[3] - c[1]) for c in (a, b)) - inner)

    holder = {j: i for i, j in found}
    taken = dict(found)
    assert len(holder) == len(taken) == len(found)
    for i, (box, turn) in enumerate(pred):
        got = taken.get(i)
        value = share(box, truth[got][0]) if got is not None else threshold
        assert value >= threshold
        for j, (other, rank) in enumerate(truth):
            if j != got and (j not in holder or pred[holder[j]][1] > turn):
                better = share(box, other)
                assert better < value or (better == value and got is not None and rank > truth[got][1])


def matched(spark, pred, truth, threshold, **how):
    """Match random boxes (box, confidence) and (box,); ids follow the place in the list, ranks too."""
    p = spark.createDataFrame([(1, *b, c, i) for i, (b, c) in enumerate(pred)] + [(2, 0.0, 0.0, 4.0, 4.0, 1.0, 99)],
                              BOX + ", confidence double, pred_id int")
    t = spark.createDataFrame([(1, *b, i, i) for i, b in enumerate(truth)] + [(2, 0.0, 2.0, 4.0, 6.0, 99, 0)],
                              BOX + ", truth_id int, rank int")
    got = matching.match_boxes(p, t, ["page"], "confidence", "pred_id", "truth_id", "rank", threshold, **how)
    assert got.filter("page = 2").count() == (1 if threshold <= 1 / 3 else 0)
    low = float("inf")
    assert_greedy([(b, (low if c is None else -c, i)) for i, (b, c) in enumerate(pred)], [(b, -i) for i, b in enumerate(truth)],
                  [(r.pred_id, r.truth_id) for r in got.filter("page = 1").collect()], threshold)
    return got.filter("page = 1").count()


def square(x, y, side=10.0):
    return (float(x), float(y), x + side, y + side)


WAYS = [{}, {"edges_per_sample": 0}, {"comparisons": 100, "turn": 12}]  # folded in a row, by proposals, in turns


@pytest.mark.parametrize("how", WAYS)
def test_matching_is_greedy(spark, how):
    rng = random.Random(9)
    pred = [(square(rng.randrange(9), rng.randrange(9)), rng.choice([0.0, 0.25, 0.5, 1.0])) for _ in range(40)]
    assert matched(spark, pred, [square(rng.randrange(9), rng.randrange(9)) for _ in range(30)], 0.5, **how) > 10


def test_a_chain_of_displacements(spark):
    """Every prediction likes the box of the one before it better than its own."""
    truth = [square(0, 7 * i) for i in range(7)]
    pred = [(square(0, 7 * i + 3), 1 - i / 100) for i in range(6)]
    assert matched(spark, pred, truth, 0.3, edges_per_sample=0) == 6


def test_matchable_keeps_the_result(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (1, 90.0, 0.0, 94.0, 4.0)], BOX)
    t = spark.createDataFrame([(1, 1.0, 0.0, 5.0, 4.0), (1, 50.0, 0.0, 54.0, 4.0)], BOX)
    assert rows(matching.matchable(p, t, ["page"]).select("x0")) == [(0.0,)]


def test_scores_with_empty_samples(spark):
    corpus = spark.createDataFrame([(1,), (2,), (3,)], "page int")
    pred, truth = spark.createDataFrame([(1,), (2,), (2,)], "page int"), spark.createDataFrame([(1,), (1,)], "page int")
    matches = spark.createDataFrame([(1, 0.75)], "page int, iou double")
    got = matching.sample_scores(corpus, pred, truth, matches, ["page"]).select("page", "true_positive", "false_positive", "false_negative", "kind")
    assert rows(got) == [(1, 1, 0, 1, "positive"), (2, 0, 2, 0, "negative"), (3, 0, 0, 0, "negative")]


def test_confirmation_by_containment_and_area(spark):
    cands = table(spark, [(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 10.0, 10.0), (3, 0.0, 0.0, 10.0, 10.0), (4, 0.0, 0.0, 10.0, 10.0)])
    dets = table(spark, [(1, 0.0, 0.0, 5.0, 3.0), (2, 0.0, 0.0, 5.0, 2.8), (3, 0.0, 0.0, 10.0, 6.0)])
    got = matching.confirm(cands, dets, ["page"]).select("page", "accepted", "decision_reason")
    assert rows(got) == [(1, True, "contained_detection"), (2, False, "no_match"), (3, True, "iou"), (4, False, "no_match")]
    strict = matching.confirm(cands, dets, ["page"], allow_contained=False).select("page", "accepted")
    assert rows(strict) == [(1, False), (2, False), (3, True), (4, False)]


def test_best_mask_prefers_the_first_of_equals(spark):
    masks = spark.createDataFrame([("b", "m2", 0.5, 2), ("b", "m1", 0.5, 1), ("b", "m0", 0.1, 0)], "box string, mask string, score double, idx int")
    assert rows(matching.best_mask(masks, ["box"], "mask", "score", "idx").select("mask")) == [("m1",)]


def test_region_and_box_status(spark):
    frames = spark.createDataFrame([(1, 100.0, 50.0, "f")], "page int, width double, height double, frame_id string")
    nan = float("nan")
    data = [(1, 0.0, 0.0, 100.0, 50.0, "f"), (1, nan, 0.0, 1.0, 1.0, "f"), (1, 0.0, 0.0, 1.0, 1.0, "g"),
            (1, 5.0, 0.0, 5.0, 1.0, "f"), (2, 0.0, 0.0, 1.0, 1.0, "f"), (1, 0.0, 0.0, 101.0, 1.0, "f")]
    got = regions.region_status(table(spark, data, ", transform_id string"), frames, ["page"]).select("status")
    assert sorted(r.status for r in got.collect()) == ["INVALID_REGION"] * 2 + ["OK"] + ["PLAN_STALE"] * 3
    b = table(spark, [(1, 0.0, 0.0, 1.0, 1.0)], "")
    s = lambda label, conf: regions.box_status(Box.of(), F.lit(label), F.lit(conf), F.lit(9.0), F.lit(9.0))
    got = b.select(s("m", 1.0).alias("a"), s(" ", 1.0).alias("b"), s("m", 1.1).alias("c"), s("m", nan).alias("d")).first()
    assert tuple(got) == ("OK", "EMPTY_LABEL", "BAD_CONFIDENCE", "BAD_CONFIDENCE")


def test_mask_status_stops_at_the_first_shape(spark):
    frames = spark.createDataFrame([(m, 10.0, 10.0, "f") for m in range(5)], "m int, width double, height double, frame_id string")
    rects = spark.createDataFrame([(0, 1, 0.0, 0.0, 2.0, 2.0, "f"), (1, 2, 0.0, 0.0, 99.0, 2.0, "f"), (1, 1, 0.0, 0.0, float("inf"), 2.0, "f"),
                                   (3, 1, 0.0, 0.0, 2.0, 2.0, "f")], "m int, shape_no int, x0 double, y0 double, x1 double, y1 double, transform_id string")
    flat = [(0.0, 0.0), (5.0, 0.0), (9.0, 0.0)]
    polys = spark.createDataFrame([(2, 1, [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)], "f"), (3, 1, flat, "f")],
                                  "m int, shape_no int, points array<struct<x:double,y:double>>, transform_id string")
    assert rows(regions.mask_status(rects, polys, frames, "m")) == [
        (0, 1, "OK"), (1, 2, "INVALID_MASK"), (2, 1, "OK"), (3, 2, "INVALID_MASK"), (4, 0, "INVALID_MASK")]


def test_geometry(spark):
    row = spark.range(1).select(
        geo.poly_area(F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 3D))")).alias("area"),
        *[c.alias(f"e{i}") for i, c in enumerate(geo.expand(Box(F.lit(1.0), F.lit(2.0), F.lit(8.0), F.lit(9.0)), 5.0, F.lit(10.0), F.lit(20.0)))],
        *[c.alias(f"p{i}") for i, c in enumerate(geo.to_pixels(Box(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit(10.0), F.lit(10.0), F.lit(25), F.lit(25)))]).first()
    assert tuple(row) == (6.0, 0.0, 0.0, 10.0, 14.0, 2, 17, 5, 23)


def test_coverage_cap(spark):
    big = table(spark, [(1, 0.0, 0.0, 3.0, 1.0), (1, 0.0, 0.0, 31.0, 1.0)] + [(2, 0.0, 0.0, 1.0, 1.0)] * 101)
    got = regions.cap_coverage(big, ["page"], F.lit(100.0), F.lit(1.0)).groupBy("page", "status").count()
    assert rows(got) == [(1, "DROPPED_COVERAGE", 1), (1, "OK", 1), (2, "TOO_MANY_BOXES", 101)]


def test_usual_pages_are_compared_without_cells(spark):
    from palimpsest.operators.overlap import box_pairs, outside
    boxes = "page bigint, line int, x0 bigint, y0 bigint, x1 bigint, y1 bigint"
    data = [(p, i, i * 13 % 40, i * 11 % 30, i * 13 % 40 + 9, i * 11 % 30 + 6) for p in (1, 2, None) for i in range(5)]
    data += [(3, i, i * 5 % 37, i * 3 % 29, i * 5 % 37 + 8, i * 3 % 29 + 8) for i in range(40)]
    df = spark.createDataFrame(data, boxes)
    mine, theirs = df.filter("line % 2 = 0"), df.filter("line % 2 = 1")

    def meets(a, b):
        return a[0] is not None and a[0] == b[0] and a[2] < b[4] and a[4] > b[2] and a[3] < b[5] and a[5] > b[3]

    left, right = [r for r in data if r[1] % 2 == 0], [r for r in data if r[1] % 2]
    for block in (2, 10, 8_000):  # all pages crowded, one of them, none
        got = box_pairs(mine, theirs, ["page"], 16, block).select("page", "line", "r_line")
        assert rows(got) == sorted((a[0], a[1], b[1]) for a in left for b in right if meets(a, b))
        free = outside(mine, theirs, ["page"], 16, block).select("page", "line")
        assert set(rows(free)) == {(a[0], a[1]) for a in left if not any(meets(a, b) for b in right)}
    plan = outside(mine, theirs, ["page"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "_cx" not in plan
