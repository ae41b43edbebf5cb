"""Joins of boxes on the same page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.boxes import Box, intersection, iou, overlaps
from palimpsest.operators.skew import BLOCK, SALTS, spread
from palimpsest.session import cut_lineage

BOX = ["x0", "y0", "x1", "y1"]
CELL = 256
DIRECT = 250_000  # comparisons on a page, or its rows, from which on it is cut by the grid
STEP = 4  # how much wider the cells of the next level are
PLACE = ["_lx", "_ly", "_tx", "_ty", "_cx", "_cy"]

Levels = list[tuple[int, int]]


def level(low: Column, high: Column, cell: int) -> Column:
    """The first level whose cells are as wide as the span; cells of level n are cell * STEP ** n wide."""
    size = high - low
    return F.when(size <= cell, 0).otherwise(F.ceil(F.log(size / cell) / F.log(F.lit(float(STEP)))).cast("int"))


def levels_of(left: DataFrame, right: DataFrame, cell: int) -> tuple[Levels, Levels]:
    """The pairs of levels (across, down) in use on both sides; a few tens where sizes differ by a factor of millions."""
    def own(df: DataFrame, box: Box, side: int) -> DataFrame:
        return df.select(F.lit(side).alias("side"), level(box.x0, box.x1, cell).alias("x"), level(box.y0, box.y1, cell).alias("y"))

    used = own(left, Box.of(), 0).unionByName(own(right, Box.of("r_"), 1)).where("x is not null and y is not null").distinct().collect()
    return tuple([(r["x"], r["y"]) for r in sorted(used) if r["side"] == side] for side in (0, 1))


def cells(df: DataFrame, box: Box, cell: int, others: Levels, both: bool) -> DataFrame:
    """One row per grid cell in which the box can meet a box of the levels `others`, with the columns PLACE.

    A box lives at the level of its width across and of its height down, where it touches two cells each way at most. Two boxes meet
    at the coarser of their levels, so a box also stands in the cells of coarser levels that the other side uses. Tags
    keep boxes apart that both stand at a coarser level only: what lives at a level is A on the side that is not `both`, and A and B on
    the other one; what is there as a guest is B on the first and A on the second.
    """
    x, y = level(box.x0, box.x1, cell), level(box.y0, box.y1, cell)
    met = F.array_distinct(F.array(*[F.struct(F.greatest(x, F.lit(u)).alias("x"), F.greatest(y, F.lit(v)).alias("y")) for u, v in others]))
    rows = df.withColumn("_l", F.explode(met)) if others else df.withColumn("_l", F.struct(x.alias("x"), y.alias("y"))).where("false")
    rows = rows.withColumns({"_lx": F.col("_l.x"), "_ly": F.col("_l.y")}).drop("_l")

    def tag(own: Column) -> Column:
        return F.explode(F.when(own, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))) if both else F.when(own, "A").otherwise("B")

    def span(low: Column, high: Column, name: str) -> Column:
        size = width(name, cell)
        return F.explode(F.sequence(F.floor(low / size), F.greatest(F.ceil(high / size) - 1, F.floor(low / size))))

    rows = rows.withColumn("_tx", tag(F.col("_lx") == x)).withColumn("_ty", tag(F.col("_ly") == y))
    return rows.withColumn("_cx", span(box.x0, box.x1, "_lx")).withColumn("_cy", span(box.y0, box.y1, "_ly"))


def width(name: str, cell: int) -> Column:
    """The width of the cells of the level in a column."""
    return F.pow(F.lit(float(STEP)), F.col(name)) * cell


def crowded_pages(left: DataFrame, right: DataFrame, page: list[str], block: int) -> DataFrame:
    """The pages too crowded for comparing all their boxes in one task; few, because each of them has many rows.

    The counts combine before the shuffle, and no row is repeated for its cells to find out.
    """
    def rows(df: DataFrame, mine: int) -> DataFrame:
        return df.select(*page, F.lit(mine).alias("_l"), F.lit(1 - mine).alias("_r"))

    limit = float(min(DIRECT, block * block))
    sizes = rows(left, 1).unionByName(rows(right, 0)).groupBy(*page).agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"))
    many = (F.col("_nl").cast("double") * F.col("_nr") > limit) | (F.col("_nl") + F.col("_nr") > limit)
    return cut_lineage(sizes.filter(many).select(*page))


def box_pairs(
    left: DataFrame, right: DataFrame, page: list[str], cell: int = CELL, block: int = BLOCK
) -> DataFrame:
    """Pairs of boxes on one page that overlap with positive area.

    Boxes of a page are compared with each other, unless it is crowded. Then both sides are cut by a grid of several levels, so a crowded page is shared by many tasks, boxes
    far apart never meet, and a box makes a bounded number of rows whatever its size; crowded cells are salted. A pair that shares
    several cells is kept only in the cell with the corner of its overlap, so no
    later de-duplication is needed. Columns of the right side get the prefix r_.
    """
    renamed = right.select(*page, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in page])
    crowded = crowded_pages(left, renamed, page, block)
    if crowded.isEmpty():
        return left.join(renamed, page).filter(overlaps(Box.of(), Box.of("r_")))
    usual = left.join(crowded, page, "left_anti").join(renamed.join(crowded, page, "left_anti"), page).filter(overlaps(Box.of(), Box.of("r_")))
    return usual.unionByName(grid_pairs(left.join(crowded, page, "left_semi"), renamed.join(crowded, page, "left_semi"), page, cell, block))


def grid_pairs(left: DataFrame, renamed: DataFrame, page: list[str], cell: int, block: int) -> DataFrame:
    """The pairs of crowded pages, the right side's columns renamed."""
    keys = [*page, *PLACE]
    a, b = Box.of(), Box.of("r_")
    mine, theirs = levels_of(left, renamed, cell)
    salted_left, salted_right = spread(cells(left, a, cell, theirs, False), cells(renamed, b, cell, mine, True), keys, block)
    joined = salted_left.join(salted_right, [*keys, *SALTS])
    home = ((F.floor(F.greatest(a.x0, b.x0) / width("_lx", cell)) == F.col("_cx"))
            & (F.floor(F.greatest(a.y0, b.y0) / width("_ly", cell)) == F.col("_cy")))
    return joined.filter(overlaps(a, b) & home).drop(*PLACE, *SALTS)


def region_overlaps(regions: DataFrame, content: DataFrame, page: list[str], cell: int = CELL) -> DataFrame:
    """Each region with each protected content it overlaps, and the shared area."""
    return box_pairs(regions, content, page, cell).withColumn(
        "intersection_area", intersection(Box.of(), Box.of("r_")))


def shapes_meeting(left: DataFrame, right: DataFrame, page: list[str], rule: Callable[[Box, Box], Column],
                   cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """The different left boxes that satisfy a rule with any right box they share a cell with.

    A lookup ends at its first hit, so no pairs are listed however crowded a page is.
    """
    shape, keys = [*page, *BOX], [*page, *PLACE]
    shapes = left.select(*shape).distinct()
    renamed = right.select(*page, *[F.col(c).alias(f"r_{c}") for c in BOX]).distinct()
    a, b = Box.of(), Box.of("r_")
    own, others = levels_of(left, renamed, cell)
    mine, theirs = spread(cells(shapes, a, cell, others, False), cells(renamed, b, cell, own, True), keys, block)
    same_place = [mine[k] == theirs[k] for k in (*keys, *SALTS)]
    hit = rule(Box(*[mine[c] for c in BOX]), Box(*[theirs[f"r_{c}"] for c in BOX]))
    return mine.join(theirs, [*same_place, hit], "left_semi").select(*shape).distinct()


def meeting(left: DataFrame, right: DataFrame, page: list[str], rule: Callable[[Box, Box], Column], how: str,
            cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """The left rows that satisfy a rule with any right box of their page (`left_semi`), or with none (`left_anti`).

    On crowded pages equal boxes are looked up once.
    """
    crowded = crowded_pages(left, right, page, block)

    def compared(rows: DataFrame, others: DataFrame) -> DataFrame:
        renamed = others.select(*[F.col(c).alias(f"r_{c}") for c in (*page, *BOX)])
        same_page = [F.col(p) == F.col(f"r_{p}") for p in page]
        return rows.join(renamed, [*same_page, rule(Box.of(), Box.of("r_"))], how)

    if crowded.isEmpty():
        return compared(left, right)
    many = left.join(crowded, page, "left_semi")
    hits = shapes_meeting(many, right.join(crowded, page, "left_semi"), page, rule, cell, block)
    usual = compared(left.join(crowded, page, "left_anti"), right.join(crowded, page, "left_anti"))
    return usual.unionByName(many.join(hits, [*page, *BOX], how))


def outside(words: DataFrame, masks: DataFrame, page: list[str], cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """Words that overlap no mask."""
    return meeting(words, masks, page, overlaps, "left_anti", cell, block)


def iou_pairs(pred: DataFrame, truth: DataFrame, sample: list[str], min_iou: float = 0.0, cell: int = CELL) -> DataFrame:
    """Predicted and expected boxes of one sample with IoU above 0 and at least `min_iou`."""
    pairs = box_pairs(pred, truth, sample, cell).withColumn("iou", iou(Box.of(), Box.of("r_")))
    return pairs.filter(F.col("iou") >= min_iou)
