"""One-to-one matching of predicted and expected boxes, and confirmation gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.boxes import Box, area_ratio, containment, iou, overlaps
from palimpsest.operators.overlap import CELL, iou_pairs, meeting
from palimpsest.operators.prefix import numbered
from palimpsest.operators.skew import SALTS, spread
from palimpsest.session import cut_lineage

# Default thresholds of matching and confirmation.
IOU_MATCH, CONTAINMENT, AREA_RATIO = 0.5, 0.9, 0.15
EDGES_PER_SAMPLE = 500
COMPARISONS, TURN = 100_000_000, 2_000


def matchable(pred: DataFrame, truth: DataFrame, sample: list[str], threshold: float = IOU_MATCH,
              cell: int = CELL) -> DataFrame:
    """The predicted rows that reach the threshold with any expected box.

    A lookup ends at its first hit. All other rows
    stay unmatched, so identifiers and the matching are only needed for what is left.
    """
    def near(a: Box, b: Box) -> Column:
        return overlaps(a, b) & (iou(a, b) >= threshold)

    return meeting(pred, truth, sample, near, "left_semi", cell)


def match_boxes(
    pred: DataFrame,
    truth: DataFrame,
    sample: list[str],
    confidence: str,
    pred_id: str,
    truth_id: str,
    truth_rank: str,
    threshold: float = IOU_MATCH,
    edges_per_sample: int = EDGES_PER_SAMPLE,
    cell: int = CELL,
    comparisons: int = COMPARISONS,
    turn: int = TURN,
) -> DataFrame:
    """Greedy matching: predictions by falling confidence (then id) take the best free
    expected box with IoU of at least `threshold`; equal IoU prefers the higher rank.

    Returns the matched pairs. Only pairs that reach the threshold can ever match, so
    those are listed. Samples with few of them are folded in one row each; larger ones
    are solved by rounds of proposals. A sample whose boxes would make more than
    `comparisons` pairs is worked off in turns of `turn` predictions. All ways give the
    same result.
    """
    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*sample).agg(F.count(F.lit(1)).alias(name))

    rule = (sample, confidence, pred_id, truth_id, truth_rank, threshold, edges_per_sample, cell)
    pairs = F.col("_p").cast("double") * F.col("_t")
    huge = cut_lineage(sizes(pred, "_p").join(sizes(truth, "_t"), sample).filter(pairs > comparisons).select(*sample))
    if huge.isEmpty():
        return match_listed(pred, truth, *rule)
    usual = match_listed(pred.join(huge, sample, "left_anti"), truth.join(huge, sample, "left_anti"), *rule)
    return usual.unionByName(match_in_turns(
        pred.join(huge, sample, "left_semi"), truth.join(huge, sample, "left_semi"), *rule, turn))


def match_listed(pred: DataFrame, truth: DataFrame, sample: list[str], confidence: str, pred_id: str, truth_id: str,
                 truth_rank: str, threshold: float, edges_per_sample: int, cell: int) -> DataFrame:
    """Matching over the list of all pairs that reach the threshold."""
    edges = cut_lineage(iou_pairs(pred, truth, sample, threshold, cell).select(
        *sample,
        F.struct((-F.col(confidence)).alias("c"), F.col(pred_id).alias("id")).alias("p"),
        F.struct((-F.col("iou")).alias("i"), (-F.col(f"r_{truth_rank}")).alias("r"),
                 F.col(f"r_{truth_id}").alias("id")).alias("t")))
    large = (edges.groupBy(*sample).agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") > edges_per_sample).select(*sample))
    matched = fold_small(edges.join(large, sample, "left_anti"), sample)
    if not large.isEmpty():
        matched = matched.unionByName(propose(edges.join(large, sample, "left_semi"), sample))
    return matched.select(*sample, F.col("p.id").alias(pred_id), F.col("t.id").alias(truth_id),
                          (-F.col("t.i")).alias("iou"))


def match_in_turns(pred: DataFrame, truth: DataFrame, sample: list[str], confidence: str, pred_id: str, truth_id: str,
                   truth_rank: str, threshold: float, edges_per_sample: int, cell: int, turn: int) -> DataFrame:
    """Matching of crowded samples, the first predictions first.

    No later prediction can take a box from an earlier one, so what a turn matches is
    final. After it, only predictions that still reach a free box are kept, by a lookup
    that lists no pairs; a crowded sample soon runs out of free boxes. A turn lists
    only the pairs of its own predictions.
    """
    left, rest, done = cut_lineage(truth), pred, None
    while True:
        rest = cut_lineage(numbered(matchable(rest, left, sample, threshold, cell), sample,
                                    [F.desc(confidence), F.col(pred_id)], None, "_turn"))
        if rest.isEmpty():
            break
        now = rest.filter(F.col("_turn") < turn).drop("_turn")
        got = cut_lineage(match_listed(now, left, sample, confidence, pred_id, truth_id, truth_rank, threshold,
                                       edges_per_sample, cell))
        done = got if done is None else done.unionByName(got)
        left = cut_lineage(left.join(got.select(*sample, truth_id), [*sample, truth_id], "left_anti"))
        rest = rest.filter(F.col("_turn") >= turn).drop("_turn")
    if done is None:
        return match_listed(pred.limit(0), truth, sample, confidence, pred_id, truth_id, truth_rank, threshold,
                            edges_per_sample, cell)
    return done


def fold_small(edges: DataFrame, sample: list[str]) -> DataFrame:
    """Walk a sample's pairs in order of prediction and take each one whose ends are free."""
    ordered = edges.groupBy(*sample).agg(F.sort_array(F.collect_list(F.struct("p", "t"))).alias("_e"))
    edge = "struct<p:{},t:{}>".format(*[edges.schema[c].dataType.simpleString() for c in ("p", "t")])

    def step(taken: Column, e: Column) -> Column:
        busy = F.exists(taken, lambda m: (m["p"] == e["p"]) | (m["t"]["id"] == e["t"]["id"]))
        return F.when(busy, taken).otherwise(F.array_append(taken, e))

    start = F.array().cast(f"array<{edge}>")
    return (ordered.select(*sample, F.explode(F.aggregate("_e", start, step)).alias("_m"))
            .select(*sample, "_m.p", "_m.t"))


def propose(edges: DataFrame, sample: list[str]) -> DataFrame:
    """Rounds of proposals over all pairs at once.

    Every prediction asks its best remaining box; a box keeps the earliest
    prediction that asked and strikes out all later ones for good. When a round
    strikes nothing, the standing proposals are the greedy matching, because all
    boxes rank the predictions in the same order. Each round is two
    combinable aggregations and a join, written once; every round but the last strikes a
    pair, so the rounds end by themselves.
    """
    left = cut_lineage(edges)
    size = left.count()
    while True:
        asked = left.groupBy(*sample, "p").agg(F.min("t").alias("t"))
        held = asked.groupBy(*sample, F.col("t.id").alias("_tid")).agg(F.min("p").alias("_holder"))
        kept = cut_lineage(
            left.withColumn("_tid", F.col("t.id")).join(held, [*sample, "_tid"], "left")
            .filter(F.col("_holder").isNull() | (F.col("p") <= F.col("_holder")))
            .drop("_tid", "_holder"))
        remaining = kept.count()
        if remaining == size:
            return asked
        left, size = kept, remaining


def sample_scores(corpus: DataFrame, pred: DataFrame, truth: DataFrame, matches: DataFrame, sample: list[str]) -> DataFrame:
    """Counts per sample of the corpus; samples without boxes stay in with zeros."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*sample).agg(F.count(F.lit(1)).alias(name))

    hits = matches.groupBy(*sample).agg(F.count(F.lit(1)).alias("true_positive"), F.sum("iou").alias("iou_sum"))
    joined = (corpus.join(counted(truth, "expected_count"), sample, "left")
              .join(counted(pred, "predicted_count"), sample, "left").join(hits, sample, "left")
              .fillna(0, ["expected_count", "predicted_count", "true_positive", "iou_sum"]))
    return joined.select(
        *corpus.columns, "expected_count", "predicted_count", "true_positive",
        (F.col("predicted_count") - F.col("true_positive")).alias("false_positive"),
        (F.col("expected_count") - F.col("true_positive")).alias("false_negative"),
        F.when(F.col("expected_count") > 0, "positive").otherwise("negative").alias("kind"), "iou_sum")


def best_match(cands: DataFrame, dets: DataFrame, sample: list[str]) -> DataFrame:
    """Three independent best values per candidate over all detections of its sample.

    `cands` holds one candidate per sample; detections are combined before the shuffle
    of the aggregation, and equal detection boxes are compared once.
    """
    shapes = dets.select(*sample, *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")]).distinct()
    c, d = Box.of(), Box.of("r_")
    best = {"best_iou": iou(c, d), "best_detection_containment": containment(d, c),
            "best_detection_area_ratio": area_ratio(d, c)}
    strong = (best["best_detection_containment"] >= CONTAINMENT) & (best["best_detection_area_ratio"] >= AREA_RATIO)
    # The salts of a crowded sample spread its detections; what they find is combined before the next shuffle.
    mine, theirs = spread(cands, shapes, sample)
    found = mine.join(theirs, [*sample, *SALTS]).groupBy(*sample).agg(
        *[F.max(v).alias(k) for k, v in best.items()], F.bool_or(strong).alias("contained"))
    return cands.join(found, sample, "left").fillna(0.0, list(best)).fillna(False, ["contained"])


def confirm(cands: DataFrame, dets: DataFrame, sample: list[str], threshold: float = IOU_MATCH,
            allow_contained: bool = True) -> DataFrame:
    """Accept a candidate when a detection has enough IoU, or lies inside it and is large enough."""
    by_iou = F.col("best_iou") >= threshold
    inside = F.col("contained") & F.lit(allow_contained)
    return best_match(cands, dets, sample).select(
        *sample, "best_iou", "best_detection_containment", "best_detection_area_ratio",
        (by_iou | inside).alias("accepted"),
        F.when(by_iou, "iou").when(inside, "contained_detection").otherwise("no_match").alias("decision_reason"))


def apply_gate(preds: DataFrame, decisions: DataFrame, sample: list[str], value: str, empty: Column,
               accepted: str = "accepted") -> DataFrame:
    """Keep every key; rejected or undecided samples get the empty prediction."""
    flags = decisions.select(*sample, F.col(accepted).alias("_ok"))
    return (preds.join(flags, sample, "left")
            .withColumn(value, F.when(F.col("_ok"), F.col(value)).otherwise(empty)).drop("_ok"))


def best_mask(masks: DataFrame, box: list[str], mask: str, score: str, index: str) -> DataFrame:
    """The mask with the highest score per box, the first one on equal scores."""
    return masks.groupBy(*box).agg(
        F.max_by(F.struct(mask, score, index), F.struct(F.col(score), -F.col(index))).alias("_b")).select(*box, "_b.*")
