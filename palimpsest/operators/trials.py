"""Timed review trials: validity, per-workflow summaries and assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.boxes import finite
from palimpsest.functions.measures import ratio
from palimpsest.operators.audit import gates
from palimpsest.operators.prefix import numbered
from palimpsest.operators.quantile import exact_percentiles

# Workflows in their counter-balanced order, and accepted failure reasons.
WORKFLOWS = ("manual", "box", "refined")
FAILURE_REASONS = ("mask_not_usable", "editor_problem", "time_limit", "other")
# Gates of the timing audit.
TIMING_GATES = {"participants": 3, "paired_samples": 8, "failure_rate": 0.10, "to_manual": 0.75, "to_box": 0.90}


def trial_status() -> Column:
    """First rule a trial breaks (columns status, total_seconds, correction_seconds, failure_reason)."""
    status, total, fix = F.col("status"), F.col("total_seconds"), F.col("correction_seconds")
    reason = F.trim(F.coalesce("failure_reason", F.lit("")))
    failed = status == "failed"
    return (F.when(~F.coalesce(status.isin("completed", "failed"), F.lit(False)), "STATUS_INVALID")
            .when(~finite(total, fix) | (total <= 0) | (fix < 0) | (fix > total), "TIMING_INCONSISTENT")
            .when(failed & (reason == ""), "REASON_REQUIRED")
            .when(failed & ~reason.isin(*FAILURE_REASONS), "REASON_UNSUPPORTED")
            .when(~failed & (F.coalesce("failure_reason", F.lit("")) != ""), "REASON_NOT_ALLOWED").otherwise("OK"))


def workflow_summary(trials: DataFrame, workflow: str = "workflow") -> DataFrame:
    """Counts, failure rate (1 without trials) and exact medians of completed trials per workflow."""
    done = F.col("status") == "completed"
    counts = trials.groupBy(workflow).agg(F.count(F.lit(1)).alias("trial_count"), F.count_if(done).alias("completed_count"))
    medians = exact_percentiles(trials.filter(done), [workflow], {
        f"{kind}_median_seconds": F.col(f"{kind}_seconds") for kind in ("total", "correction")}, 0.5)
    out = counts.join(medians, workflow, "left")
    failures = F.col("trial_count") - F.col("completed_count")
    return out.select(
        workflow, "trial_count", "completed_count", failures.alias("failure_count"),
        F.round(ratio(failures, F.col("trial_count")), 6).alias("failure_rate"),
        F.round("total_median_seconds", 6).alias("total_median_seconds"),
        F.round("correction_median_seconds", 6).alias("correction_median_seconds"))


def median_ratios(summary: DataFrame) -> DataFrame:
    """Refined against manual and box medians; null where a median is missing or 0."""
    of = {w: F.max(F.when(F.col("workflow") == w, F.col("total_median_seconds"))) for w in WORKFLOWS}
    return summary.agg(*[
        F.round(F.try_divide(of["refined"], of[w]), 6).alias(f"refined_to_{w}") for w in ("manual", "box")])


def paired_samples(trials: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Samples that were completed in every workflow."""
    done = trials.filter((F.col("status") == "completed") & F.col("workflow").isin(*WORKFLOWS))
    flags = done.groupBy(sample).agg(*[F.bool_or(F.col("workflow") == w).alias(w) for w in WORKFLOWS])
    return flags.filter(" AND ".join(WORKFLOWS)).select(sample)


def timing_report(trials: DataFrame, participant: str = "participant_id", sample: str = "sample_id") -> DataFrame:
    """The gates of the timing audit over valid trials: enough people and paired samples, at most so many failures in
    any workflow, and the refined median short enough against the manual and the box median."""
    people = trials.agg(F.count_distinct(participant).alias("participants"))
    paired = paired_samples(trials, sample).agg(F.count(F.lit(1)).alias("paired_samples"))
    summary = workflow_summary(trials)
    worst = summary.agg(F.max("failure_rate").alias("failure_rate"))
    ratios = median_ratios(summary).toDF("to_manual", "to_box")
    parts = [df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in df.columns])).alias("e"))
             for df in (people, paired, worst, ratios)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    figures = rows.agg(*[F.max(F.when(F.col("e.k") == g, F.col("e.v"))).alias(g) for g in TIMING_GATES])
    low = {g: TIMING_GATES[g] for g in ("participants", "paired_samples")}
    high = {g: v for g, v in TIMING_GATES.items() if g not in low}
    return gates(figures, low, maximum=high)


def timing_means(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"),
                                   *[F.round(F.avg(v), 6).alias(f"{v}_mean") for v in values])


def runtime_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, exact median and peak of positive run times; other rows are counted as rejects."""
    good = (F.col("duration_ms") > 0) & (F.col("peak_memory_mb") >= 0)
    kept = rows.filter(good)
    sums = rows.groupBy(*keys).agg(
        F.count_if(good).alias("n"), F.count_if(~F.coalesce(good, F.lit(False))).alias("rejected"),
        F.round(F.avg(F.when(good, F.col("duration_ms"))), 6).alias("duration_mean"),
        F.max(F.when(good, F.col("peak_memory_mb"))).alias("peak_memory_max"))
    median = exact_percentiles(kept, keys, {"duration_median": F.col("duration_ms")}, 0.5)
    return sums.join(median.withColumn("duration_median", F.round("duration_median", 6)), keys, "left")


def assignments(pairs: DataFrame, participant: str, sample: str, seed: str) -> DataFrame:
    """Counter-balanced workflow per participant, sample and block.

    `participant` is a pseudonym of hex digits (see functions/ids.py), whose first eight are the offset. A participant's samples are ordered by a seeded hash; the leading hash digits
    cut the order into chunks, so one participant may hold any share of the rows.
    """
    mix = F.sha2(F.concat_ws(":", F.lit(seed), F.col(participant).cast("string"), F.col(sample).cast("string")), 256)
    rows = pairs.select(participant, sample).distinct().withColumn("_mix", mix)
    chunk = F.conv(F.substring("_mix", 1, 3), 16, 10).cast("bigint")
    placed = numbered(rows, [participant], [F.col("_mix")], chunk, "_index")
    offset = F.conv(F.substring(participant, 1, 8), 16, 10).cast("bigint")
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(len(WORKFLOWS) - 1))))
    turn = (F.col("_index") + F.col("block") + offset) % len(WORKFLOWS)
    name = F.element_at(F.array(*[F.lit(w) for w in WORKFLOWS]), (turn + 1).cast("int"))
    task = F.substring(F.sha2(F.concat_ws(":", F.col(participant).cast("string"), F.lit(seed), F.col(sample).cast("string"), name), 256), 1, 20)
    return blocks.select(participant, sample, F.col("block").cast("bigint").alias("block"), name.alias("workflow"), task.alias("task_id"))


def progress(trials: DataFrame, participant: str) -> DataFrame:
    """Trials with a final status against all trials per participant (batch or stream)."""
    done = F.coalesce(F.col("status").isin("completed", "failed"), F.lit(False))
    return trials.groupBy(participant).agg(
        F.count_if(done).alias("completed"), F.count(F.lit(1)).alias("total"), F.bool_and(done).alias("finished"))
