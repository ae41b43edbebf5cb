"""Plans, operations, acknowledgements, task reports and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.measures import elapsed_seconds, structure_status
from palimpsest.operators.identity import mark_duplicates
from palimpsest.operators.prefix import numbered


def sorted_distinct(df: DataFrame, keys: list[str], value: str, chunk: Column | None = None) -> DataFrame:
    """The sorted distinct values per key as numbered rows (1 is the smallest)."""
    rows = numbered(df.select(*keys, value).distinct(), keys, [F.col(value)], chunk, "position")
    return rows.withColumn("position", (F.col("position") + 1).cast("bigint"))


def operation_status(ops: DataFrame, cands: DataFrame, plan: list[str], candidate: str = "candidate_id",
                     strategy: str = "strategy") -> DataFrame:
    """First rule a planned operation breaks; candidates bring classification and allowed_strategies."""
    marked = mark_duplicates(ops, [*plan, candidate], "_dup")
    joined = marked.join(cands.select(candidate, "classification", "allowed_strategies"), candidate, "left")
    return joined.withColumn(
        "status",
        F.when(F.col("_dup"), "DUPLICATE_CANDIDATE").when(F.col("classification").isNull(), "UNKNOWN_CANDIDATE")
        .when(~F.array_contains("allowed_strategies", F.col(strategy)), "STRATEGY_NOT_ALLOWED")
        .when(F.col("classification") == "content", "CONTENT_SELECTED").otherwise("OK")).drop("_dup")


def ambiguous_code(candidate: Column) -> Column:
    return F.concat(F.lit("AMBIGUOUS_CANDIDATE:"), candidate.cast("string"))


def acknowledgements(required: DataFrame, acknowledged: DataFrame, plan: str, code: str = "code") -> DataFrame:
    """Each code of a plan as OK, MISSING (required only) or UNKNOWN (acknowledged only)."""
    r = required.select(plan, code).distinct().withColumn("_r", F.lit(True))
    a = acknowledged.select(plan, code).distinct().withColumn("_a", F.lit(True))
    return r.join(a, [plan, code], "full_outer").select(
        plan, code, F.when(F.col("_r").isNull(), "UNKNOWN").when(F.col("_a").isNull(), "MISSING").otherwise("OK").alias("status"))


def acknowledgement_status(codes: DataFrame, plan: str) -> DataFrame:
    """A plan with unknown codes is invalid; otherwise missing ones are required."""
    return codes.groupBy(plan).agg(
        F.count_if(F.col("status") == "UNKNOWN").alias("n_unknown"), F.count_if(F.col("status") == "MISSING").alias("n_missing"),
    ).withColumn("status", F.when(F.col("n_unknown") > 0, "ACKNOWLEDGEMENT_INVALID")
                 .when(F.col("n_missing") > 0, "ACKNOWLEDGEMENT_REQUIRED").otherwise("OK"))


def freshness(plans: DataFrame, analyses: DataFrame, assets: DataFrame) -> DataFrame:
    """Plans whose asset or analysis is gone, or whose digests no longer agree.

    plans(plan_id, asset_id, analysis_id, asset_sha256), analyses(analysis_id, asset_id,
    asset_sha256), assets(asset_id, sha256).
    """
    a = assets.select("asset_id", F.col("sha256").alias("_now"))
    n = analyses.select("analysis_id", F.col("asset_id").alias("_of"), F.col("asset_sha256").alias("_then"))
    return plans.join(a, "asset_id", "left").join(n, "analysis_id", "left").select(
        "plan_id", F.when(F.col("_now").isNull(), "ASSET_NOT_FOUND")
        .when(F.col("_now") != F.col("asset_sha256"), "PLAN_STALE").when(F.col("_then").isNull(), "ANALYSIS_NOT_FOUND")
        .when((F.col("_of") != F.col("asset_id")) | (F.col("_then") != F.col("_now")), "PLAN_STALE").otherwise("OK").alias("status"))


TERMINAL = ("succeeded", "failed", "cancelled")
# The only columns a public report may carry.
PUBLIC = ("task_id", "plan_id", "status", "progress", "duration_seconds", "kind", "asset_id", "media_type", "size_bytes",
          "sha256", "artifact_count", "artifact_bytes", "source_page_count", "result_page_count", "error_code")


def task_report(tasks: DataFrame, plans: DataFrame, assets: DataFrame, artifacts: DataFrame, now: Column) -> DataFrame:
    """Tasks with plan, asset, duration and artifact totals, in one pass of joins.

    Artifacts are summed per task before the join; a task's list can be read from
    the artifact table itself.
    """
    role = F.col("role")
    sums = artifacts.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("artifact_count"), F.sum("size_bytes").alias("artifact_bytes"),
        F.count_if(role == "source_preview").alias("source_page_count"), F.count_if(role == "result_preview").alias("result_page_count"))
    open_task = ~F.col("status").isin(*TERMINAL)
    return (tasks.withColumn("duration_seconds", elapsed_seconds(F.col("created_at"), F.col("updated_at"), open_task, now))
            .join(plans, "plan_id").join(assets, "asset_id").join(sums, "task_id", "left")
            .fillna(0, ["artifact_count", "artifact_bytes", "source_page_count", "result_page_count"]))


def public_report(report: DataFrame) -> DataFrame:
    """The report without names, paths or messages; of an error only its code stays."""
    code = F.coalesce(F.get_json_object("error_json", "$.code"), F.when(F.col("error_json").isNotNull(), "UNKNOWN"))
    return report.withColumn("error_code", code).select(*PUBLIC)


def align_pages(artifacts: DataFrame) -> DataFrame:
    """Source and result preview of each page side by side, by one aggregation."""
    role = F.col("role")
    return (artifacts.filter(F.col("page_number").isNotNull() & (role != "output")).groupBy("task_id", "page_number")
            .agg(F.max(F.when(role == "source_preview", F.col("path"))).alias("source_path"),
                 F.max(F.when(role == "result_preview", F.col("path"))).alias("result_path")))


def reading_order(artifacts: DataFrame) -> DataFrame:
    """Position of each artifact by role (output, source, result) and page."""
    rank = F.array_position(F.array(F.lit("output"), F.lit("source_preview"), F.lit("result_preview")), F.col("role"))
    page = F.coalesce("page_number", F.lit(0))
    ordered = numbered(artifacts.withColumns({"_rank": rank, "_page": page}), ["task_id"],
                       [F.col("_rank"), F.col("_page"), F.col("path")], None, "position")
    return ordered.drop("_rank", "_page").withColumn("position", F.col("position").cast("bigint"))


def recent(df: DataFrame, when: str, tie: str, n: int = 100) -> DataFrame:
    """The newest rows; every task keeps only its own n."""
    return df.orderBy(F.desc(when), F.desc(tie)).limit(n)


def expired_assets(assets: DataFrame, plans: DataFrame, cutoff: Column) -> DataFrame:
    """Assets older than the cutoff that no plan refers to."""
    return assets.filter(F.col("created_at") < cutoff).join(plans.select("asset_id").distinct(), "asset_id", "left_anti")


def cleanup_summary(tasks: DataFrame, artifacts: DataFrame, assets: DataFrame, plans: DataFrame, temporary: DataFrame,
                    now: Column, artifact_age: str, asset_age: str, temp_age: str) -> DataFrame:
    """What a clean-up would remove, as one row of counts."""
    def before(age: str) -> Column:
        return now - F.expr(f"INTERVAL {age}")

    done = tasks.filter(F.col("status").isin(*TERMINAL) & (F.col("updated_at") < before(artifact_age)))
    counts = [
        artifacts.join(done.select("task_id"), "task_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("removed_artifacts")),
        expired_assets(assets, plans, before(asset_age)).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("removed_assets")),
        temporary.filter(F.col("modified_at") < before(temp_age)).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("removed_temporary")),
    ]
    union = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return union.agg(*[F.sum(F.when(F.col("what") == w, F.col("n"))).alias(w)
                       for w in ("removed_artifacts", "removed_assets", "removed_temporary")])


def compare_structure(source: DataFrame, output: DataFrame, page: list[str]) -> DataFrame:
    """Status of each structure probe between source and output pages (rows of page, probe, n)."""
    s = source.select(*page, "probe", F.col("n").alias("source_count"))
    o = output.select(*page, "probe", F.col("n").alias("output_count"))
    return s.join(o, [*page, "probe"], "full_outer").withColumn(
        "status", structure_status(F.col("source_count"), F.col("output_count")))


def page_text_status(pages: DataFrame) -> DataFrame:
    """Where a rebuilt page's text comes from and why it may have none.

    Columns read: source_words, ocr_enabled, ocr_available, ocr_attempt, ocr_words, inserted_words.
    """
    own, tried = F.col("source_words") > 0, F.col("ocr_enabled") & F.col("ocr_available")
    read = ~own & tried & (F.col("ocr_words") > 0)
    inserted, lost = F.col("inserted_words") > 0, (own | read) & (F.col("inserted_words") <= 0)
    status = (F.when(own, "not_needed").when(tried, F.col("ocr_attempt")).when(~F.col("ocr_enabled"), "disabled")
              .otherwise("unavailable"))
    return pages.withColumns({
        "text_source": F.when(~inserted, "none").when(own, "source_text").when(read, "ocr").otherwise("none"),
        "ocr_status": F.when(lost & read, "failed").otherwise(status),
        "searchable": inserted,
        "unsearchable_reason": F.when(lost, "text_layer_insert_failed").when(own | read, F.lit(None).cast("string"))
        .when(tried & (F.col("ocr_attempt") == "failed"), "ocr_failed").when(tried, "ocr_no_text")
        .when(~F.col("ocr_enabled"), "ocr_disabled").otherwise("ocr_unavailable")})
