"""Text fragments and repeated content as removal candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ids import digest_id
from palimpsest.functions.text import collapse, evidence, lexicon_hit, norm, text_match
from palimpsest.operators.prefix import chunk_of, running
from palimpsest.operators.sieve import marked, seen_twice

# Default thresholds for repeated text.
MIN_PAGES, MIN_SHARE, MAX_FRAGMENT = 2, 0.5, 200


def fragments(docs: DataFrame, text: str, keep: list[str], max_len: int = MAX_FRAGMENT) -> DataFrame:
    """Collapsed non-empty lines of at most `max_len` characters, one row each.

    `line_no` counts all lines of the text and `occurrence` only the kept ones,
    both from 0. Numbering happens inside the row, so nothing is shuffled.
    """
    lines = F.transform(
        F.split(F.col(text), "\n"),
        lambda line, i: F.struct(i.cast("bigint").alias("line_no"), collapse(line).alias("content")),
    )
    kept = F.filter(lines, lambda line: F.length(line["content"]).between(1, max_len))
    return (docs.select(*keep, F.posexplode(kept).alias("occurrence", "_line"))
            .select(*keep, F.col("occurrence").cast("bigint").alias("occurrence"), "_line.line_no", "_line.content"))


def pages_per_value(rows: DataFrame, scope: list[str], page: str, value: str) -> DataFrame:
    """Distinct pages per value within a scope, counted in two steps so that a value
    found on very many pages is combined before it meets in one place."""
    return (rows.select(*scope, value, page).distinct()
            .groupBy(*scope, value).agg(F.count(F.lit(1)).alias("n_pages")))


def repeated_text(
    frags: DataFrame,
    pages: DataFrame,
    asset: str,
    page: str,
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    target: str | None = None,
    scope: str = "document",
    slots: int | None = None,
) -> DataFrame:
    """Fragments whose normalised text recurs on enough pages of the asset, or holds the target.

    `pages` lists every page (it gives the page total). With scope "corpus" pages
    are counted over all assets together. With `slots` a sieve of that size takes out
    what stands on one page only, before anything is counted or joined.
    """
    keys = [asset] if scope == "document" else []
    page_key = page if keys else "_page"
    rows = frags.withColumn("norm_text", norm(F.col("content")))
    listed = pages
    if not keys:
        rows = rows.withColumn("_page", F.struct(asset, page))
        listed = pages.withColumn("_page", F.struct(asset, page))
    totals = listed.select(*keys, page_key).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    if slots and min_pages > 1:
        flags = marked(rows, [*keys, "norm_text"], seen_twice(rows, [*keys, "norm_text"], [page_key], slots), "_again", slots)
        rows = flags.where(F.col("_again") | text_match(F.col("content"), target)).drop("_again")
    repeats = pages_per_value(rows, keys, page_key, "norm_text").filter(F.col("n_pages") >= min_pages)
    joined = repeats.join(totals, keys) if keys else repeats.withColumn("_total", totals.select("_total").scalar())
    chosen = (joined.filter(F.col("n_pages") / F.col("_total") >= min_share)
              .select(*keys, "norm_text", "n_pages"))
    how = "left" if target else "inner"
    hits = rows.join(chosen, [*keys, "norm_text"], how)
    is_target, is_repeat = text_match(F.col("content"), target), F.col("n_pages").isNotNull()
    if target:
        hits = hits.filter(is_target | is_repeat)
    return hits.select(
        digest_id("text-", 20, F.col(asset), F.lit("text"), F.col(page), F.col("occurrence"),
                  F.col("content")).alias("candidate_id"),
        F.lit("ambiguous").alias("classification"), F.lit("text").alias("kind"),
        *[c for c in frags.columns], "norm_text",
        F.coalesce(F.col("n_pages"), F.lit(0)).alias("n_pages"),
        evidence((is_target, "TARGET_TEXT"),
                 (is_repeat, F.concat(F.lit("REPEATED_ON_PAGES:"), F.col("n_pages").cast("string"))),
                 (F.lit(True), "POSITION_IS_A_HINT_ONLY")).alias("evidence"),
    )


def repeated_objects(uses: DataFrame, asset: str, page: str, ref: str, min_pages: int = 2, slots: int | None = None) -> DataFrame:
    """Object uses, ambiguous where the same object is used on several pages, else content. With `slots` uses that a sieve
    of that size knows to be on one page are neither counted nor joined."""
    if slots and min_pages > 1:
        flags = marked(uses, [asset, ref], seen_twice(uses, [asset, ref], [page], slots), "_again", slots)
        once = flags.where("NOT _again").drop("_again").select(asset, ref, *[c for c in uses.columns if c not in (asset, ref)])
        several = repeated_objects(flags.where("_again").drop("_again"), asset, page, ref, min_pages)
        return several.unionByName(once.withColumn("classification", F.lit("content")).withColumn("n_pages", F.lit(1).cast("bigint")))
    counts = (pages_per_value(uses, [asset], page, ref).filter(F.col("n_pages") >= min_pages))
    return (uses.join(counts, [asset, ref], "left")
            .withColumn("classification",
                        F.when(F.col("n_pages").isNotNull(), "ambiguous").otherwise("content"))
            .withColumn("n_pages", F.coalesce(F.col("n_pages"), F.lit(1))))


def annotation_candidates(annots: DataFrame, subtype: str = "subtype") -> DataFrame:
    """Watermark annotations are confirmed, stamps ambiguous, all others are no candidates."""
    return (annots.filter(F.col(subtype).isin("/Watermark", "/Stamp"))
            .withColumn("classification",
                        F.when(F.col(subtype) == "/Watermark", "confirmed").otherwise("ambiguous")))


def layer_candidates(layers: DataFrame, name: str, words=None, target: str | None = None) -> DataFrame:
    """Named layers: ambiguous where the name holds a lexicon word or the target."""
    hit = lexicon_hit(F.trim(F.col(name)), **({"words": words} if words else {}), target=target)
    return layers.withColumn("classification", F.when(hit, "ambiguous").otherwise("content"))


def union_candidates(*frames: DataFrame) -> DataFrame:
    """All detectors' candidates by column name; columns a detector lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def match_status(assets: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """matched > needs_review > not_found per asset; assets without candidates stay in."""
    flags = candidates.groupBy(key).agg(
        F.max(F.col("classification") == "confirmed").alias("_confirmed"),
        F.max(F.col("classification") == "ambiguous").alias("_ambiguous"))
    return assets.select(key).distinct().join(flags, key, "left").select(
        key,
        F.when(F.col("_confirmed"), "matched").when(F.col("_ambiguous"), "needs_review")
        .otherwise("not_found").alias("match_status"))


def size_guard(pages: DataFrame, asset: str, page: str, size: Column, limit: int) -> DataFrame:
    """Total size per asset and the first page at which the running total passes the limit."""
    run = running(pages.withColumn("_size", size), [asset], [F.col(page)], chunk_of(F.col(page)),
                  {"_running": ("sum", F.col("_size"))})
    return run.groupBy(asset).agg(
        F.sum("_size").alias("total_bytes"),
        F.coalesce(F.min(F.when(F.col("_running") > limit, F.col(page))), F.lit(-1)).alias("first_page_over"),
        F.when(F.max("_running") > limit, "RESOURCE_LIMIT").otherwise("OK").alias("status"))


def apply_selection(rows: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that are not selected, unchanged."""
    return rows.join(selected.select(*keys).distinct(), keys, "left_anti")


def unchanged(
    before: DataFrame, after: DataFrame, selected: DataFrame, keys: list[str], content: str
) -> DataFrame:
    """Compare two versions row by row; only selected rows may be missing or differ."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("null")).alias(name))

    marks = selected.select(*keys).distinct().withColumn("_selected", F.lit(True))
    joined = (hashed(before, "_b").join(hashed(after, "_a"), keys, "full_outer")
              .join(marks, keys, "left"))
    return joined.select(
        *keys,
        F.when(F.col("_b").isNull(), "UNEXPECTED")
        .when(F.col("_selected") & F.col("_a").isNull(), "REMOVED_AS_SELECTED")
        .when(F.col("_selected") & (F.col("_a") == F.col("_b")), "SELECTED_BUT_KEPT")
        .when(F.col("_selected"), "EDITED_AS_SELECTED")
        .when(F.col("_a").isNull(), "MISSING")
        .when(F.col("_a") != F.col("_b"), "CHANGED").otherwise("UNCHANGED").alias("status"))


