"""Package parts of documents: limits, relationships, header shapes and drawings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ids import digest_id
from palimpsest.functions.paths import part_path, unsafe
from palimpsest.functions.text import evidence, fold
from palimpsest.operators.markup import read_parts
from palimpsest.operators.prefix import running

# Header and footer part names, the shape type of built-in marks, image relationships.
HEADER_PARTS = r"^word/(?:header|footer)\d*\.xml$"
MARK_SHAPE = "#_x0000_t136"
IMAGE_RELATION = "/image"
MAX_ENTRIES, MAX_BYTES = 2_000, 500 * 1024 * 1024


def select_parts(parts: DataFrame, name: str = "part_name") -> DataFrame:
    """Header and footer parts."""
    return parts.filter(F.col(name).rlike(HEADER_PARTS))


def package_status(entries: DataFrame, asset: str, order: list[str], chunk: Column | None = None, max_entries: int = MAX_ENTRIES,
                   max_bytes: int = MAX_BYTES) -> DataFrame:
    """First limit each package breaks: entry count, then entry by entry encryption, path and total size.

    Entries have part_name, size_bytes and encrypted; a `chunk` rule, if given, must not decrease along `order`.
    """
    run = running(entries, [asset], [F.col(c) for c in order], chunk, {"_total": ("sum", F.col("size_bytes"))})
    bad = (F.when(F.col("encrypted"), "PASSWORD_REQUIRED").when(unsafe(F.col("part_name")), "INVALID_DOCX")
           .when(F.col("_total") > max_bytes, "RESOURCE_LIMIT"))
    first = F.min(F.when(bad.isNotNull(), F.struct(*order, bad.alias("code"))))["code"]
    return run.groupBy(asset).agg(F.count(F.lit(1)).alias("n_entries"), F.max("_total").alias("total_bytes"), first.alias("_first")).select(
        asset, "n_entries", "total_bytes",
        F.when(F.col("n_entries") > max_entries, "RESOURCE_LIMIT").otherwise(F.coalesce("_first", F.lit("OK"))).alias("status"))


def resolve_rels(rels: DataFrame, parts: DataFrame, asset: list[str]) -> DataFrame:
    """Target part of each image relationship and whether it may be read.

    Relationships have owner, target, target_mode and type.
    """
    names = parts.select(*asset, F.col("part_name").alias("resolved"), F.lit(True).alias("_exists")).distinct()
    wanted = rels.filter(F.endswith("type", F.lit(IMAGE_RELATION)))
    placed = wanted.withColumn("resolved", part_path(F.col("owner"), F.col("target")))
    return placed.join(names, [*asset, "resolved"], "left").withColumn(
        "status", F.when(F.lower(F.coalesce("target_mode", F.lit(""))) == "external", "EXTERNAL")
        .when(F.col("_exists"), "OK").otherwise("INVALID_TARGET")).drop("_exists")


def dangling(rels: DataFrame, parts: DataFrame, asset: list[str]) -> DataFrame:
    """Internal relationships whose target part does not exist."""
    inner = rels.filter(F.lower(F.coalesce("target_mode", F.lit(""))) != "external")
    placed = inner.withColumn("resolved", part_path(F.col("owner"), F.col("target")))
    names = parts.select(*asset, F.col("part_name").alias("resolved")).distinct()
    return placed.join(names, [*asset, "resolved"], "left_anti")


def malformed(parts: DataFrame, asset: str) -> DataFrame:
    """Header and footer parts that are not well-formed, as rejects."""
    bad = read_parts(select_parts(parts), [asset, "part_name"]).where("kind = 'malformed'")
    return bad.select(asset, "part_name", F.lit("INVALID_MARKUP").alias("status"))


def shape_candidates(parts: DataFrame, asset: str, target: str | None = None) -> DataFrame:
    """Text shapes in headers: confirmed with the built-in mark shape and exactly the target text. Malformed parts hold none."""
    shapes = read_parts(select_parts(parts), [asset, "part_name"]).where("kind = 'shape' AND strings IS NOT NULL")
    content = F.nullif(F.array_join(F.filter(F.transform("strings", lambda v: F.trim(v)), lambda v: v != ""), " "), F.lit(""))
    rows = shapes.select(asset, "part_name", F.col("idx").alias("shape_index"), content.alias("content"), F.col("type").alias("shape_type"), "style")
    known = F.coalesce(F.col("shape_type") == MARK_SHAPE, F.lit(False))
    same = F.coalesce(fold(F.col("content")) == fold(F.trim(F.lit(target or ""))), F.lit(False)) if target else F.lit(False)
    return rows.withColumns({
        "classification": F.when(known & same, "confirmed").otherwise("ambiguous"),
        "evidence": evidence((F.lit(True), "HEADER_TEXT_SHAPE"), (known, "BUILT_IN_MARK_SHAPE"), (same, "EXACT_TARGET_TEXT")),
        "candidate_id": digest_id("docx-", 20, F.col(asset), F.col("part_name"), F.col("shape_index"), F.coalesce("content", F.lit("")))})


def drawing_candidates(parts: DataFrame, rels: DataFrame, media: DataFrame, asset: str, target: str | None = None) -> DataFrame:
    """Embedded pictures in headers, each with its resolved medium and the evidence for it.

    `rels` are resolved relationships (owner, rel_id, resolved, status), `media` have
    part_name, sha256 and media_type (null where a browser cannot show it). Drawings
    without a usable relationship are dropped.
    """
    rows = read_parts(select_parts(parts), [asset, "part_name"]).where("kind = 'drawing'")
    labels = F.array_distinct(F.filter(F.transform("labels", lambda v: F.trim(v)), lambda v: v != ""))
    label = F.coalesce(F.nullif(F.array_join(F.slice(labels, 1, 3), " · "), F.lit("")), F.lit("EMBEDDED_IMAGE"))
    anchor = F.col("type") == "anchor"
    named = rows.select(asset, F.col("part_name").alias("owner"), F.col("idx").alias("drawing_index"), F.col("embed").alias("rel_id"),
                        label.alias("content"), anchor.alias("_anchor"), (anchor & F.col("behind").isin("1", "true")).alias("_behind"))
    usable = rels.filter("status = 'OK'").select(asset, "owner", "rel_id", F.col("resolved").alias("media_part"))
    joined = named.join(usable, [asset, "owner", "rel_id"]).join(
        media.select(asset, F.col("part_name").alias("media_part"), "sha256", "media_type"), [asset, "media_part"], "left")
    behind = F.col("_anchor") & F.coalesce(F.col("_behind"), F.lit(False))
    hit = F.contains(fold(F.col("content")), fold(F.trim(F.lit(target)))) if target and target.strip() else F.lit(False)
    shown = F.col("media_type").isNotNull()
    return joined.select(
        digest_id("docx-", 20, F.col(asset), F.col("owner"), F.lit("drawing"), F.col("drawing_index"), F.col("rel_id"), F.col("sha256")).alias("candidate_id"),
        asset, "owner", "drawing_index", "rel_id", "media_part", "content", F.lit("ambiguous").alias("classification"),
        evidence((F.lit(True), "HEADER_IMAGE"), (F.col("_anchor"), "FLOATING"), (behind, "BEHIND_TEXT"), (hit, "LABEL_HAS_TARGET"),
                 (~shown, "NOT_PREVIEWABLE")).alias("evidence"),
        F.when(shown, F.array(F.lit("object"))).otherwise(F.array().cast("array<string>")).alias("allowed_strategies"))
