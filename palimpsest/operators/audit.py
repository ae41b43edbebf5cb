"""Evidence audits: aligning corpora with predictions, scores, pairs and gates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.measures import prf_cols
from palimpsest.functions.text import codes
from palimpsest.functions.urls import let, split_url

# Default gates of the localization, mask and timing audits.
LOCALIZATION_GATES = {"precision": 0.75, "recall": 0.85, "sample_count": 20, "negative_count": 10,
                      "scene_count": 4, "pair_count": 7}
MASK_GATES = {"iou": 0.75, "precision": 0.80, "recall": 0.80, "correction_reduction": 0.25,
              "sample_count": 8, "negative_count": 4, "category_count": 6, "timing_count": 6}
COUNTS = ("true_positive", "false_positive", "false_negative")


def key_diff(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only: MISSING from actual, or UNKNOWN to expected."""
    sides = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    missing = sides[0].join(sides[1], keys, "left_anti").withColumn("status", F.lit("MISSING"))
    unknown = sides[1].join(sides[0], keys, "left_anti").withColumn("status", F.lit("UNKNOWN"))
    return missing.unionByName(unknown)


def align(corpus: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Strict one-to-one alignment status per key.

    A key may occur once per side. Both sides are counted by key before they
    meet, so a key repeated many times costs one row.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    both = counted(corpus, "n_corpus").join(counted(predictions, "n_predictions"), keys, "full_outer")
    both = both.fillna(0, ["n_corpus", "n_predictions"])
    return both.withColumn(
        "status",
        F.when(F.col("n_corpus") > 1, "DUPLICATE_SAMPLE").when(F.col("n_predictions") > 1, "DUPLICATE_PREDICTION")
        .when(F.col("n_predictions") == 0, "MISSING_PREDICTION").when(F.col("n_corpus") == 0, "UNKNOWN_SAMPLE")
        .otherwise("OK"))


def level_counts(df: DataFrame, keys: list[str], level: str, domain: list[str]) -> DataFrame:
    """One zero-filled count column per level of a known domain."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(level) == name).alias(name) for name in domain])


def prf(df: DataFrame, keys: list[str], tp: str = COUNTS[0], fp: str = COUNTS[1], fn: str = COUNTS[2],
        digits: int = 6) -> DataFrame:
    """Counts with precision, recall and F1 per key (no keys: micro total)."""
    totals = df.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(name) for c, name in zip((tp, fp, fn), COUNTS)])
    scores = prf_cols(*[F.col(name) for name in COUNTS])
    return totals.select(*keys, *COUNTS, *[F.round(v, digits).alias(k) for k, v in scores.items()])


def localization_report(results: DataFrame, scene: str, pair: str, is_model_output: bool,
                        limits: Mapping[str, float] = LOCALIZATION_GATES) -> DataFrame:
    """One row: sizes of the corpus, scores, mean IoU of all matches (0 without any), metric and evidence gate, claim flag.

    `results` have kind, the counts and iou_sum per sample. Scenes and pairs are counted apart, so no group holds all samples.
    """
    def size(name: str, column: str) -> DataFrame:
        return results.where(F.col(column).isNotNull()).select(column).distinct().agg(F.count(F.lit(1)).alias(name))

    kind = F.col("kind")
    totals = results.agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(kind == "positive").alias("positive_count"),
        F.count_if(kind == "negative").alias("negative_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS], F.coalesce(F.sum("iou_sum"), F.lit(0.0)).alias("_iou"))
    scores = prf_cols(*[F.col(c) for c in COUNTS])
    mean = F.coalesce(F.try_divide(F.col("_iou"), F.col("true_positive")), F.lit(0.0))
    rows = totals.withColumns({k: size(k, c).scalar() for k, c in (("scene_count", scene), ("pair_count", pair))})
    rows = rows.select("*", *[F.round(v, 6).alias(k) for k, v in scores.items()], F.round(mean, 6).alias("mean_matched_iou"),
                       *[v.alias(f"_{k}") for k, v in scores.items()]).drop("_iou")
    metric = (F.col("_precision") >= limits["precision"]) & (F.col("_recall") >= limits["recall"])
    evidence = F.lit(True)
    for name in ("sample_count", "negative_count", "scene_count", "pair_count"):
        evidence = evidence & (F.col(name) >= limits[name])
    return rows.select(
        *[c for c in rows.columns if not c.startswith("_")], metric.alias("metric_gate"), evidence.alias("evidence_gate"),
        (F.lit(is_model_output) & metric & evidence).alias("release_claim_allowed"))


def prf_by(df: DataFrame, scene: str, total_label: str = "(all)", digits: int = 6) -> DataFrame:
    """Per-scene rows and the micro total from one aggregation (rollup)."""
    kind = F.col("kind")
    rolled = df.rollup(scene).agg(
        F.grouping(scene).alias("_all"), F.count(F.lit(1)).alias("sample_count"),
        F.count_if(kind == "positive").alias("positive_count"), F.count_if(kind == "negative").alias("negative_count"),
        *[F.sum(name).cast("bigint").alias(name) for name in COUNTS])
    scores = prf_cols(*[F.col(name) for name in COUNTS])
    return rolled.select(
        F.when(F.col("_all") == 1, total_label).otherwise(F.col(scene)).alias(scene),
        "sample_count", "positive_count", "negative_count", *COUNTS,
        *[F.round(v, digits).alias(k) for k, v in scores.items()])


def pair_diagnostics(results: DataFrame, pair: str) -> DataFrame:
    """Outcome of each pair of one positive and one negative sample; other shapes are rejects.

    Every figure is a count or a maximum, so members are combined before the shuffle.
    """
    positive, negative = F.col("kind") == "positive", F.col("kind") == "negative"
    found = ((F.col("true_positive") == F.col("expected_count")) & (F.col("false_positive") == 0))
    grouped = results.filter(F.col(pair).isNotNull()).groupBy(pair).agg(
        F.count_if(positive).alias("_p"), F.count_if(negative).alias("_n"),
        F.max(F.when(positive, F.col("sample_id"))).alias("positive_sample_id"),
        F.max(F.when(negative, F.col("sample_id"))).alias("negative_sample_id"),
        F.coalesce(F.bool_and(F.when(negative, F.col("false_positive") == 0)), F.lit(False)).alias("negative_clean"),
        F.coalesce(F.bool_and(F.when(positive, found)), F.lit(False)).alias("positive_detected"))
    complete = (F.col("_p") == 1) & (F.col("_n") == 1)
    return grouped.select(
        pair, "positive_sample_id", "negative_sample_id", "negative_clean", "positive_detected",
        (complete & F.col("negative_clean") & F.col("positive_detected")).alias("pair_passed"),
        F.when(complete, "OK").otherwise("INCOMPLETE_PAIR").alias("status"))


def pair_audit(samples: DataFrame, pair: str, role: str, equal: list[str], distinct: list[str],
               negative: str = "clean_negative", positive: str = "watermark_positive") -> DataFrame:
    """First rule a pair breaks: roles, equal metadata, distinct images.

    Two members agree on a field exactly when its smallest and largest value agree
    and both or neither are null, which needs no self-join.
    """
    def differs(field: str) -> Column:
        nulls = F.count_if(F.col(field).isNull())
        return F.coalesce(F.min(field) != F.max(field), F.lit(False)) | ((nulls > 0) & (nulls < F.count(F.lit(1))))

    grouped = samples.groupBy(pair).agg(
        F.count_if(F.col(role) == negative).alias("_n"), F.count_if(F.col(role) == positive).alias("_p"),
        F.count(F.lit(1)).alias("_all"),
        *[differs(f).alias(f"_eq_{f}") for f in equal],
        *[(F.min(f) == F.max(f)).alias(f"_ne_{f}") for f in distinct])
    status = (F.when(F.col("_n") + F.col("_p") < F.col("_all"), "INVALID_ROLE")
              .when((F.col("_n") > 1) | (F.col("_p") > 1), "DUPLICATE_ROLE")
              .when((F.col("_n") == 0) | (F.col("_p") == 0), "INCOMPLETE_PAIR"))
    for field in equal:
        status = status.when(F.col(f"_eq_{field}"), f"METADATA_MISMATCH:{field}")
    for field in distinct:
        status = status.when(F.coalesce(F.col(f"_ne_{field}"), F.lit(False)), "IMAGES_NOT_DISTINCT")
    return grouped.select(pair, status.otherwise("OK").alias("status"))


def source_count(samples: DataFrame, pair: str, source: str) -> DataFrame:
    """Independent sources against pairs; every pair must bring its own source."""
    return (samples.agg(F.countDistinct(source).alias("source_count"), F.countDistinct(pair).alias("pair_count"))
            .withColumn("independent", F.col("source_count") == F.col("pair_count")))


def gate_quality(rows: DataFrame, expected: str, eligible: str, pair: str) -> DataFrame:
    """Confusion of a yes/no gate, specificity, and pairs with one agreed answer."""
    e, g = F.col(expected), F.col(eligible)
    totals = rows.agg(
        F.count_if(e & g).alias("true_positive"), F.count_if(~e & g).alias("false_positive"),
        F.count_if(e & ~g).alias("false_negative"), F.count_if(~e & ~g).alias("true_negative"))
    members = rows.filter(F.col(pair).isNotNull()).groupBy(pair).agg(
        F.count(F.lit(1)).alias("_n"), (F.min(g) == F.max(g)).alias("_same"))
    pairs = members.agg(F.count(F.lit(1)).alias("pair_count"),
                        F.count_if((F.col("_n") == 2) & F.col("_same")).alias("stable_pair_count"))
    scores = prf_cols(*[F.col(name) for name in COUNTS])
    specificity = F.coalesce(
        F.try_divide(F.col("true_negative"), F.col("true_negative") + F.col("false_positive")), F.lit(1.0))
    counts = ("pair_count", "stable_pair_count")
    return totals.withColumns({name: pairs.select(name).scalar() for name in counts}).select(
        *COUNTS, "true_negative", "pair_count", "stable_pair_count",
        F.round(scores["precision"], 6).alias("precision"), F.round(scores["recall"], 6).alias("recall"),
        F.round(specificity, 6).alias("specificity"))


def gates(summary: DataFrame, minimum: Mapping[str, float], exact: Mapping[str, float] | None = None,
          maximum: Mapping[str, float] | None = None) -> DataFrame:
    """One row per gate with value, threshold and result; a missing value does not pass."""
    entries = [(n, F.col(n).cast("double") >= F.lit(float(v)), float(v)) for n, v in minimum.items()]
    entries += [(n, F.col(n).cast("double") == F.lit(float(v)), float(v)) for n, v in (exact or {}).items()]
    entries += [(n, F.col(n).cast("double") <= F.lit(float(v)), float(v)) for n, v in (maximum or {}).items()]
    gate = F.explode(F.array(*[
        F.struct(F.lit(name).alias("gate"), F.round(F.col(name).cast("double"), 6).alias("value"),
                 F.lit(limit).alias("threshold"), F.coalesce(passed, F.lit(False)).alias("passed"))
        for name, passed, limit in entries]))
    return summary.select(gate.alias("_g")).select("_g.*")


def claim_allowed(gate_rows: DataFrame, is_model_output: bool) -> DataFrame:
    """A claim needs real model output and every gate."""
    return gate_rows.agg((F.bool_and("passed") & F.lit(is_model_output)).alias("release_claim_allowed"))


def expect_diff(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Text of each field whose actual value differs from the expected one."""
    e = expected.select(*keys, *[F.col(f).alias(f"_e_{f}") for f in fields])
    a = actual.select(*keys, *[F.col(f).alias(f"_a_{f}") for f in fields])

    def text(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit("null"))

    notes = [F.when(~F.col(f"_e_{f}").eqNullSafe(F.col(f"_a_{f}")),
                    F.concat(F.lit(f"{f}: expected "), text(F.col(f"_e_{f}")), F.lit(", got "), text(F.col(f"_a_{f}"))))
             for f in fields]
    return e.join(a, keys, "left").select(*keys, F.array_compact(F.array(*notes)).alias("mismatches"))


def corpus_status(results: DataFrame, generated: str = "repository_generated") -> DataFrame:
    """review when anything differs, pass with at least one real export, else generated_only."""
    totals = results.agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum(F.size("mismatches")).cast("bigint").alias("mismatch_count"),
        F.count_if(F.col("provenance") != generated).alias("real_count"))
    return totals.withColumn("status", F.when(F.col("mismatch_count") > 0, "review")
                             .when(F.col("real_count") > 0, "pass").otherwise("generated_only"))


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Expected against actual files by size and digest."""
    e = expected.select(key, F.col("size_bytes").alias("_es"), F.col("sha256").alias("_ed"))
    a = actual.select(key, F.col("size_bytes").alias("_as"), F.col("sha256").alias("_ad"))
    return e.join(a, key, "full_outer").select(
        key, F.when(F.col("_ed").isNull(), "UNEXPECTED").when(F.col("_ad").isNull(), "MISSING")
        .when(F.col("_es") != F.col("_as"), "SIZE_MISMATCH").when(F.col("_ed") != F.col("_ad"), "DIGEST_MISMATCH")
        .otherwise("OK").alias("status"))


def missing_fields(df: DataFrame, spec: Mapping[str, str], name: str = "errors") -> DataFrame:
    """Array of FIELD:KIND for each required field that is absent or of the wrong kind.

    Kinds: text (not blank), bool, positive_int, number.
    """
    rules = []
    for field, kind in spec.items():
        c = F.col(field)
        number = c.try_cast("double") if kind in ("number", "positive_int") else None
        ok = {
            "text": lambda: F.length(F.trim(c.cast("string"))) > 0,
            "bool": lambda: c.cast("string").isin("true", "false"),
            "positive_int": lambda: (number > 0) & (number == F.floor(number)),
            "number": lambda: number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))),
        }[kind]()
        rules.append((~F.coalesce(ok, F.lit(False)), f"{field}:{kind}"))
    return df.withColumn(name, codes(*rules))


def provenance_status(df: DataFrame) -> DataFrame:
    """First provenance rule a sample breaks."""
    def blank(field: str) -> Column:
        return F.coalesce(F.length(F.trim(F.col(field))) == 0, F.lit(True))

    def not_public(field: str) -> Column:
        bad = let(split_url(F.col(field)), lambda url: (
            (url["scheme"] != "https") | (url["authority"] == "") | url["userinfo"].isNotNull()))
        return F.coalesce(bad, F.lit(True))

    digest_ok = F.coalesce(F.col("source_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    chain = (F.when(~digest_ok, "BAD_DIGEST").when(blank("license"), "MISSING_LICENSE")
             .when(blank("attribution"), "MISSING_ATTRIBUTION")
             .when(F.coalesce(F.col("contains_user_data"), F.lit(True)), "USER_DATA")
             .when(not_public("source_record"), "SOURCE_NOT_PUBLIC_HTTPS")
             .when(not_public("usage_terms_url"), "TERMS_NOT_PUBLIC_HTTPS"))
    return df.withColumn("status", chain.otherwise("OK"))


