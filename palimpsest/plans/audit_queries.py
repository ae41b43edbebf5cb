"""Queries that audit predictions and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.measures import ratio
from palimpsest.functions.sql import register
from palimpsest.operators import audit
from palimpsest.operators.identity import duplicate_keys
from palimpsest.plans.registry import Tables, query
from palimpsest.plans.roles import KNOWN
from palimpsest.plans.spatial_queries import MATCHES, SCORES, results

RATES = """
round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN tp = 0 THEN CASE WHEN fp + fn = 0 THEN 1.0 ELSE CASE WHEN tp + fp = 0 OR tp + fn = 0 THEN 0.0 ELSE 0.0 END END
  ELSE 2.0 * tp / (2 * tp + fp + fn) END::DOUBLE, 6) AS f1
"""


@query("align", """
WITH c AS (SELECT o_orderkey AS page, count(*) AS n_corpus FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
p AS (SELECT l_orderkey AS page, count(*) AS n_predictions FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
j AS (SELECT page, coalesce(n_corpus, 0) AS n_corpus, coalesce(n_predictions, 0) AS n_predictions FROM c FULL JOIN p USING (page))
SELECT *, CASE WHEN n_corpus > 1 THEN 'DUPLICATE_SAMPLE' WHEN n_predictions > 1 THEN 'DUPLICATE_PREDICTION'
 WHEN n_predictions = 0 THEN 'MISSING_PREDICTION' WHEN n_corpus = 0 THEN 'UNKNOWN_SAMPLE' ELSE 'OK' END AS status FROM j""")
def align(t: Tables) -> DataFrame:
    corpus = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("page"))
    predictions = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("page"))
    return audit.align(corpus, predictions, ["page"])


def labelled(t: Tables) -> DataFrame:
    """Labels against a length rule as predictor."""
    docs = t.documents.select("doc_id", "source", "lang", (F.col("n_chars") > 500).alias("said"))
    return t.labels.join(docs, "doc_id").withColumn("truth", F.col("quality") == 1)


@query("prf", f"""
WITH j AS (SELECT source, quality = 1 AS truth, n_chars > 500 AS said FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (truth AND NOT said) AS fn FROM j GROUP BY source)
SELECT source, tp AS true_positive, fp AS false_positive, fn AS false_negative, {RATES} FROM c""")
def prf(t: Tables) -> DataFrame:
    truth, said = F.col("truth"), F.col("said")
    rows = labelled(t).select("source", *[c.cast("int").alias(n) for c, n in (
        (truth & said, "true_positive"), (~truth & said, "false_positive"), (truth & ~said, "false_negative"))])
    return audit.prf(rows, ["source"])


@query("prf_sql", f"""
WITH j AS (SELECT source, quality = 1 AS truth, n_chars > 500 AS said FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (truth AND NOT said) AS fn,
 count(*) FILTER (NOT truth AND NOT said) AS tn, count(*) AS n FROM j GROUP BY source)
SELECT source, {RATES}, round(0.0 - list_sum(list_transform(list_filter([tp, fp, fn, tn], lambda x: x > 0), lambda x: x / n * log2(x / n))), 6) AS entropy FROM c""")
def prf_sql(t: Tables) -> DataFrame:
    """The scores of `prf` and the entropy of the four outcomes, asked for in SQL."""
    register(t.spark)
    return t.spark.sql("""
        WITH c AS (SELECT source, count_if(truth AND said) AS tp, count_if(said AND NOT truth) AS fp, count_if(truth AND NOT said) AS fn,
                          count_if(NOT truth AND NOT said) AS tn FROM {rows} GROUP BY source)
        SELECT source, round(precision_of(tp, fp), 6) AS precision, round(recall_of(tp, fn), 6) AS recall, round(f1_of(tp, fp, fn), 6) AS f1,
               round(entropy_of(array(tp, fp, fn, tn)), 6) AS entropy FROM c""", rows=labelled(t))


@query("prf_rollup", f"""
WITH RECURSIVE {KNOWN}, {MATCHES}, {SCORES},
c AS (SELECT coalesce(scene_kind, '(all)') AS scene_kind, count(*) AS sample_count, count(*) FILTER (kind = 'positive') AS positive_count,
 count(*) FILTER (kind = 'negative') AS negative_count, sum(true_positive)::BIGINT AS tp, sum(false_positive)::BIGINT AS fp, sum(false_negative)::BIGINT AS fn
 FROM results GROUP BY ROLLUP (scene_kind))
SELECT scene_kind, sample_count, positive_count, negative_count, tp AS true_positive, fp AS false_positive, fn AS false_negative, {RATES} FROM c""")
def prf_rollup(t: Tables) -> DataFrame:
    """Greedy matching scored by order priority, with the micro total."""
    return audit.prf_by(results(t), "scene_kind")


@query("pair_diag", f"""
WITH RECURSIVE {KNOWN}, {MATCHES}, {SCORES},
g AS (SELECT page // 2 AS pair_id, count(*) FILTER (kind = 'positive') AS p, count(*) FILTER (kind = 'negative') AS n,
 max(page) FILTER (kind = 'positive') AS positive_sample_id, max(page) FILTER (kind = 'negative') AS negative_sample_id,
 coalesce(bool_and(false_positive = 0) FILTER (kind = 'negative'), false) AS negative_clean,
 coalesce(bool_and(true_positive = expected_count AND false_positive = 0) FILTER (kind = 'positive'), false) AS positive_detected
 FROM results GROUP BY 1)
SELECT pair_id, coalesce(positive_sample_id, -1) AS positive_sample_id, coalesce(negative_sample_id, -1) AS negative_sample_id, negative_clean, positive_detected,
 p = 1 AND n = 1 AND negative_clean AND positive_detected AS pair_passed, CASE WHEN p = 1 AND n = 1 THEN 'OK' ELSE 'INCOMPLETE_PAIR' END AS status FROM g""")
def pair_diag(t: Tables) -> DataFrame:
    """Neighbouring order numbers form a pair."""
    rows = results(t).withColumn("pair_id", F.floor(F.col("page") / 2)).withColumnRenamed("page", "sample_id")
    return audit.pair_diagnostics(rows, "pair_id").fillna(-1, ["positive_sample_id", "negative_sample_id"])


@query("gate_quality", """
WITH j AS (SELECT doc_id // 2 AS pair_id, quality = 1 AS e, n_chars > 500 AS g FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (e AND g) AS tp, count(*) FILTER (g AND NOT e) AS fp, count(*) FILTER (e AND NOT g) AS fn, count(*) FILTER (NOT e AND NOT g) AS tn FROM j),
p AS (SELECT count(*) AS pair_count, count(*) FILTER (n = 2 AND d = 1) AS stable_pair_count FROM (SELECT pair_id, count(*) AS n, count(DISTINCT g) AS d FROM j GROUP BY 1))
SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, pair_count, stable_pair_count,
 round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity FROM c, p""")
def gate_quality(t: Tables) -> DataFrame:
    rows = labelled(t).withColumn("pair_id", F.floor(F.col("doc_id") / 2))
    return audit.gate_quality(rows, "truth", "said", "pair_id")


def pair_samples(t: Tables) -> DataFrame:
    role = F.when(F.col("o_orderkey") % 2 == 0, "clean_negative").when(F.col("o_orderpriority") == "1-URGENT", "clean_negative").otherwise("watermark_positive")
    return t.orders.select(
        F.floor(F.col("o_orderkey") / 2).alias("pair_id"), role.alias("role"), (F.col("o_custkey") % 2).alias("width"),
        F.col("o_orderstatus").alias("license"), (F.col("o_custkey") % 50).alias("sha256"), F.col("o_custkey").alias("source_group"))


@query("pair_audit", """
WITH s AS (SELECT o_orderkey // 2 AS pair_id, CASE WHEN o_orderkey % 2 = 0 OR o_orderpriority = '1-URGENT' THEN 'n' ELSE 'p' END AS role,
 o_custkey % 2 AS width, o_orderstatus AS license, o_custkey % 50 AS sha FROM orders)
SELECT pair_id, CASE WHEN nn > 1 OR np > 1 THEN 'DUPLICATE_ROLE' WHEN nn = 0 OR np = 0 THEN 'INCOMPLETE_PAIR' WHEN w > 1 THEN 'METADATA_MISMATCH:width'
 WHEN l > 1 THEN 'METADATA_MISMATCH:license' WHEN d = 1 THEN 'IMAGES_NOT_DISTINCT' ELSE 'OK' END AS status
FROM (SELECT pair_id, count(*) FILTER (role = 'n') AS nn, count(*) FILTER (role = 'p') AS np, count(DISTINCT width) AS w,
 count(DISTINCT license) AS l, count(DISTINCT sha) AS d FROM s GROUP BY pair_id)""")
def pair_audit(t: Tables) -> DataFrame:
    """Neighbouring orders as clean and marked picture; urgent ones claim the clean role."""
    return audit.pair_audit(pair_samples(t), "pair_id", "role", ["width", "license"], ["sha256"])


@query("source_count", """
SELECT count(DISTINCT o_custkey) AS source_count, count(DISTINCT o_orderkey // 2) AS pair_count, count(DISTINCT o_custkey) = count(DISTINCT o_orderkey // 2) AS independent FROM orders""")
def source_count(t: Tables) -> DataFrame:
    return audit.source_count(pair_samples(t), "pair_id", "source_group")


@query("digest_reconcile", """
WITH e AS (SELECT doc_id AS path, n_chars AS size_bytes, sha256(text) AS d FROM documents),
a AS (SELECT doc_id AS path, n_chars + (1 - quality) AS size_bytes, sha256(CASE WHEN toxic = 1 THEN text || '!' ELSE text END) AS d FROM documents JOIN labels USING (doc_id)
 UNION ALL SELECT item_id + 1000000000, length(text), sha256(text) FROM benchmark)
SELECT path, CASE WHEN e.d IS NULL THEN 'UNEXPECTED' WHEN a.d IS NULL THEN 'MISSING' WHEN e.size_bytes <> a.size_bytes THEN 'SIZE_MISMATCH'
 WHEN e.d <> a.d THEN 'DIGEST_MISMATCH' ELSE 'OK' END AS status FROM e FULL JOIN a USING (path)""")
def digest_reconcile(t: Tables) -> DataFrame:
    """All documents against the labelled ones, some of them edited, and the benchmark items."""
    expected = t.documents.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    edited = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    actual = t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("path"), (F.col("n_chars") + 1 - F.col("quality")).alias("size_bytes"), F.sha2(edited, 256).alias("sha256"))
    others = t.benchmark.select((F.col("item_id") + 1_000_000_000).alias("path"), F.length("text").cast("bigint").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    return audit.reconcile(expected, actual.unionByName(others), "path")


DIFFS = """
d AS (SELECT p_partkey, p_type, concat_ws(';', CASE WHEN p_partkey % 5 = 0 THEN 'p_size: expected ' || p_size || ', got ' || (p_size + 1) END,
 CASE WHEN p_brand = 'Brand#7' THEN 'p_brand: expected Brand#7, got null' END) AS mismatches FROM part)
"""


def differences(t: Tables) -> DataFrame:
    """Parts against a copy with some sizes raised and one brand lost."""
    actual = t.part.select("p_partkey", (F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("int")).alias("p_size"),
                           F.nullif("p_brand", F.lit("Brand#7")).alias("p_brand"))
    return audit.expect_diff(t.part, actual, ["p_partkey"], ["p_size", "p_brand"])


@query("expect_diff", f"WITH {DIFFS} SELECT p_partkey, mismatches FROM d")
def expect_diff(t: Tables) -> DataFrame:
    return differences(t).select("p_partkey", F.array_join("mismatches", ";").alias("mismatches"))


@query("corpus_status", f"""
WITH {DIFFS}
SELECT count(*) AS sample_count, sum(CASE WHEN mismatches = '' THEN 0 ELSE 1 + CAST(contains(mismatches, ';') AS INTEGER) END)::BIGINT AS mismatch_count,
 count(*) FILTER (p_type = 'PROMO') AS real_count, CASE WHEN count(*) FILTER (mismatches <> '') > 0 THEN 'review'
 WHEN count(*) FILTER (p_type = 'PROMO') > 0 THEN 'pass' ELSE 'generated_only' END AS status FROM d""")
def corpus_status(t: Tables) -> DataFrame:
    origin = F.when(F.col("p_type") == "PROMO", "real_export").otherwise("repository_generated")
    return audit.corpus_status(differences(t).join(t.part.select("p_partkey", origin.alias("provenance")), "p_partkey"))


@query("require_fields", """
WITH f AS (SELECT event_id, nullif(event_type, 'error') AS name, user_id - 3 AS width, CASE WHEN value > 100 THEN 'true' WHEN value > 50 THEN 'no' ELSE 'false' END AS flag,
 CASE WHEN value < 1 THEN 'x' ELSE CAST(value AS VARCHAR) END AS score FROM events)
SELECT event_id, concat_ws(',', CASE WHEN name IS NULL THEN 'name:text' END, CASE WHEN width <= 0 THEN 'width:positive_int' END,
 CASE WHEN flag NOT IN ('true', 'false') THEN 'flag:bool' END, CASE WHEN score = 'x' THEN 'score:number' END) AS errors FROM f""")
def require_fields(t: Tables) -> DataFrame:
    value = F.col("value")
    rows = t.events.select(
        "event_id", F.nullif("event_type", F.lit("error")).alias("name"), (F.col("user_id") - 3).alias("width"),
        F.when(value > 100, "true").when(value > 50, "no").otherwise("false").alias("flag"),
        F.when(value < 1, "x").otherwise(value.cast("string")).alias("score"))
    checked = audit.missing_fields(rows, {"name": "text", "width": "positive_int", "flag": "bool", "score": "number"})
    return checked.select("event_id", F.array_join("errors", ",").alias("errors"))


@query("provenance", """
SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'BAD_DIGEST' WHEN page_id % 5 = 0 THEN 'MISSING_LICENSE' WHEN page_id % 11 = 0 THEN 'USER_DATA'
 WHEN url NOT LIKE 'https://%' THEN 'SOURCE_NOT_PUBLIC_HTTPS' WHEN page_id % 3 = 0 THEN 'TERMS_NOT_PUBLIC_HTTPS' ELSE 'OK' END AS status FROM pages""")
def provenance(t: Tables) -> DataFrame:
    page = F.col("page_id")
    sha = F.sha2("html", 256)
    samples = t.pages.select(
        "page_id", F.when(page % 7 == 0, F.concat(F.upper(F.substring(sha, 1, 63)), F.lit("G"))).otherwise(sha).alias("source_sha256"),
        F.when(page % 5 == 0, " ").otherwise("CC0").alias("license"), F.lit("someone").alias("attribution"),
        (page % 11 == 0).alias("contains_user_data"), F.col("url").alias("source_record"),
        F.when(page % 3 == 0, "https://user@example.org/terms").otherwise("https://example.org/terms").alias("usage_terms_url"))
    return audit.provenance_status(samples).select("page_id", "status")


@query("dup_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(t: Tables) -> DataFrame:
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("ratio", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE (l_partkey % 7) / (l_suppkey % 5) END, 6) AS value FROM lineitem""")
def ratio_query(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(ratio(F.col("l_partkey") % 7, F.col("l_suppkey") % 5), 6).alias("value"))
