"""Queries over text lines: fragments, repeats, names and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import ids, text
from palimpsest.operators import digests
from palimpsest.operators import fragments as frag
from palimpsest.operators.audit import key_diff, level_counts
from palimpsest.operators.governance import sorted_distinct
from palimpsest.operators.prefix import chunk_of, numbered
from palimpsest.operators.sieve import SLOTS
from palimpsest.plans.registry import Tables, query
from palimpsest.session import cut_lineage
from palimpsest.sources.report import golden_diff

SPACE_SQL = r"[\t-\r\x1c-\x20\x85\pZ]+"
COLLAPSE = "trim(regexp_replace({0}, '" + SPACE_SQL + "', ' ', 'g'))"
NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '" + SPACE_SQL + "', ' ', 'g'))"
FRAGS = f"""
lines AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
collapsed AS (SELECT doc_id, source, lang, line_no, {COLLAPSE.format('raw')} AS content FROM lines),
frags AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS occurrence,
         {NORM.format('content')} AS norm_text
  FROM collapsed WHERE length(content) BETWEEN 1 AND 200)
"""
SHARE = 0.1


def lines(t: Tables) -> DataFrame:
    return frag.fragments(t.documents, "text", ["doc_id", "source", "lang"])


def repeats(t: Tables) -> DataFrame:
    return frag.repeated_text(lines(t), t.documents, "source", "doc_id", min_share=SHARE)


CHOSEN = f"""
totals AS (SELECT source, count(DISTINCT doc_id) AS total FROM documents GROUP BY source),
chosen AS (
  SELECT source, norm_text, n_pages FROM (
    SELECT source, norm_text, count(DISTINCT doc_id) AS n_pages FROM frags GROUP BY ALL)
  JOIN totals USING (source) WHERE n_pages >= 2 AND n_pages / total >= {SHARE})
"""


REPEATED = f"""
WITH {FRAGS}, {CHOSEN}
SELECT 'text-' || substr(sha256(concat_ws('|', source, 'text', doc_id, occurrence, content)), 1, 20) AS candidate_id,
       'ambiguous' AS classification, source, doc_id, line_no, occurrence, norm_text, n_pages,
       'REPEATED_ON_PAGES:' || n_pages || '；POSITION_IS_A_HINT_ONLY' AS evidence
FROM frags JOIN chosen USING (source, norm_text)"""
CANDIDATE = ["candidate_id", "classification", "source", "doc_id", "line_no", "occurrence", "norm_text", "n_pages", "evidence"]


@query("repeated_text", REPEATED)
def repeated_text(t: Tables) -> DataFrame:
    """Every occurrence of a line that recurs on at least a tenth of its source's documents."""
    return repeats(t).select(*CANDIDATE)


@query("repeated_text_sieve", REPEATED)
def repeated_text_sieve(t: Tables) -> DataFrame:
    """The same lines, with all that stand on one page taken out before they are counted."""
    return frag.repeated_text(lines(t), t.documents, "source", "doc_id", min_share=SHARE, slots=SLOTS).select(*CANDIDATE)


@query("fragments", f"""
WITH {FRAGS} SELECT doc_id, line_no, occurrence, content FROM frags""")
def fragments(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "line_no", "occurrence", "content")


@query("norm", f"""
SELECT doc_id, sha256({NORM.format('text')}) AS norm_sha, CAST(length({NORM.format('text')}) AS INTEGER) AS norm_chars FROM documents""")
def norm(t: Tables) -> DataFrame:
    value = text.norm(F.col("text"))
    return t.documents.select("doc_id", F.sha2(value, 256).alias("norm_sha"), F.length(value).alias("norm_chars"))


@query("clean", f"""
SELECT conv_id, turn, nullif(substr({COLLAPSE.format('text')}, 1, 100), '') AS cleaned FROM conversations""")
def clean(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.clean(F.col("text"), 100).alias("cleaned"))


@query("safe_name", r"""
WITH base AS (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS b FROM pages)
SELECT page_id, substr(coalesce(nullif(regexp_replace(regexp_replace(b, '[\x00-\x1f\x7f]+', '_', 'g'),
       '^[ .]+|[ .]+$', '', 'g'), ''), 'upload.bin'), 1, 255) AS display_name FROM base""")
def safe_name(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.safe_name(F.col("url")).alias("display_name"))


@query("digest_id", """
SELECT doc_id, 'text-' || substr(sha256(concat_ws('|', source, lang, doc_id, text)), 1, 20) AS candidate_id FROM documents""")
def digest_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ids.digest_id(
        "text-", 20, F.col("source"), F.col("lang"), F.col("doc_id"), F.col("text")).alias("candidate_id"))


@query("pseudonym", """
SELECT c_custkey, substr(sha256('timing-v1:' || trim(c_name)), 1, 16) AS participant_id FROM customer""")
def pseudonym(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", ids.pseudonym(F.col("c_name"), "timing-v1").alias("participant_id"))


@query("target_text", f"""
WITH {FRAGS} SELECT doc_id, line_no, contains(norm_text, 'the') AS hit FROM frags""")
def target_text(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "line_no", text.text_match(F.col("content"), " THE ").alias("hit"))


# The generated names hold none of the default words, so the query names its own.
PART_WORDS = ("red", "small", "ring")


@query("lexicon_class", """
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'small')
  OR contains(lower(p_name), 'ring') OR contains(lower(p_name), 'widget') THEN 'ambiguous' ELSE 'content' END AS classification FROM part""")
def lexicon_class(t: Tables) -> DataFrame:
    return frag.layer_candidates(t.part, "p_name", PART_WORDS, "Widget").select("p_partkey", "classification")


@query("rule_class", """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'confirmed' ELSE 'ambiguous' END AS classification
FROM events WHERE event_type IN ('purchase', 'signup')""")
def rule_class(t: Tables) -> DataFrame:
    """Events as annotations: purchases stand for mark annotations, signups for stamps."""
    subtype = (F.when(F.col("event_type") == "purchase", "/Watermark")
               .when(F.col("event_type") == "signup", "/Stamp").otherwise(F.concat(F.lit("/"), "event_type")))
    return frag.annotation_candidates(t.events.withColumn("subtype", subtype)).select("event_id", "classification")


@query("evidence", """
SELECT doc_id, concat_ws('；', CASE WHEN lang = 'en' THEN 'LANGUAGE' END, CASE WHEN n_chars > 2000 THEN 'LONG' END,
  CASE WHEN contains(text, '@') THEN 'ADDRESS' END, 'HINT') AS evidence FROM documents""")
def evidence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.evidence(
        (F.col("lang") == "en", "LANGUAGE"), (F.col("n_chars") > 2000, "LONG"),
        (F.contains("text", F.lit("@")), "ADDRESS"), (F.lit(True), "HINT")).alias("evidence"))


@query("details_json", """
SELECT p_partkey, '{"size":' || p_size || ',"brand":"' || p_brand || '","type":"' || p_type || '"}' AS details FROM part""")
def details_json(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.details_json(
        size=F.col("p_size"), brand=F.col("p_brand"), type=F.col("p_type")).alias("details"))


@query("occurrence", """
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS occurrence FROM conversations""")
def occurrence(t: Tables) -> DataFrame:
    return numbered(t.conversations.select("conv_id", "turn", "role"), ["conv_id", "role"], [F.col("turn")],
                    chunk_of(F.col("turn")), "occurrence").withColumn("occurrence", F.col("occurrence").cast("bigint"))


@query("size_guard", """
WITH s AS (SELECT source, doc_id, octet_length(encode(text)) AS b FROM documents),
r AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM s)
SELECT source, CAST(sum(b) AS BIGINT) AS total_bytes, coalesce(min(CASE WHEN running > 100000 THEN doc_id END), -1) AS first_page_over,
  CASE WHEN max(running) > 100000 THEN 'RESOURCE_LIMIT' ELSE 'OK' END AS status FROM r GROUP BY source""")
def size_guard(t: Tables) -> DataFrame:
    """The documents of a source as the pages of one file, with a limit of 100 kB."""
    return frag.size_guard(t.documents, "source", "doc_id", F.octet_length("text").cast("bigint"), 100_000)


OBJECT_USES = """
WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem),
c AS (SELECT l_orderkey, l_partkey, count(*) AS n FROM u GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, n AS n_pages,
  CASE WHEN n >= 2 THEN 'ambiguous' ELSE 'content' END AS classification FROM lineitem JOIN c USING (l_orderkey, l_partkey)"""


@query("repeated_objects", OBJECT_USES)
def repeated_objects(t: Tables) -> DataFrame:
    """Order = asset, line number = page, part = object."""
    uses = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return frag.repeated_objects(uses, "l_orderkey", "l_linenumber", "l_partkey").withColumn(
        "n_pages", F.col("n_pages").cast("bigint"))


@query("repeated_objects_sieve", OBJECT_USES)
def repeated_objects_sieve(t: Tables) -> DataFrame:
    """The same classes; objects of one page are neither counted nor joined."""
    uses = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return frag.repeated_objects(uses, "l_orderkey", "l_linenumber", "l_partkey", slots=SLOTS).withColumn("n_pages", F.col("n_pages").cast("bigint"))


def object_candidates(t: Tables) -> DataFrame:
    return frag.repeated_objects(t.lineitem.select("l_suppkey", "l_linenumber", "l_partkey"),
                                 "l_suppkey", "l_linenumber", "l_partkey").filter("classification <> 'content'")


OBJECTS = """
u AS (SELECT DISTINCT l_suppkey, l_linenumber, l_partkey FROM lineitem),
c AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM u GROUP BY ALL),
objects AS (SELECT l_suppkey, l_linenumber, l_partkey, n FROM lineitem JOIN c USING (l_suppkey, l_partkey) WHERE n >= 2)
"""


@query("match_status", f"""
WITH {OBJECTS},
f AS (SELECT l_suppkey, bool_or(n >= 4) AS sure FROM objects GROUP BY l_suppkey)
SELECT s_suppkey, CASE WHEN sure THEN 'matched' WHEN sure IS NOT NULL THEN 'needs_review' ELSE 'not_found' END AS match_status
FROM supplier LEFT JOIN f ON s_suppkey = l_suppkey""")
def match_status(t: Tables) -> DataFrame:
    """Supplier = asset; an object on four pages counts as confirmed here."""
    cands = object_candidates(t).select(
        F.col("l_suppkey").alias("s_suppkey"),
        F.when(F.col("n_pages") >= 4, "confirmed").otherwise("ambiguous").alias("classification"))
    return frag.match_status(t.supplier, cands, "s_suppkey")


@query("candidate_union", f"""
WITH {FRAGS}, {CHOSEN}, {OBJECTS}
SELECT 'text' AS kind, source AS asset, doc_id AS page, content, n_pages FROM frags JOIN chosen USING (source, norm_text)
UNION ALL SELECT 'object', CAST(l_suppkey AS VARCHAR), l_linenumber, NULL, n FROM objects
UNION ALL SELECT 'annotation', CAST(user_id AS VARCHAR), event_id, NULL, NULL FROM events WHERE event_type IN ('purchase', 'signup')""")
def candidate_union(t: Tables) -> DataFrame:
    found = repeats(t).select(F.lit("text").alias("kind"), F.col("source").alias("asset"),
                              F.col("doc_id").alias("page"), "content", "n_pages")
    objects = object_candidates(t).select(
        F.lit("object").alias("kind"), F.col("l_suppkey").cast("string").alias("asset"),
        F.col("l_linenumber").cast("bigint").alias("page"), F.col("n_pages").cast("bigint").alias("n_pages"))
    notes = t.events.filter(F.col("event_type").isin("purchase", "signup")).select(
        F.lit("annotation").alias("kind"), F.col("user_id").cast("string").alias("asset"),
        F.col("event_id").alias("page"))
    return frag.union_candidates(found, objects, notes)


@query("apply_selection", f"""
WITH {FRAGS}, {CHOSEN},
b AS (SELECT source, count(*) AS before_rows FROM frags GROUP BY source),
r AS (SELECT source, count(*) AS removed_rows FROM frags JOIN chosen USING (source, norm_text) GROUP BY source)
SELECT source, before_rows, coalesce(removed_rows, 0) AS removed_rows, before_rows - coalesce(removed_rows, 0) AS after_rows,
  'COUNT_AS_PLANNED' AS status FROM b LEFT JOIN r USING (source)""")
def apply_selection(t: Tables) -> DataFrame:
    """Take the repeated lines out and check that exactly those are gone."""
    keys = ["doc_id", "occurrence"]
    selected = cut_lineage(repeats(t).select("source", *keys))
    rest = frag.apply_selection(lines(t), selected, keys)
    parts = [df.groupBy("source").agg(F.count(F.lit(1)).alias(name)) for df, name in (
        (lines(t), "before_rows"), (selected, "removed_rows"), (rest, "after_rows"))]
    out = parts[0].join(parts[1], "source", "left").join(parts[2], "source", "left").fillna(0)
    planned = F.col("before_rows") - F.col("removed_rows") == F.col("after_rows")
    return out.withColumn("status", F.when(planned, "COUNT_AS_PLANNED").otherwise("COUNT_DIFFERS"))


@query("invariance", f"""
WITH {FRAGS}, {CHOSEN},
m AS (SELECT f.*, c.n_pages IS NOT NULL AS sel FROM frags f LEFT JOIN chosen c ON f.source = c.source AND f.norm_text = c.norm_text)
SELECT lang, CASE WHEN sel THEN 'REMOVED_AS_SELECTED' WHEN content <> norm_text THEN 'CHANGED' ELSE 'UNCHANGED' END AS status,
  count(*) AS n FROM m GROUP BY ALL""")
def invariance(t: Tables) -> DataFrame:
    """Every fragment before and after an edit that drops repeats and folds case elsewhere."""
    keys = ["lang", "doc_id", "occurrence"]
    selected = cut_lineage(repeats(t).select(*keys))
    after = frag.apply_selection(lines(t), selected, keys).withColumn("content", text.norm(F.col("content")))
    return (frag.unchanged(lines(t), after, selected, keys, "content")
            .groupBy("lang", "status").agg(F.count(F.lit(1)).alias("n")))


EDITED = "doc_id % 50 = 7"


@query("invariance_digest", f"""
WITH {FRAGS}, {CHOSEN},
m AS (SELECT f.*, c.n_pages IS NOT NULL AND {EDITED} AS sel FROM frags f LEFT JOIN chosen c ON f.source = c.source AND f.norm_text = c.norm_text)
SELECT lang, CASE WHEN sel THEN 'REMOVED_AS_SELECTED' WHEN content <> norm_text AND {EDITED} THEN 'CHANGED' ELSE 'UNCHANGED' END AS status,
  count(*) AS n FROM m GROUP BY ALL""")
def invariance_digest(t: Tables) -> DataFrame:
    """The same edit in a fiftieth of the documents; the others' fragments stand in equal buckets and are not joined."""
    keys = ["lang", "doc_id", "occurrence"]
    selected = cut_lineage(repeats(t).where(EDITED).select(*keys))
    edited = frag.apply_selection(lines(t).where(EDITED), selected, keys).withColumn("content", text.norm(F.col("content")))
    after = lines(t).where(f"NOT ({EDITED})").unionByName(edited)
    return (digests.unchanged_by_digest(lines(t), after, selected, keys, "content")
            .groupBy("lang", "status").agg(F.count(F.lit(1)).alias("n")))


@query("golden_digest", f"""
WITH {FRAGS}, s AS (SELECT doc_id, occurrence, content FROM frags), g AS (SELECT doc_id, occurrence, CASE WHEN {EDITED} THEN content || '!' ELSE content END AS content FROM frags)
SELECT *, 'ONLY_STORED' AS status FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM g)
UNION ALL SELECT *, 'ONLY_RECOMPUTED' FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM s)""")
def golden_digest(t: Tables) -> DataFrame:
    """Stored fragments against ones recomputed with another ending in a fiftieth of the documents."""
    stored = lines(t).select("doc_id", "occurrence", "content")
    fresh = stored.withColumn("content", F.expr(f"CASE WHEN {EDITED} THEN content || '!' ELSE content END"))
    return digests.golden_diff_by_digest(fresh, stored, ["doc_id"])


@query("changed_pages", f"""
WITH {FRAGS}, {CHOSEN}
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position
FROM (SELECT DISTINCT source, doc_id FROM frags JOIN chosen USING (source, norm_text))""")
def changed_pages(t: Tables) -> DataFrame:
    """Sorted distinct pages that lose a line, per source, as numbered rows."""
    return sorted_distinct(repeats(t), ["source"], "doc_id", chunk_of(F.col("doc_id")))


@query("key_diff", """
SELECT doc_id, 'MISSING' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'UNKNOWN' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def key_diff_query(t: Tables) -> DataFrame:
    """Documents without a label, and labels without a document."""
    return key_diff(t.documents, t.labels, ["doc_id"])


@query("golden_diff", f"""
WITH g AS (SELECT source, lang, count(*) AS n_docs FROM documents GROUP BY ALL),
s AS (SELECT source, lang, count(*) AS n_docs FROM documents WHERE n_chars > 300 GROUP BY ALL)
SELECT source, lang, n_docs, 'ONLY_STORED' AS status FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM g)
UNION ALL SELECT source, lang, n_docs, 'ONLY_RECOMPUTED' FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM s)""")
def golden_diff_query(t: Tables) -> DataFrame:
    """A recomputed report against one that misses the short documents."""
    count = F.count(F.lit(1)).alias("n_docs")
    stored = t.documents.filter("n_chars > 300").groupBy("source", "lang").agg(count)
    return golden_diff(t.documents.groupBy("source", "lang").agg(count), stored)


@query("level_counts", """
SELECT source, count(*) FILTER (n_chars <= 500) AS low, count(*) FILTER (n_chars > 500 AND n_chars <= 3000) AS review,
 count(*) FILTER (n_chars > 3000) AS high FROM documents GROUP BY source""")
def level_counts_query(t: Tables) -> DataFrame:
    level = F.when(F.col("n_chars") <= 500, "low").when(F.col("n_chars") <= 3000, "review").otherwise("high")
    return level_counts(t.documents.withColumn("level", level), ["source"], "level", ["low", "review", "high"])
