"""Queries over package parts and operator sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.paths import part_path
from palimpsest.operators import packages as pk
from palimpsest.operators import sequences as sq
from palimpsest.plans.registry import Tables, query
from palimpsest.plans.roles import cents


@query("package_limits", """
WITH e AS (SELECT l_orderkey AS asset, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, CAST(round(l_extendedprice * 100) AS BIGINT) AS size_bytes,
 l_quantity = 50 AS encrypted, l_discount = 0.1 AS bad FROM lineitem),
r AS (SELECT *, sum(size_bytes) OVER (PARTITION BY asset ORDER BY line, part, supp, size_bytes) AS total FROM e),
c AS (SELECT *, CASE WHEN encrypted THEN 'PASSWORD_REQUIRED' WHEN bad THEN 'INVALID_DOCX' WHEN total > 20000000 THEN 'RESOURCE_LIMIT' END AS code FROM r)
SELECT asset, count(*) AS n_entries, CAST(max(total) AS BIGINT) AS total_bytes, CASE WHEN count(*) > 8 THEN 'RESOURCE_LIMIT' ELSE coalesce(arg_min(code, (line, part, supp, size_bytes)) FILTER (code IS NOT NULL), 'OK') END AS status
FROM c GROUP BY asset""")
def package_limits(t: Tables) -> DataFrame:
    """Orders as packages: at most 8 entries and 20 million bytes."""
    name = F.concat(F.lit("word/"), F.when(F.col("l_discount") == 0.1, "../").otherwise(""), F.col("l_partkey").cast("string"), F.lit(".xml"))
    entries = t.lineitem.select(F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
                                F.col("l_suppkey").alias("supp"), cents("l_extendedprice").alias("size_bytes"), (F.col("l_quantity") == 50).alias("encrypted"), name.alias("part_name"))
    return pk.package_status(entries, "asset", ["line", "part", "supp", "size_bytes"], max_entries=8, max_bytes=20_000_000)


def relations(t: Tables) -> DataFrame:
    """Line items as relationships with targets written in several ways."""
    part, line = F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")
    name = F.concat(F.lit("img"), part, F.lit(".png"))
    forms = F.array(F.concat(F.lit("media/"), name), F.concat(F.lit("../word/./media/"), name), F.concat(F.lit("/word//media/"), name, F.lit("#x")),
                    F.concat(F.lit("../../media/"), name), F.concat(F.lit("media%2F"), name))
    target = F.element_at(forms, (F.col("l_suppkey") % 5 + 1).cast("int"))
    kind = F.when(F.col("l_linestatus") == "O", "http://x/relationships/image").otherwise("http://x/relationships/hyperlink")
    return t.lineitem.select(
        F.col("l_orderkey").alias("asset"), F.concat(F.lit("word/header"), line, F.lit(".xml")).alias("owner"), target.alias("target"),
        F.when(F.col("l_tax") > 0.06, "External").alias("target_mode"), kind.alias("type"), F.lit(1).alias("package"))


def part_names(t: Tables) -> DataFrame:
    return t.part.filter("p_size > 10").select(
        F.lit(1).alias("package"), F.concat(F.lit("word/media/img"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("part_name"))


RELS = """
rels AS (SELECT l_orderkey AS asset, 'word/header' || l_linenumber || '.xml' AS owner, l_tax > 0.06 AS external, l_linestatus = 'O' AS image, l_suppkey % 5 AS form,
 CASE WHEN l_suppkey % 5 = 3 THEN NULL ELSE 'word/media/img' || l_partkey || '.png' END AS resolved FROM lineitem),
names AS (SELECT 'word/media/img' || p_partkey || '.png' AS resolved FROM part WHERE p_size > 10)
"""


@query("part_path", f"WITH {RELS} SELECT asset, owner, form, coalesce(resolved, '') AS resolved FROM rels")
def part_path_query(t: Tables) -> DataFrame:
    rows = relations(t)
    form = (F.when(F.col("target").startswith("media/"), 0).when(F.col("target").startswith("../word"), 1).when(F.col("target").startswith("/word"), 2)
            .when(F.col("target").startswith("../../"), 3).otherwise(4)).cast("bigint")
    return rows.select("asset", "owner", form.alias("form"), F.coalesce(part_path(F.col("owner"), F.col("target")), F.lit("")).alias("resolved"))


@query("rel_resolve", f"""WITH {RELS}
SELECT asset, owner, coalesce(resolved, '') AS resolved, CASE WHEN external THEN 'EXTERNAL' WHEN resolved IN (SELECT resolved FROM names) THEN 'OK' ELSE 'INVALID_TARGET' END AS status FROM rels WHERE image""")
def rel_resolve(t: Tables) -> DataFrame:
    """All packages share one media folder here: parts larger than size 10 exist."""
    return pk.resolve_rels(relations(t), part_names(t), ["package"]).select("asset", "owner", F.coalesce("resolved", F.lit("")).alias("resolved"), "status")


HEADERS = """
h AS (SELECT l_orderkey AS asset, CASE WHEN l_linenumber % 4 = 0 THEN 'word/document.xml' ELSE 'word/header' || l_linenumber || '.xml' END AS part_name, l_linenumber AS line,
 l_returnflag AS flag, l_linestatus AS status, l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_linenumber % 4 <> 0)
"""


def header_parts(t: Tables, xml) -> DataFrame:
    """Line items as parts: every fourth line is the document itself, the others are headers."""
    name = F.when(F.col("l_linenumber") % 4 == 0, "word/document.xml").otherwise(F.concat(F.lit("word/header"), F.col("l_linenumber").cast("string"), F.lit(".xml")))
    return t.lineitem.select(F.col("l_orderkey").alias("asset"), name.alias("part_name"), xml.alias("xml"))


@query("header_shapes", f"""WITH {HEADERS},
s AS (SELECT *, 'Order & ' || flag AS content, status = 'O' AS known, flag = 'R' AS same FROM h)
SELECT asset, part_name, 1 AS shape_index, content, CASE WHEN known AND same THEN 'confirmed' ELSE 'ambiguous' END AS classification,
 concat_ws('；', 'HEADER_TEXT_SHAPE', CASE WHEN known THEN 'BUILT_IN_MARK_SHAPE' END, CASE WHEN same THEN 'EXACT_TARGET_TEXT' END) AS evidence,
 'docx-' || substr(sha256(asset || '|' || part_name || '|1|' || content), 1, 20) AS candidate_id FROM s""")
def header_shapes(t: Tables) -> DataFrame:
    """An empty shape and a text shape per header; open lines use the built-in mark shape."""
    kind = F.when(F.col("l_linestatus") == "O", "#_x0000_t136").otherwise("#_x0000_t75")
    xml = F.concat(F.lit('<w:hdr><v:shape type="a"/><v:shape style="z" type="'), kind, F.lit('"><v:textpath string=" Order &amp; '), F.col("l_returnflag"),
                   F.lit(' "/></v:shape></w:hdr>'))
    found = pk.shape_candidates(header_parts(t, xml), "asset", "ORDER & r")
    return found.select("asset", "part_name", F.col("shape_index").cast("int").alias("shape_index"), "content", "classification", "evidence", "candidate_id")


@query("header_images", f"""WITH {HEADERS},
d AS (SELECT *, 'Logo ' || flag || CASE WHEN flag = 'N' THEN '' ELSE ' · A & B' END AS content, status = 'O' AS floating, supp % 3 = 0 AS behind, p_size > 10 AS shown
  FROM h JOIN part ON p_partkey = part)
SELECT asset, part_name AS owner, 0 AS drawing_index, 'word/media/img' || part || '.png' AS media_part, content, concat_ws('；', 'HEADER_IMAGE', CASE WHEN floating THEN 'FLOATING' END,
  CASE WHEN floating AND behind THEN 'BEHIND_TEXT' END, CASE WHEN flag = 'R' THEN 'LABEL_HAS_TARGET' END, CASE WHEN NOT shown THEN 'NOT_PREVIEWABLE' END) AS evidence,
 CASE WHEN shown THEN 'object' ELSE '' END AS strategies,
 'docx-' || substr(sha256(asset || '|' || part_name || '|drawing|0|rId' || part || '|' || sha256(CAST(part AS VARCHAR))), 1, 20) AS candidate_id FROM d""")
def header_images(t: Tables) -> DataFrame:
    """One drawing per header, floating on open lines; pictures of parts up to size 10 cannot be shown."""
    part = F.col("l_partkey").cast("string")
    kind = F.when(F.col("l_linestatus") == "O", "anchor").otherwise("inline")
    label = F.when(F.col("l_returnflag") == "N", "").otherwise('descr=" A &amp; B "')
    xml = F.concat(F.lit("<w:hdr><wp:"), kind, F.lit(' behindDoc="'), F.when(F.col("l_suppkey") % 3 == 0, "1").otherwise("0"), F.lit('"><wp:docPr title="Logo '),
                   F.col("l_returnflag"), F.lit('" '), label, F.lit('/><a:blip r:embed="rId'), part, F.lit('"/></wp:'), kind, F.lit("></w:hdr>"))
    parts = header_parts(t, xml)
    media = t.part.select(F.concat(F.lit("word/media/img"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("part_name"),
                          F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha256"), F.when(F.col("p_size") > 10, "image/png").alias("media_type"))
    rels = t.lineitem.where("l_linenumber % 4 <> 0").select(
        F.col("l_orderkey").alias("asset"), F.concat(F.lit("word/header"), F.col("l_linenumber").cast("string"), F.lit(".xml")).alias("owner"),
        F.concat(F.lit("rId"), part).alias("rel_id"), F.concat(F.lit("word/media/img"), part, F.lit(".png")).alias("resolved"), F.lit("OK").alias("status")).distinct()
    owned = rels.select("asset", F.col("resolved").alias("part_name")).distinct().join(media, "part_name")
    found = pk.drawing_candidates(parts, rels, owned, "asset", "Logo R")
    return found.select("asset", "owner", F.col("drawing_index").cast("int").alias("drawing_index"), "media_part", "content", "evidence",
                        F.array_join("allowed_strategies", ",").alias("strategies"), "candidate_id")


@query("dangling_refs", f"""WITH {RELS}
SELECT asset, owner, coalesce(resolved, '') AS resolved FROM rels r WHERE NOT external AND NOT EXISTS (SELECT 1 FROM names n WHERE n.resolved = r.resolved)""")
def dangling_refs(t: Tables) -> DataFrame:
    return pk.dangling(relations(t), part_names(t), ["package"]).select("asset", "owner", F.coalesce("resolved", F.lit("")).alias("resolved"))


# Turns of a conversation as operators: two turns of equal length class, an optional user turn, an assistant turn.
TURNS = (sq.Step(("user", "system"), bind=True), sq.Step(("assistant", "user"), bind=True), sq.Step(("user",), optional=True), sq.Step(("assistant",)))


def operators(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("op"), (F.length("text") % 2).cast("string").alias("name"))


MATCHES = """
ops AS (SELECT conv_id, turn AS pos, role AS op, CAST(length(text) % 2 AS VARCHAR) AS name FROM conversations),
ahead AS (SELECT *, lead(op) OVER w AS o1, lead(name) OVER w AS n1, lead(op, 2) OVER w AS o2, lead(op, 3) OVER w AS o3 FROM ops WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
hits AS (SELECT conv_id, pos, name, CASE WHEN o2 = 'user' AND o3 = 'assistant' THEN 4 WHEN o2 = 'assistant' THEN 3 END AS length FROM ahead
 WHERE op IN ('user', 'system') AND o1 IN ('assistant', 'user') AND n1 = name AND (o2 = 'assistant' OR (o2 = 'user' AND o3 = 'assistant')))
"""


@query("sequence_match", f"WITH {MATCHES} SELECT conv_id, pos, name, length FROM hits")
def sequence_match(t: Tables) -> DataFrame:
    return sq.sequence_match(operators(t), ["conv_id"], TURNS)


@query("nonoverlap", f"""WITH RECURSIVE {MATCHES},
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM hits),
walk AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS free, CAST(0 AS BIGINT) AS n FROM hits
 UNION ALL SELECT w.conv_id, k.i, CASE WHEN k.pos >= w.free THEN k.pos + k.length ELSE w.free END, w.n + CASE WHEN k.pos >= w.free THEN 1 ELSE 0 END FROM walk w JOIN k ON k.conv_id = w.conv_id AND k.i = w.i + 1)
SELECT conv_id, max(n) AS n_matches FROM walk GROUP BY conv_id""")
def nonoverlap(t: Tables) -> DataFrame:
    return sq.nonoverlapping(sq.sequence_match(operators(t), ["conv_id"], TURNS), ["conv_id"], len(TURNS))


def pattern_hits(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("asset"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("name"))


def pattern_resources(t: Tables) -> DataFrame:
    """Parts with an odd number are patterns of their supplier's pages; their size gives the type."""
    return (t.lineitem.select(F.col("l_suppkey").alias("asset"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("name")).distinct()
            .join(t.part.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("name"), (F.col("p_size") % 3).alias("pattern_type"), F.col("p_brand").alias("object_ref")), "name"))


RESOURCES = """
hits AS (SELECT l_suppkey AS asset, l_linenumber AS page, l_partkey AS name FROM lineitem),
res AS (SELECT DISTINCT asset, page, name, p_size % 3 AS pattern_type FROM hits JOIN part ON p_partkey = name WHERE p_partkey % 2 = 1),
found AS (SELECT h.asset, h.page, h.name, CASE WHEN pattern_type = 1 THEN 'confirmed' ELSE 'ambiguous' END AS classification FROM hits h LEFT JOIN res r ON h.asset = r.asset AND h.page = r.page AND h.name = r.name)
"""


@query("resource_resolve", f"WITH {RESOURCES} SELECT asset, page, name, classification FROM found")
def resource_resolve(t: Tables) -> DataFrame:
    return sq.resolve_patterns(pattern_hits(t), pattern_resources(t), ["asset", "page"]).select("asset", "page", "name", "classification")


@query("diagnostics", f"""WITH {RESOURCES},
p AS (SELECT asset, count(DISTINCT page) AS pages_scanned FROM hits GROUP BY asset),
r AS (SELECT asset, count(DISTINCT page) AS pages_with_pattern_resources, count(*) AS pattern_resource_count, count(*) FILTER (pattern_type = 1) AS tiling_pattern_resource_count FROM res GROUP BY asset),
c AS (SELECT asset, count(*) AS complete_signature_count, count(*) FILTER (classification = 'confirmed') AS confirmed_signature_count, count(*) FILTER (classification = 'ambiguous') AS ambiguous_signature_count FROM found GROUP BY asset)
SELECT asset, pages_scanned, coalesce(pages_with_pattern_resources, 0) AS pages_with_pattern_resources, coalesce(pattern_resource_count, 0) AS pattern_resource_count,
 coalesce(tiling_pattern_resource_count, 0) AS tiling_pattern_resource_count, complete_signature_count, confirmed_signature_count, ambiguous_signature_count FROM p JOIN c USING (asset) LEFT JOIN r USING (asset)""")
def diagnostics(t: Tables) -> DataFrame:
    found = sq.resolve_patterns(pattern_hits(t), pattern_resources(t), ["asset", "page"])
    return sq.diagnostics(pattern_hits(t), pattern_resources(t), found, ["asset"], "page")
