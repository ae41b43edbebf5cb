"""Queries over assets, plans, tasks and their artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.measures import display_dims, elapsed_seconds, orientation
from palimpsest.operators import governance as gov
from palimpsest.plans.registry import Tables, query
from palimpsest.sources import assets as src
from palimpsest.sources.ocr import ocr_words

NOW = "2024-02-10 00:00:00"


def files(t: Tables) -> DataFrame:
    """Document texts behind the leading bytes of several formats; every ninth file is empty."""
    doc = F.col("doc_id")
    lead = ["255044462D", "89504E470D0A1A0A", "FFD8FF", "504B0304", "504B0304", "524946460000000057454250", ""]
    prefix = F.unhex(F.element_at(F.array(*[F.lit(v) for v in lead]), (doc % 7 + 1).cast("int")))
    content = F.when(doc % 9 == 0, F.lit(b"")).otherwise(F.concat(prefix, F.encode("text", "UTF-8")))
    name = F.concat(F.lit("file"), doc.cast("string"), F.when(doc % 7 == 3, ".DOCX").otherwise(".bin"))
    rows = t.documents.select(doc.alias("doc_id"), F.concat(F.lit("/in/"), name).alias("path"), content.alias("content"))
    return rows.select("doc_id", F.octet_length("content").cast("bigint").alias("size_bytes"), F.sha2("content", 256).alias("sha256"),
                       *src.kind_columns(F.col("content"), F.col("path")))


FILES = r"""
raw AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ''::BLOB ELSE
  (CASE doc_id % 7 WHEN 0 THEN '%PDF-'::BLOB WHEN 1 THEN '\x89PNG\x0D\x0A\x1A\x0A'::BLOB WHEN 2 THEN '\xFF\xD8\xFF'::BLOB WHEN 3 THEN 'PK\x03\x04'::BLOB
   WHEN 4 THEN 'PK\x03\x04'::BLOB WHEN 5 THEN 'RIFF\x00\x00\x00\x00WEBP'::BLOB ELSE ''::BLOB END) || encode(text) END AS content FROM documents),
files AS (SELECT doc_id, octet_length(content) AS size_bytes, sha256(content) AS sha256,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE [ 'pdf', 'png', 'jpeg', 'docx', NULL, 'webp', NULL ][doc_id % 7 + 1] END AS kind FROM raw)
"""


@query("asset_kind", f"WITH {FILES} SELECT doc_id, size_bytes, sha256, coalesce(kind, 'unknown') AS kind FROM files")
def asset_kind(t: Tables) -> DataFrame:
    return files(t).select("doc_id", "size_bytes", "sha256", F.coalesce("kind", F.lit("unknown")).alias("kind"))


@query("asset_admit", f"""WITH {FILES} SELECT doc_id, CASE WHEN size_bytes > 20000 THEN 'RESOURCE_LIMIT' WHEN size_bytes = 0 THEN 'INVALID_FILE'
 WHEN kind IS NULL THEN 'UNSUPPORTED_FORMAT' ELSE 'OK' END AS code FROM files""")
def asset_admit(t: Tables) -> DataFrame:
    ok, rejects = src.admit(files(t), 20_000)
    return ok.select("doc_id", F.lit("OK").alias("code")).unionByName(rejects.select("doc_id", "code"))


@query("limits", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey * 15 - 30 AS w, l_suppkey * 300 AS h, l_linenumber * 17 AS f, l_returnflag = 'A' AND l_quantity > 40 AS other FROM lineitem)
SELECT l_orderkey, l_linenumber, w, h, CASE WHEN other THEN 'FORMAT_MISMATCH' WHEN w <= 0 OR h <= 0 THEN 'INVALID_IMAGE' WHEN w > 20000 OR h > 20000 THEN 'RESOURCE_LIMIT_SIDE'
 WHEN w * h > 40000000 THEN 'RESOURCE_LIMIT_PIXELS' WHEN f > 100 THEN 'RESOURCE_LIMIT_FRAMES' ELSE 'OK' END AS code FROM p""")
def limits(t: Tables) -> DataFrame:
    w, h, frames = F.col("l_partkey") * 15 - 30, F.col("l_suppkey") * 300, F.col("l_linenumber") * 17
    found = F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40), "jpeg").otherwise("png")
    return t.lineitem.select("l_orderkey", "l_linenumber", w.alias("w"), h.alias("h"),
                             src.image_limits(F.lit("png"), found, w, h, frames).alias("code"))


@query("orientation", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey AS w, l_suppkey AS h, CAST(l_quantity AS BIGINT) % 11 AS o FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN o BETWEEN 1 AND 8 THEN o ELSE 1 END AS turn, CASE WHEN o BETWEEN 5 AND 8 THEN h ELSE w END AS display_width,
 CASE WHEN o BETWEEN 5 AND 8 THEN w ELSE h END AS display_height FROM p""")
def orientation_query(t: Tables) -> DataFrame:
    turn = F.col("l_quantity").cast("bigint") % 11
    w, h = display_dims(F.col("l_partkey"), F.col("l_suppkey"), turn)
    return t.lineitem.select("l_orderkey", "l_linenumber", orientation(turn).alias("turn"), w.alias("display_width"), h.alias("display_height"))


@query("ocr_words", """
SELECT l_orderkey, l_returnflag AS text, (l_partkey % 40) / 200.0::DOUBLE * 60 AS x0, (l_suppkey % 30) / 150.0::DOUBLE * 45 AS y0,
 (l_partkey % 40 + l_linenumber - 1) / 200.0::DOUBLE * 60 AS x1, (l_suppkey % 30 + 7) / 150.0::DOUBLE * 45 AS y1 FROM lineitem
WHERE l_returnflag <> 'N' AND l_quantity >= 30 AND l_linenumber > 1 AND l_tax <> 0.08""")
def ocr_words_query(t: Tables) -> DataFrame:
    """Line items as recognised words: quantity = confidence, blank text on N, an unreadable number at tax 0.08."""
    text = F.col("l_returnflag")
    rows = t.lineitem.select(
        "l_orderkey", F.when(text == "N", "  ").otherwise(F.concat(F.lit(" "), text)).alias("text"),
        F.when(F.col("l_tax") == 0.08, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("conf"),
        (F.col("l_partkey") % 40).cast("string").alias("left"), (F.col("l_suppkey") % 30).cast("string").alias("top"),
        (F.col("l_linenumber") - 1).cast("string").alias("width"), F.lit("7").alias("height"))
    return ocr_words(rows, F.lit(200.0), F.lit(150.0), F.lit(60.0), F.lit(45.0), ["l_orderkey"])


def operations(t: Tables) -> DataFrame:
    candidate = F.col("l_partkey") + F.when(F.col("l_quantity") > 48, 1_000_000).otherwise(0)
    return t.lineitem.select(F.col("l_orderkey").alias("plan_id"), candidate.alias("candidate_id"),
                             F.when(F.col("l_tax") > 0.06, "region").otherwise("object").alias("strategy"))


def part_candidates(t: Tables) -> DataFrame:
    kind = (F.when(F.col("p_type") == "PROMO", "confirmed").when(F.col("p_type").isin("LARGE", "MEDIUM"), "ambiguous").otherwise("content"))
    allowed = F.when(F.col("p_size") > 10, F.array(F.lit("object"))).otherwise(F.array(F.lit("object"), F.lit("region")))
    return t.part.select(F.col("p_partkey").alias("candidate_id"), kind.alias("classification"), allowed.alias("allowed_strategies"))


OPS = """
ops AS (SELECT l_orderkey AS plan_id, l_partkey + CASE WHEN l_quantity > 48 THEN 1000000 ELSE 0 END AS candidate_id, CASE WHEN l_tax > 0.06 THEN 'region' ELSE 'object' END AS strategy FROM lineitem),
pc AS (SELECT p_partkey AS candidate_id, CASE WHEN p_type = 'PROMO' THEN 'confirmed' WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'ambiguous' ELSE 'content' END AS classification, p_size FROM part),
checked AS (SELECT plan_id, candidate_id, strategy, classification, CASE WHEN count(*) OVER (PARTITION BY plan_id, candidate_id) > 1 THEN 'DUPLICATE_CANDIDATE'
 WHEN classification IS NULL THEN 'UNKNOWN_CANDIDATE' WHEN strategy = 'region' AND p_size > 10 THEN 'STRATEGY_NOT_ALLOWED' WHEN classification = 'content' THEN 'CONTENT_SELECTED' ELSE 'OK' END AS status
 FROM ops LEFT JOIN pc USING (candidate_id))
"""


@query("op_status", f"WITH {OPS} SELECT plan_id, candidate_id, strategy, status FROM checked")
def op_status(t: Tables) -> DataFrame:
    return gov.operation_status(operations(t), part_candidates(t), ["plan_id"]).select("plan_id", "candidate_id", "strategy", "status")


@query("select_join", f"""WITH {OPS}
SELECT plan_id, candidate_id, classification, CASE classification WHEN 'ambiguous' THEN 'AMBIGUOUS_CANDIDATE:' || candidate_id ELSE '' END AS required_code FROM checked WHERE status = 'OK'""")
def select_join(t: Tables) -> DataFrame:
    """The accepted selection with the acknowledgement each ambiguous candidate needs."""
    ok = gov.operation_status(operations(t), part_candidates(t), ["plan_id"]).filter("status = 'OK'")
    code = F.when(F.col("classification") == "ambiguous", gov.ambiguous_code(F.col("candidate_id"))).otherwise("")
    return ok.select("plan_id", "candidate_id", "classification", code.alias("required_code"))


@query("ack_algebra", f"""WITH {OPS},
need AS (SELECT DISTINCT plan_id, 'AMBIGUOUS_CANDIDATE:' || candidate_id AS code FROM checked WHERE classification = 'ambiguous'),
got AS (SELECT DISTINCT l_orderkey AS plan_id, 'AMBIGUOUS_CANDIDATE:' || l_partkey AS code FROM lineitem JOIN pc ON candidate_id = l_partkey
  WHERE (classification = 'ambiguous' AND l_tax > 0.01) OR l_discount = 0.1),
j AS (SELECT coalesce(need.plan_id, got.plan_id) AS plan_id, need.code IS NULL AS unknown, got.code IS NULL AS missing FROM need FULL JOIN got ON need.plan_id = got.plan_id AND need.code = got.code)
SELECT plan_id, count(*) FILTER (unknown) AS n_unknown, count(*) FILTER (missing) AS n_missing, CASE WHEN count(*) FILTER (unknown) > 0 THEN 'ACKNOWLEDGEMENT_INVALID'
 WHEN count(*) FILTER (missing) > 0 THEN 'ACKNOWLEDGEMENT_REQUIRED' ELSE 'OK' END AS status FROM j GROUP BY plan_id""")
def ack_algebra(t: Tables) -> DataFrame:
    cands = part_candidates(t).select("candidate_id", "classification")
    need = operations(t).join(cands, "candidate_id").filter("classification = 'ambiguous'").select(
        "plan_id", gov.ambiguous_code(F.col("candidate_id")).alias("code"))
    given = t.lineitem.select(F.col("l_orderkey").alias("plan_id"), F.col("l_partkey").alias("candidate_id"), "l_tax", "l_discount")
    given = given.join(cands, "candidate_id").filter("(classification = 'ambiguous' AND l_tax > 0.01) OR l_discount = 0.1")
    codes = gov.acknowledgements(need, given.select("plan_id", gov.ambiguous_code(F.col("candidate_id")).alias("code")), "plan_id")
    return gov.acknowledgement_status(codes, "plan_id")


@query("stale_join", """
SELECT o_orderkey AS plan_id, CASE WHEN c_custkey IS NULL THEN 'ASSET_NOT_FOUND' WHEN o_orderstatus = 'P' THEN 'PLAN_STALE'
 WHEN o_orderpriority = '2-HIGH' THEN 'ANALYSIS_NOT_FOUND' WHEN o_orderpriority = '5-LOW' THEN 'PLAN_STALE' ELSE 'OK' END AS status
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') ON c_custkey = o_custkey""")
def stale_join(t: Tables) -> DataFrame:
    """Orders are plans and analyses, customers the assets; machinery ones are gone."""
    def sha(name: str, broken=None):
        plain = F.sha2(F.col(name).cast("string"), 256)
        return plain if broken is None else F.when(broken, F.sha2(F.lit("older"), 256)).otherwise(plain)

    assets = t.customer.filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("asset_id"), sha("c_custkey").alias("sha256"))
    plans = t.orders.select(F.col("o_orderkey").alias("plan_id"), F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("analysis_id"),
                            sha("o_custkey", F.col("o_orderstatus") == "P").alias("asset_sha256"))
    analyses = t.orders.filter("o_orderpriority <> '2-HIGH'").select(
        F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("asset_id"),
        sha("o_custkey", F.col("o_orderpriority") == "5-LOW").alias("asset_sha256"))
    return gov.freshness(plans, analyses, assets)


def artifacts(t: Tables) -> DataFrame:
    """Line items as artifacts of the task with their order's number."""
    order, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    page = F.when(F.col("l_quantity") == 50, "x").otherwise(line)
    path = (F.when(F.col("l_returnflag") == "A", F.concat(F.lit("artifacts/"), order, F.lit("/result.pdf")))
            .otherwise(F.concat(F.lit("artifacts/"), order, F.when(F.col("l_returnflag") == "N", "/source/page-").otherwise("/result/page-"), page, F.lit(".png"))))
    media = F.when(F.col("l_returnflag") == "A", "application/pdf").otherwise("image/png")
    rows = t.lineitem.select(F.col("l_orderkey").alias("task_id"), path.alias("path"), media.alias("media_type"), F.col("l_partkey").alias("size_bytes"))
    role, number = src.artifact_role(F.col("path"), F.col("media_type"))
    return rows.withColumns({"role": role, "page_number": number})


ARTIFACTS = """
arts AS (SELECT l_orderkey AS task_id, CASE l_returnflag WHEN 'A' THEN 'artifacts/' || l_orderkey || '/result.pdf'
  ELSE 'artifacts/' || l_orderkey || CASE l_returnflag WHEN 'N' THEN '/source/page-' ELSE '/result/page-' END || CASE WHEN l_quantity = 50 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END || '.png' END AS path,
  CASE l_returnflag WHEN 'A' THEN 'output' WHEN 'N' THEN 'source_preview' ELSE 'result_preview' END AS role, l_partkey AS size_bytes,
  CASE WHEN l_returnflag <> 'A' AND l_quantity <> 50 THEN l_linenumber END AS page_number FROM lineitem)
"""


@query("artifact_roles", f"WITH {ARTIFACTS} SELECT task_id, path, role, coalesce(page_number, -1) AS page_number FROM arts")
def artifact_roles(t: Tables) -> DataFrame:
    return artifacts(t).select("task_id", "path", "role", F.coalesce("page_number", F.lit(-1)).alias("page_number"))


@query("artifact_order", f"""WITH {ARTIFACTS} SELECT task_id, role, path, row_number() OVER (PARTITION BY task_id ORDER BY
 CASE role WHEN 'output' THEN 0 WHEN 'source_preview' THEN 1 ELSE 2 END, coalesce(page_number, 0), path) - 1 AS position FROM arts""")
def artifact_order(t: Tables) -> DataFrame:
    return gov.reading_order(artifacts(t)).select("task_id", "role", "path", "position")


@query("page_align", f"""WITH {ARTIFACTS} SELECT task_id, page_number, max(path) FILTER (role = 'source_preview') AS source_path, max(path) FILTER (role = 'result_preview') AS result_path
 FROM arts WHERE page_number IS NOT NULL GROUP BY ALL""")
def page_align(t: Tables) -> DataFrame:
    return gov.align_pages(artifacts(t))


@query("changed_parts", """
SELECT task_id, part, row_number() OVER (PARTITION BY task_id ORDER BY part) AS position FROM (SELECT DISTINCT l_orderkey AS task_id,
 CASE WHEN l_returnflag = 'A' THEN 'word/header' || l_linenumber || '.xml' ELSE 'page:' || l_linenumber END AS part FROM lineitem)""")
def changed_parts(t: Tables) -> DataFrame:
    line = F.col("l_linenumber").cast("string")
    part = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("word/header"), line, F.lit(".xml"))).otherwise(F.concat(F.lit("page:"), line))
    rows = t.lineitem.select(F.col("l_orderkey").alias("task_id"), part.alias("part"))
    return gov.sorted_distinct(rows, ["task_id"], "part")


def tasks(t: Tables) -> DataFrame:
    return tasks_of(t.events)


def tasks_of(events: DataFrame) -> DataFrame:
    """Events as tasks; the value is their running time in seconds."""
    states = F.create_map(*[F.lit(v) for v in ("view", "queued", "click", "running", "purchase", "succeeded", "error", "failed", "signup", "cancelled")])
    created = F.col("ts").cast("timestamp")
    error = F.when(F.col("event_type") == "error", F.when(F.col("user_id") % 4 == 0, F.lit('{"message":"m"}')).otherwise(F.lit('{"code":"PROCESSING_FAILED","message":"m"}')))
    return events.select(
        F.col("event_id").alias("task_id"), F.col("user_id").alias("plan_id"), states[F.col("event_type")].alias("status"),
        F.when(F.col("event_type").isin("view", "click"), 0.5).otherwise(1.0).alias("progress"), created.alias("created_at"),
        F.timestamp_micros(F.unix_micros(created) + (F.col("value") * 1_000_000).cast("bigint")).alias("updated_at"), error.alias("error_json"))


TASKS = f"""
tasks AS (SELECT event_id AS task_id, user_id AS plan_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
 ts AS created_at, CASE WHEN event_type IN ('view', 'click') THEN epoch_us(TIMESTAMP '{NOW}') ELSE epoch_us(ts) + CAST(trunc(value * 1000000) AS BIGINT) END AS end_us,
 epoch_us(ts) + CAST(trunc(value * 1000000) AS BIGINT) AS updated_us, user_id % 4 = 0 AS bare FROM events)
"""


def report(t: Tables) -> DataFrame:
    plans = t.customer.select(F.col("c_custkey").alias("plan_id"), F.col("c_nationkey").alias("asset_id"), F.col("c_mktsegment").alias("kind"))
    assets = t.nation.select(F.col("n_nationkey").alias("asset_id"), F.col("n_name").alias("display_name"), F.lit("application/pdf").alias("media_type"),
                             (F.col("n_regionkey") * 10).alias("size_bytes"), F.sha2("n_name", 256).alias("sha256"))
    return gov.task_report(tasks(t), plans, assets, artifacts(t), F.lit(NOW).cast("timestamp"))


REPORT = f"""
{TASKS}, {ARTIFACTS},
sums AS (SELECT task_id, count(*) AS artifact_count, sum(size_bytes)::BIGINT AS artifact_bytes, count(*) FILTER (role = 'source_preview') AS source_page_count,
 count(*) FILTER (role = 'result_preview') AS result_page_count FROM arts GROUP BY task_id),
report AS (SELECT t.task_id, plan_id, status, c_mktsegment AS kind, n_name AS display_name, c_nationkey AS asset_id, (end_us - epoch_us(created_at)) / 1000000 AS duration_seconds,
 coalesce(artifact_count, 0) AS artifact_count, coalesce(artifact_bytes, 0) AS artifact_bytes, coalesce(source_page_count, 0) AS source_page_count, coalesce(result_page_count, 0) AS result_page_count,
 n_regionkey * 10 AS size_bytes, sha256(n_name) AS sha256, bare
 FROM tasks t JOIN customer ON c_custkey = plan_id JOIN nation ON n_nationkey = c_nationkey LEFT JOIN sums USING (task_id))
"""


@query("task_report", f"""WITH {REPORT} SELECT task_id, status, kind, display_name, round(duration_seconds, 6) AS duration_seconds, artifact_count, artifact_bytes, source_page_count, result_page_count FROM report""")
def task_report(t: Tables) -> DataFrame:
    return report(t).select("task_id", "status", "kind", "display_name", F.round("duration_seconds", 6).alias("duration_seconds"),
                            "artifact_count", "artifact_bytes", "source_page_count", "result_page_count")


@query("privacy_projection", f"""WITH {REPORT} SELECT task_id, plan_id, status, CASE WHEN status IN ('queued', 'running') THEN 0.5::DOUBLE ELSE 1.0 END AS progress,
 round(duration_seconds, 6) AS duration_seconds, kind, asset_id, 'application/pdf' AS media_type, size_bytes, sha256, artifact_count, artifact_bytes, source_page_count, result_page_count,
 CASE WHEN status <> 'failed' THEN '' WHEN bare THEN 'UNKNOWN' ELSE 'PROCESSING_FAILED' END AS error_code FROM report""")
def privacy_projection(t: Tables) -> DataFrame:
    shown = gov.public_report(report(t))
    return shown.withColumns({"duration_seconds": F.round("duration_seconds", 6), "error_code": F.coalesce("error_code", F.lit(""))})


@query("elapsed", f"WITH {TASKS} SELECT task_id, round((end_us - epoch_us(created_at)) / 1000000, 6) AS seconds FROM tasks")
def elapsed(t: Tables) -> DataFrame:
    open_task = ~F.col("status").isin(*gov.TERMINAL)
    seconds = elapsed_seconds(F.col("created_at"), F.col("updated_at"), open_task, F.lit(NOW).cast("timestamp"))
    return tasks(t).select("task_id", F.round(seconds, 6).alias("seconds"))


@query("recent_tasks", f"WITH {TASKS} SELECT task_id, status FROM tasks ORDER BY created_at DESC, task_id DESC LIMIT 100")
def recent_tasks(t: Tables) -> DataFrame:
    return gov.recent(tasks(t), "created_at", "task_id", 100).select("task_id", "status")


@query("expired_anti", """
SELECT o_orderkey AS asset_id FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def expired_anti(t: Tables) -> DataFrame:
    """Old orders without a returned line."""
    return gov.expired_assets(order_assets(t), returned(t), F.lit("1998-01-01").cast("timestamp")).select("asset_id")


def order_assets(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("asset_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def returned(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("asset_id"))


@query("cleanup_summary", f"""WITH {TASKS}, {ARTIFACTS}
SELECT (SELECT count(*) FROM arts WHERE task_id IN (SELECT task_id FROM tasks WHERE status IN ('succeeded', 'failed', 'cancelled') AND updated_us < epoch_us(TIMESTAMP '{NOW}' - INTERVAL 30 DAY))) AS removed_artifacts,
 (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 8000 DAY AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')) AS removed_assets,
 (SELECT count(*) FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '{NOW}' - INTERVAL 500 HOUR) AS removed_temporary""")
def cleanup_summary(t: Tables) -> DataFrame:
    temporary = t.events.filter("event_type = 'click'").select(F.col("ts").cast("timestamp").alias("modified_at"))
    return gov.cleanup_summary(tasks(t), artifacts(t), order_assets(t), returned(t), temporary, F.lit(NOW).cast("timestamp"),
                               "30 DAYS", "8000 DAYS", "500 HOURS")


@query("structure_diff", """
WITH c AS (SELECT page_id, (length(html) - length(replace(html, '<a ', ''))) // 3 AS links, (length(html) - length(replace(html, '<!--', ''))) // 4 AS notes,
  (length(html) - length(replace(html, '<p>', ''))) // 3 AS paras, 0 AS fields FROM pages),
s AS (SELECT page_id, 'links' AS probe, CASE WHEN page_id % 6 = 0 THEN NULL ELSE links END AS a, greatest(0, links - page_id % 3) AS b FROM c
 UNION ALL SELECT page_id, 'annotations', notes, CASE WHEN page_id % 2 = 0 THEN 0 ELSE notes END FROM c
 UNION ALL SELECT page_id, 'searchable_words', paras, paras + page_id % 2 FROM c UNION ALL SELECT page_id, 'form_fields', fields, page_id % 4 FROM c)
SELECT page_id, probe, CASE WHEN a IS NULL OR b IS NULL THEN 'unavailable' WHEN a = 0 AND b = 0 THEN 'absent' WHEN a = b THEN 'count_unchanged' WHEN a > 0 AND b = 0 THEN 'removed'
 WHEN b < a THEN 'count_reduced' WHEN a = 0 THEN 'created' ELSE 'count_increased' END AS status FROM s""")
def structure_diff(t: Tables) -> DataFrame:
    """Tag counts of raw pages against an edited version of them."""
    page = F.col("page_id")

    def count(tag: str):
        return F.floor((F.length("html") - F.length(F.replace("html", F.lit(tag), F.lit("")))) / len(tag))

    def probes(**values):
        return F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("bigint") for v in values.values()]))).alias("probe", "n")

    links, notes, paras = count("<a "), count("<!--"), count("<p>")
    source = t.pages.select("page_id", probes(links=F.when(page % 6 != 0, links), annotations=notes, searchable_words=paras, form_fields=F.lit(0)))
    output = t.pages.select("page_id", probes(links=F.greatest(links - page % 3, F.lit(0)), annotations=F.when(page % 2 == 0, 0).otherwise(notes),
                                              searchable_words=paras + page % 2, form_fields=page % 4))
    return gov.compare_structure(source, output, ["page_id"]).select("page_id", "probe", "status")


@query("page_text_status", """
WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 30 THEN 3 ELSE 0 END AS sw, l_tax > 0.02 AS en, l_discount < 0.08 AS av,
 CASE WHEN l_returnflag = 'A' THEN 'failed' ELSE 'completed' END AS att, CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END AS ow, l_linestatus = 'O' AS ins FROM lineitem),
q AS (SELECT *, sw > 0 AS own, en AND av AS tried, sw = 0 AND en AND av AND ow > 0 AS rd, (CASE WHEN ins THEN CASE WHEN sw > 0 THEN sw WHEN en AND av THEN ow ELSE 0 END ELSE 0 END) > 0 AS inserted FROM p)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT inserted THEN 'none' WHEN own THEN 'source_text' WHEN rd THEN 'ocr' ELSE 'none' END AS text_source,
 CASE WHEN rd AND NOT inserted THEN 'failed' WHEN own THEN 'not_needed' WHEN tried THEN att WHEN NOT en THEN 'disabled' ELSE 'unavailable' END AS ocr_status, inserted AS searchable,
 CASE WHEN (own OR rd) AND NOT inserted THEN 'text_layer_insert_failed' WHEN own OR rd THEN '' WHEN tried AND att = 'failed' THEN 'ocr_failed' WHEN tried THEN 'ocr_no_text'
  WHEN NOT en THEN 'ocr_disabled' ELSE 'ocr_unavailable' END AS reason FROM q""")
def page_text_status(t: Tables) -> DataFrame:
    source, words = F.when(F.col("l_quantity") > 30, 3).otherwise(0), F.when(F.col("l_returnflag") == "R", 5).otherwise(0)
    enabled, available = F.col("l_tax") > 0.02, F.col("l_discount") < 0.08
    placed = F.when(F.col("l_linestatus") == "O", F.when(source > 0, source).when(enabled & available, words).otherwise(0)).otherwise(0)
    pages = t.lineitem.select(
        "l_orderkey", "l_linenumber", source.alias("source_words"), enabled.alias("ocr_enabled"), available.alias("ocr_available"),
        F.when(F.col("l_returnflag") == "A", "failed").otherwise("completed").alias("ocr_attempt"), words.alias("ocr_words"), placed.alias("inserted_words"))
    return gov.page_text_status(pages).select("l_orderkey", "l_linenumber", "text_source", "ocr_status", "searchable",
                                              F.coalesce("unsearchable_reason", F.lit("")).alias("reason"))
