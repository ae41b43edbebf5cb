"""Queries over timed trials, read from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ids import pseudonym
from palimpsest.operators import audit, trials as tr
from palimpsest.plans.registry import Tables, query
from palimpsest.sources.store import decode_record, decode_variant


def trial_rows(t: Tables) -> DataFrame:
    """User = participant, hour = sample, event number = workflow, value = seconds; errors are failures."""
    k, failed = F.col("k"), F.col("event_type") == "error"
    rows = decode_record(t.events, "props", "k bigint", "_p").withColumn("k", F.col("_p.k"))
    names = F.array(*[F.lit(w) for w in tr.WORKFLOWS])
    reasons = F.array(F.lit("mask_not_usable"), F.lit("editor_problem"), F.lit(""), F.lit("bored"), F.lit("time_limit"))
    return rows.select(
        "event_id", F.col("user_id").alias("participant_id"), F.hour("ts").cast("bigint").alias("sample_id"),
        F.element_at(names, (F.col("event_id") % 3 + 1).cast("int")).alias("workflow"), F.col("value").alias("total_seconds"),
        F.when(k > 95, F.col("value") + 1).otherwise(F.col("value") * k / 128).alias("correction_seconds"),
        F.when(failed, "failed").when(F.col("event_type") == "signup", "open").otherwise("completed").alias("status"),
        F.when(failed, F.element_at(reasons, (k % 5 + 1).cast("int"))).when(k < 3, "other").alias("failure_reason"))


TRIALS = """
trials AS (SELECT event_id, user_id AS participant_id, hour(ts) AS sample_id, ['manual', 'box', 'refined'][event_id % 3 + 1] AS workflow, value AS total_seconds,
 CASE WHEN k > 95 THEN value + 1 ELSE value * k / 128 END AS correction_seconds,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'open' ELSE 'completed' END AS status,
 CASE WHEN event_type = 'error' THEN ['mask_not_usable', 'editor_problem', '', 'bored', 'time_limit'][k % 5 + 1] WHEN k < 3 THEN 'other' END AS failure_reason
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
"""
STATUS = """
CASE WHEN status NOT IN ('completed', 'failed') THEN 'STATUS_INVALID' WHEN total_seconds <= 0 OR correction_seconds < 0 OR correction_seconds > total_seconds THEN 'TIMING_INCONSISTENT'
 WHEN status = 'failed' AND trim(coalesce(failure_reason, '')) = '' THEN 'REASON_REQUIRED'
 WHEN status = 'failed' AND failure_reason NOT IN ('mask_not_usable', 'editor_problem', 'time_limit', 'other') THEN 'REASON_UNSUPPORTED'
 WHEN status = 'completed' AND coalesce(failure_reason, '') <> '' THEN 'REASON_NOT_ALLOWED' ELSE 'OK' END
"""


@query("props_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_decode(t: Tables) -> DataFrame:
    return decode_record(t.events, "props", "k bigint", "p").select("event_id", F.col("p.k").alias("k"))


@query("props_variant", """
WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"k": "' || user_id || '", "extra": {"tags": ["a", "' || event_type || '"]}}'
  WHEN 2 THEN '{"extra": {"tags": []}, "k": 2.5}' WHEN 3 THEN '{"k": ' WHEN 4 THEN '{"k": {"deep": ' || user_id || '}}' END AS text FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(json_extract_string(text, '$.k') AS BIGINT) WHEN 1 THEN CAST(json_extract_string(text, '$.k') AS BIGINT) WHEN 2 THEN 2 END AS k,
 CASE event_id % 6 WHEN 1 THEN json_extract_string(text, '$.extra.tags[1]') END AS tag, CASE event_id % 6 WHEN 4 THEN CAST(json_extract_string(text, '$.k.deep') AS BIGINT) END AS deep,
 CASE WHEN text IS NULL THEN 'EMPTY' WHEN NOT json_valid(text) THEN 'MALFORMED' ELSE 'OK' END AS record_status FROM r""")
def props_variant(t: Tables) -> DataFrame:
    """Records of several versions: a number, a text, a fraction, cut off, nested, and none."""
    user = F.col("user_id").cast("string")
    texts = F.array(F.col("props"), F.concat(F.lit('{"k": "'), user, F.lit('", "extra": {"tags": ["a", "'), F.col("event_type"), F.lit('"]}}')),
                    F.lit('{"extra": {"tags": []}, "k": 2.5}'), F.lit('{"k": '), F.concat(F.lit('{"k": {"deep": '), user, F.lit("}}")), F.lit(None).cast("string"))
    rows = t.events.select("event_id", F.get(texts, (F.col("event_id") % 6).cast("int")).alias("text"))
    return decode_variant(rows, "text", {"k": ("$.k", "bigint"), "tag": ("$.extra.tags[1]", "string"), "deep": ("$.k.deep", "bigint")}).drop("text")


@query("trial_status", f"WITH {TRIALS} SELECT event_id, {STATUS} AS status FROM trials")
def trial_status(t: Tables) -> DataFrame:
    return trial_rows(t).select("event_id", tr.trial_status().alias("status"))


def valid(t: Tables) -> DataFrame:
    return trial_rows(t).filter(tr.trial_status() == "OK")


@query("trial_join", """
WITH s AS (SELECT user_id, hour(ts) AS task, count(*) AS n_corpus FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type NOT IN ('click', 'error')) GROUP BY ALL),
r AS (SELECT user_id, hour(ts) AS task, count(*) AS n_predictions FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL),
j AS (SELECT user_id, task, coalesce(n_corpus, 0) AS n_corpus, coalesce(n_predictions, 0) AS n_predictions FROM s FULL JOIN r USING (user_id, task))
SELECT *, CASE WHEN n_corpus > 1 THEN 'DUPLICATE_SAMPLE' WHEN n_predictions > 1 THEN 'DUPLICATE_PREDICTION'
 WHEN n_predictions = 0 THEN 'MISSING_PREDICTION' WHEN n_corpus = 0 THEN 'UNKNOWN_SAMPLE' ELSE 'OK' END AS status FROM j""")
def trial_join(t: Tables) -> DataFrame:
    """Clicks and errors are results of the session tasks that all other events stand for (one per user and hour)."""
    rows = t.events.select("user_id", F.hour("ts").cast("bigint").alias("task"), "ts", F.col("event_type").isin("click", "error").alias("result"))
    tasks, results = rows.filter(~F.col("result")).drop("result").distinct(), rows.filter("result")
    return audit.align(tasks, results, ["user_id", "task"])


TIMING = f"""
v AS (SELECT * FROM trials WHERE {STATUS} = 'OK'),
w AS (SELECT workflow, count(*) FILTER (status <> 'completed') / count(*) AS failure_rate, median(total_seconds) FILTER (status = 'completed') AS med FROM v GROUP BY workflow),
f AS (SELECT count(DISTINCT participant_id) AS participants,
 (SELECT count(*) FROM (SELECT sample_id FROM v WHERE status = 'completed' GROUP BY ALL HAVING count(DISTINCT workflow) = 3)) AS paired_samples,
 (SELECT round(max(round(failure_rate, 6)), 6) FROM w) AS failure_rate,
 (SELECT round(round(max(med) FILTER (workflow = 'refined'), 6) / round(max(med) FILTER (workflow = 'manual'), 6), 6) FROM w) AS to_manual,
 (SELECT round(round(max(med) FILTER (workflow = 'refined'), 6) / round(max(med) FILTER (workflow = 'box'), 6), 6) FROM w) AS to_box FROM v)
"""


@query("timing_gates", f"""
WITH {TRIALS}, {TIMING}
SELECT 'participants' AS gate, participants::DOUBLE AS value, 3.0::DOUBLE AS threshold, participants >= 3 AS passed FROM f
UNION ALL SELECT 'paired_samples', paired_samples::DOUBLE, 8.0, paired_samples >= 8 FROM f
UNION ALL SELECT 'failure_rate', failure_rate, 0.1, failure_rate <= 0.1 FROM f
UNION ALL SELECT 'to_manual', to_manual, 0.75, coalesce(to_manual <= 0.75, false) FROM f
UNION ALL SELECT 'to_box', to_box, 0.9, coalesce(to_box <= 0.9, false) FROM f""")
def timing_gates(t: Tables) -> DataFrame:
    """The gates of the timing audit, with a sample for every hour of the day."""
    return tr.timing_report(valid(t))


@query("workflow_median", f"""
WITH {TRIALS}, v AS (SELECT * FROM trials WHERE {STATUS} = 'OK')
SELECT workflow, count(*) AS trial_count, count(*) FILTER (status = 'completed') AS completed_count, count(*) FILTER (status <> 'completed') AS failure_count,
 round(count(*) FILTER (status <> 'completed') / count(*), 6) AS failure_rate, round(median(total_seconds) FILTER (status = 'completed'), 6) AS total_median_seconds,
 round(median(correction_seconds) FILTER (status = 'completed'), 6) AS correction_median_seconds FROM v GROUP BY workflow""")
def workflow_median(t: Tables) -> DataFrame:
    return tr.workflow_summary(valid(t))


@query("paired_count", f"""
WITH {TRIALS}, v AS (SELECT * FROM trials WHERE {STATUS} = 'OK' AND status = 'completed')
SELECT participant_id, count(*) AS paired_count FROM (SELECT participant_id, sample_id FROM v GROUP BY ALL HAVING count(DISTINCT workflow) = 3) GROUP BY participant_id""")
def paired_count(t: Tables) -> DataFrame:
    """Hours of a user that were completed in all three workflows."""
    rows = valid(t).withColumn("sample", F.struct("participant_id", "sample_id"))
    return (tr.paired_samples(rows, "sample").groupBy(F.col("sample.participant_id").alias("participant_id"))
            .agg(F.count(F.lit(1)).alias("paired_count")))


@query("timing_means", f"""
WITH {TRIALS} SELECT workflow, count(*) AS count, round(avg(total_seconds), 6) AS total_seconds_mean, round(avg(correction_seconds), 6) AS correction_seconds_mean
FROM trials GROUP BY workflow""")
def timing_means(t: Tables) -> DataFrame:
    return tr.timing_means(trial_rows(t), ["workflow"], ["total_seconds", "correction_seconds"])


@query("runtime_summary", """
WITH r AS (SELECT event_type, value - 1 AS duration_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS peak_memory_mb FROM events),
g AS (SELECT *, duration_ms > 0 AND peak_memory_mb >= 0 AS good FROM r)
SELECT event_type, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS rejected, round(avg(duration_ms) FILTER (good), 6) AS duration_mean,
 max(peak_memory_mb) FILTER (good) AS peak_memory_max, round(median(duration_ms) FILTER (good), 6) AS duration_median FROM g GROUP BY event_type""")
def runtime_summary(t: Tables) -> DataFrame:
    rows = decode_record(t.events, "props", "k bigint", "p").select(
        "event_type", (F.col("value") - 1).alias("duration_ms"), F.col("p.k").alias("peak_memory_mb"))
    return tr.runtime_summary(rows, ["event_type"])


@query("counterbalance", """
WITH p AS (SELECT DISTINCT substr(sha256('trial-1:' || user_id), 1, 16) AS user_id, hour(ts) AS sample FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sha256('s1:' || user_id || ':' || sample)) - 1 AS idx,
 CAST('0x' || substr(user_id, 1, 8) AS BIGINT) AS shift FROM p),
b AS (SELECT *, unnest([0, 1, 2]) AS block FROM i),
w AS (SELECT *, ['manual', 'box', 'refined'][(idx + block + shift) % 3 + 1] AS workflow FROM b)
SELECT user_id, sample, CAST(block AS BIGINT) AS block, workflow, substr(sha256(user_id || ':s1:' || sample || ':' || workflow), 1, 20) AS task_id FROM w""")
def counterbalance(t: Tables) -> DataFrame:
    """Every user does the hours seen in the log once per workflow, in a balanced order."""
    code = pseudonym(F.col("user_id").cast("string"), "trial-1")
    pairs = t.events.select(code.alias("user_id"), F.hour("ts").cast("bigint").alias("sample"))
    return tr.assignments(pairs, "user_id", "sample", "s1")


@query("progress", f"""
WITH {TRIALS} SELECT participant_id, count(*) FILTER (status IN ('completed', 'failed')) AS completed, count(*) AS total,
 bool_and(status IN ('completed', 'failed')) AS finished FROM trials GROUP BY participant_id""")
def progress(t: Tables) -> DataFrame:
    return tr.progress(trial_rows(t), "participant_id")
