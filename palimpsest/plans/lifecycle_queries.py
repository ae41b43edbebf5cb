"""Queries over the event log as task history, on tables and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import lifecycle as life
from palimpsest.plans.governance_queries import NOW, TASKS, tasks, tasks_of
from palimpsest.plans.registry import Tables, query
from palimpsest.session import cut_lineage
from palimpsest.streaming import assets as stream_assets
from palimpsest.streaming import tables as stream_tables
from palimpsest.streaming import tasks as stream_tasks
from palimpsest.streaming import timed

KINDS = {"view": "queue", "click": "start", "purchase": "succeed", "error": "fail", "signup": "cancel"}
TASK = ["user_id", "day"]


def history(events: DataFrame) -> DataFrame:
    """A user's day is a task; the kind of event tells what happened to it."""
    names = F.create_map(*[F.lit(v) for pair in KINDS.items() for v in pair])
    at = F.col("ts").cast("timestamp")
    return events.select("event_id", "user_id", F.dayofyear("ts").cast("bigint").alias("day"), names[F.col("event_type")].alias("event"),
                         at.alias("at"), F.unix_micros(at).alias("micros"))


HISTORY = """
hist AS (SELECT event_id, user_id, dayofyear(ts) AS day, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, dayofyear(ts) ORDER BY ts,
 CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END) AS k,
 CASE event_type WHEN 'view' THEN 'queue' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'succeed' WHEN 'error' THEN 'fail' ELSE 'cancel' END AS event FROM events),
walk AS (SELECT user_id, day, CAST(0 AS BIGINT) AS k, 'queued' AS state, CAST(-1 AS BIGINT) AS reached, CAST(-1 AS BIGINT) AS asked FROM hist GROUP BY ALL
 UNION ALL SELECT w.user_id, w.day, h.k,
  CASE WHEN w.state IN ('succeeded', 'failed', 'cancelled') THEN w.state WHEN h.event = 'start' AND w.state = 'queued' THEN 'running'
   WHEN h.event = 'cancel' AND w.state = 'queued' THEN 'cancelled' WHEN h.event = 'cancel' THEN 'cancelling'
   WHEN h.event IN ('succeed', 'fail') AND w.state = 'cancelling' THEN 'cancelled' WHEN h.event = 'succeed' THEN 'succeeded' WHEN h.event = 'fail' THEN 'failed' ELSE w.state END,
  CASE WHEN w.state IN ('succeeded', 'failed', 'cancelled') THEN w.reached WHEN h.event = 'start' AND w.state = 'queued' THEN h.us
   WHEN h.event = 'cancel' AND w.state <> 'cancelling' THEN h.us WHEN h.event IN ('succeed', 'fail') THEN h.us ELSE w.reached END,
  CASE WHEN h.event = 'cancel' AND w.state = 'running' THEN h.us ELSE w.asked END
 FROM walk w JOIN hist h ON h.user_id = w.user_id AND h.day = w.day AND h.k = w.k + 1),
final AS (SELECT user_id, day, arg_max(state, k) AS state, arg_max(reached, k) AS reached, arg_max(asked, k) AS asked FROM walk GROUP BY user_id, day)
"""
STATE_SQL = f"WITH RECURSIVE {HISTORY} SELECT user_id, day, state, reached FROM final"


def shown_state(df: DataFrame) -> DataFrame:
    return df.select(*TASK, "state", F.coalesce("reached", F.lit(-1)).alias("reached"))


@query("task_state", STATE_SQL)
def task_state(t: Tables) -> DataFrame:
    return shown_state(life.task_state(history(t.events), TASK, F.col("micros")))


@query("task_state_stream", STATE_SQL)
def task_state_stream(t: Tables) -> DataFrame:
    """The same states from the event files read as a stream, whose state forgets tasks a day after their end."""
    events = history(stream_tables.read_folder(t.spark, t.folder, "events"))
    states = timed.state_stream(events, TASK, "at", late="1 hour", keep="1 day").where("reason is null")
    return shown_state(stream_tables.latest(states.select(*TASK, "state", "reached"), TASK, "task-state"))


@query("grace_expired", f"""WITH RECURSIVE {HISTORY}
SELECT user_id, day, asked + 3600000000 AS force_ended_at FROM final WHERE asked >= 0
 AND (CASE WHEN state = 'cancelled' THEN reached ELSE epoch_us(TIMESTAMP '{NOW}') END) - asked > 3600000000""")
def grace_expired(t: Tables) -> DataFrame:
    """Cancel requests that were not answered within an hour."""
    now = F.unix_micros(F.lit(NOW).cast("timestamp"))
    return life.grace_expired(history(t.events), TASK, F.col("micros"), now, 3_600_000_000)


@query("recover", """
WITH s AS (SELECT event_id AS task_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'cancelling' END AS status FROM events)
SELECT task_id, CASE status WHEN 'cancelling' THEN 'cancelled' WHEN 'running' THEN 'queued' ELSE status END AS status,
 CASE WHEN status IN ('queued', 'running') THEN 0.0::DOUBLE ELSE 1.0 END AS progress, status IN ('queued', 'running') AS resumable FROM s""")
def recover(t: Tables) -> DataFrame:
    stored = tasks(t).withColumn("status", F.when(F.col("status") == "cancelled", "cancelling").otherwise(F.col("status")))
    return life.recover(stored).select("task_id", "status", "progress", "resumable")


EXPIRED = f"""WITH {TASKS}
SELECT 'artifact' AS kind, task_id FROM tasks WHERE status = 'succeeded' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY
UNION ALL SELECT 'asset', task_id FROM tasks WHERE status = 'queued' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 20 DAY
UNION ALL SELECT 'temporary', task_id FROM tasks WHERE status = 'failed' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 400 HOUR"""
AGES = (("artifact", "succeeded", "30 days"), ("asset", "queued", "20 days"), ("temporary", "failed", "400 hours"))


@query("expire", EXPIRED)
def expire(t: Tables) -> DataFrame:
    """Three kinds of rows with their own age."""
    now, at = F.lit(NOW).cast("timestamp"), F.col("created_at")
    parts = [life.expire(tasks(t).filter(F.col("status") == status), at, now, age).select(F.lit(kind).alias("kind"), "task_id")
             for kind, status, age in AGES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("expire_stream", EXPIRED)
def expire_stream(t: Tables) -> DataFrame:
    """The same rows from the event files read as a stream; a clock that says the present moves the watermark."""
    stored = tasks_of(stream_tables.read_folder(t.spark, t.folder, "events"))
    kind = F.coalesce(*[F.when(F.col("status") == status, kind) for kind, status, _ in AGES])
    rows = stored.select(kind.alias("kind"), "task_id", "created_at").where("kind is not null")
    clock = t.spark.range(1).select(F.lit("clock").alias("kind"), F.col("id").alias("task_id"), F.lit(NOW).cast("timestamp").alias("created_at"))
    ticks = t.spark.readStream.schema(clock.schema).parquet(cut_lineage(clock).inputFiles()[0].rsplit("/", 1)[0])
    gone = timed.expire_stream(rows.unionByName(ticks), "kind", "task_id", "created_at", {kind: age for kind, _, age in AGES})
    return stream_tables.appended(gone.where("reason is null").select("kind", "task_id"), "expire")


@query("dedupe_assets", "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1")
def dedupe_assets(t: Tables) -> DataFrame:
    """The first document of each content digest."""
    return life.first_copies(t.documents.select("doc_id", F.sha2("text", 256).alias("sha256")), "sha256", ["doc_id"])


@query("dedupe_assets_stream", "SELECT DISTINCT sha256(event_type || ':' || user_id) AS sha256 FROM events")
def dedupe_assets_stream(t: Tables) -> DataFrame:
    """Events read as a stream of uploads at their own times; kind and user are the content, which many events share."""
    events = stream_tables.read_folder(t.spark, t.folder, "events")
    content = F.concat(F.col("event_type"), F.lit(":"), F.col("user_id").cast("string"))
    rows = events.select(F.sha2(content, 256).alias("sha256"), F.col("ts").cast("timestamp").alias("modificationTime"))
    return stream_tables.appended(stream_assets.dedupe_assets(rows), "dedupe").select("sha256")


RATES = """
SELECT {0} AS window_start, count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS n_succeeded, count(*) FILTER (event_type = 'error') AS n_failed FROM {1} GROUP BY 1"""


@query("outcome_window", RATES.format("w", "(SELECT *, unnest([epoch(ts)::BIGINT // 3600 * 3600, epoch(ts)::BIGINT // 3600 * 3600 - 3600]) AS w FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events))"))
def outcome_window(t: Tables) -> DataFrame:
    """Two-hour windows that start every hour."""
    return life.outcome_rates(history(t.events), "at", "2 hours", "1 hour")


@query("outcome_window_stream", RATES.format("epoch(date_trunc('hour', ts))::BIGINT", "events") + " HAVING epoch(date_trunc('hour', min(ts)))::BIGINT + 3600 <= (SELECT epoch(max(ts)) - 3600 FROM events)")
def outcome_window_stream(t: Tables) -> DataFrame:
    """Hourly windows of the event stream that the watermark has closed."""
    events = history(stream_tables.read_folder(t.spark, t.folder, "events"))
    return stream_tables.appended(stream_tasks.outcomes_stream(events, "at", "1 hour"), "outcomes")


@query("outcome_late_stream", """
WITH e AS (SELECT event_id % 3 AS turn, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 AS h, event_type FROM events),
m AS (SELECT turn, max(us) AS newest FROM e GROUP BY turn),
w AS (SELECT a.turn, max(b.newest) // 1000 - 3600000 AS mark FROM m a LEFT JOIN m b ON b.turn < a.turn GROUP BY a.turn),
r AS (SELECT e.*, coalesce((h + 1) * 3600000 <= mark, false) AS late FROM e JOIN w USING (turn))
SELECT h * 3600 AS window_start, count(*) FILTER (NOT late) AS n_events, count(*) FILTER (NOT late AND event_type = 'purchase') AS n_succeeded,
 count(*) FILTER (NOT late AND event_type = 'error') AS n_failed, count(*) FILTER (late) AS n_late
FROM r GROUP BY h HAVING (h + 1) * 3600000 <= (SELECT max(us) // 1000 FROM e) - 3600000""")
def outcome_late_stream(t: Tables) -> DataFrame:
    """Hourly windows of events that arrive in three turns over the whole time, with the events that came after their window was told."""
    events = history(t.events)
    arrivals = [events.where(F.col("event_id") % 3 == k) for k in range(3)]
    return timed.outcome_totals(stream_tables.in_turns(arrivals, lambda rows: timed.outcomes_with_late(rows, "at", "1 hour"), "outcomes-late"))


@query("session_window", """
WITH g AS (SELECT user_id, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 10800000000, true) AS opens FROM events),
s AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g)
SELECT user_id, min(us) AS session_start, max(us) + 10800000000 AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k""")
def session_window(t: Tables) -> DataFrame:
    """Sessions that end after three silent hours."""
    return life.sessions(history(t.events), ["user_id"], F.col("micros"), 10_800_000_000)
