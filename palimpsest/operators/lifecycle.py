"""Task lifecycle, retention and outcome rates. All forms work on tables; those built
from plain aggregations work unchanged on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.masks import merge_intervals

FINISHES = ("succeed", "fail", "cancelled")
# Default retention and grace times.
ARTIFACT_AGE, ASSET_AGE, TEMPORARY_AGE, CANCEL_GRACE = "30 days", "7 days", "24 hours", "2 seconds"


def task_marks(events: DataFrame, task: list[str], order: Column) -> DataFrame:
    """The first start, cancel request and finish of each task.

    Final states absorb whatever follows, so these decide the state; each is a minimum
    that combines before the shuffle, whatever the number of events per task. With a
    whole number as order they are kept in a hash table without sorting.
    """
    def first(kind: str, name: str) -> Column:
        return F.min(F.when(F.col("event") == kind, order)).alias(name)

    marks = events.groupBy(*task).agg(first("start", "started"), first("cancel", "asked"),
                                      *[first(kind, f"_{kind}") for kind in FINISHES])
    at = F.least(*[F.col(f"_{kind}") for kind in FINISHES])
    kind = F.coalesce(*[F.when(F.col(f"_{kind}") == F.col("finished"), kind) for kind in FINISHES])
    return marks.withColumn("finished", at).withColumn("finish", kind).drop(*[f"_{kind}" for kind in FINISHES])


def state_columns(started: Column, asked: Column, at: Column, kind: Column) -> tuple[Column, Column]:
    """State and the order value at which it was reached, from the first start, cancel request and finish and the kind of that.

    Events of one moment count in the order start, cancel, finish.
    """
    finish_first = at.isNotNull() & (asked.isNull() | (at < asked))
    at_once = asked.isNotNull() & ~F.coalesce(started <= asked, F.lit(False))
    state = (F.when(finish_first & (kind == "succeed"), "succeeded").when(finish_first & (kind == "fail"), "failed")
             .when(finish_first | at_once | (asked.isNotNull() & at.isNotNull()), "cancelled").when(asked.isNotNull(), "cancelling")
             .when(started.isNotNull(), "running").otherwise("queued"))
    reached = (F.when(finish_first, at).when(at_once, asked).when(asked.isNotNull(), F.coalesce(at, asked)).otherwise(started))
    return state, reached


def task_state(events: DataFrame, task: list[str], order: Column) -> DataFrame:
    """Current state per task. A queued task is cancelled at once, a running one first becomes
    cancelling, and whatever ends it then, it ends cancelled."""
    state, reached = state_columns(*[F.col(c) for c in ("started", "asked", "finished", "finish")])
    return task_marks(events, task, order).select(*task, state.alias("state"), reached.alias("reached"))


def grace_expired(events: DataFrame, task: list[str], micros: Column, now: Column, grace: int) -> DataFrame:
    """Running tasks whose cancel request was not answered within `grace` microseconds."""
    started, asked, at = F.col("started"), F.col("asked"), F.col("finished")
    cancelling = asked.isNotNull() & (started <= asked) & (at.isNull() | (at >= asked))
    waited = F.coalesce(at, now) - asked
    return task_marks(events, task, micros).filter(cancelling & (waited > grace)).select(
        *task, (asked + grace).alias("force_ended_at"))


def recover(tasks: DataFrame) -> DataFrame:
    """State of open tasks after a restart: cancelling ends, queued and running start over."""
    status = F.col("status")
    open_task = status.isin("queued", "running")
    return tasks.withColumns({
        "status": F.when(status == "cancelling", "cancelled").when(open_task, "queued").otherwise(status),
        "progress": F.when(status == "cancelling", 1.0).when(open_task, 0.0).otherwise(F.col("progress")),
        "resumable": open_task})


def expire(df: DataFrame, at: Column, now: Column, age: str) -> DataFrame:
    """Rows older than an age such as '30 days'."""
    return df.filter(at < now - F.expr(f"INTERVAL {age}"))


def first_copies(assets: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """The earliest row per digest and the number of copies, combined before the shuffle."""
    copies = F.count(F.lit(1)).alias("n_copies")
    if len(order) == 1:
        return assets.groupBy(digest).agg(F.min(order[0]).alias(order[0]), copies)
    return assets.groupBy(digest).agg(F.min(F.struct(*order)).alias("_f"), copies).select(digest, "_f.*", "n_copies")


def outcome_rates(events: DataFrame, at: str, length: str, slide: str | None = None) -> DataFrame:
    """Task outcomes per time window; on a stream set a watermark first."""
    kind = F.col("event")
    return (events.groupBy(F.window(at, length, slide) if slide else F.window(at, length)).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(kind == "succeed").alias("n_succeeded"), F.count_if(kind == "fail").alias("n_failed"))
        .select(F.unix_seconds("window.start").alias("window_start"), "n_events", "n_succeeded", "n_failed"))


def sessions(events: DataFrame, user: list[str], micros: Column, gap: int) -> DataFrame:
    """Sessions per user that end after `gap` microseconds of silence, for users of any size.

    An event covers its time and the gap after it; a session is a run of covered time.
    """
    spans = events.select(*user, micros.alias("start"), (micros + gap - 1).alias("end"), F.lit(1).cast("bigint").alias("n_events"))
    merged = merge_intervals(spans, user, chunk_width=3.6e9, sums=("n_events",))
    return merged.select(*user, F.col("start").alias("session_start"), (F.col("end") + 1).alias("session_end"), "n_events")
