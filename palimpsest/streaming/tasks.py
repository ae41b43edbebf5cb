"""Cancel grace, outcome rates and sessions on streams; what forgets its keys by timers is in `timed`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.lifecycle import outcome_rates
from palimpsest.operators.trials import progress

__all__ = ["grace_stream", "outcomes_stream", "progress_stream", "sessions_stream"]


def progress_stream(trials: DataFrame, participant: str) -> DataFrame:
    """Update-mode stream of collection progress."""
    return progress(trials, participant)


def outcomes_stream(events: DataFrame, at: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Append-mode outcome rates; rows later than the watermark are dropped."""
    return outcome_rates(events.withWatermark(at, late), at, length, slide)


def sessions_stream(events: DataFrame, at: str, user: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Append-mode sessions per user."""
    return (events.withWatermark(at, late).groupBy(F.session_window(at, gap), user).agg(F.count(F.lit(1)).alias("n_events"))
            .select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events"))


def grace_stream(events: DataFrame, at: str, task: str, grace_ms: int, late: str = "1 minute") -> DataFrame:
    """Running tasks whose cancel request is not answered in time, told when the watermark passes.

    Events have the task as a whole number, `event` and the time column. Rows of one
    batch are put in time order first; a task's state is two times.
    """
    def follow(key, batches, state: GroupState):
        import pandas as pd

        empty = pd.DataFrame({"task": pd.Series(dtype="int64"), "force_ended_ms": pd.Series(dtype="int64")})
        if state.hasTimedOut:
            _, asked, _ = state.get
            state.update((-1, -1, True))
            yield pd.DataFrame({"task": [key[0]], "force_ended_ms": [asked + grace_ms]}) if asked >= 0 else empty
            return
        started, asked, over = state.get if state.exists else (-1, -1, False)
        rows = pd.concat(list(batches)).sort_values("ms", kind="stable")
        expired = []
        for ms, event in zip(rows["ms"], rows["event"]):
            if asked >= 0 and not over and ms > asked + grace_ms:
                expired.append(asked + grace_ms)
                over = True
            if over:
                break
            if event == "start" and started < 0:
                started = int(ms)
            elif event == "cancel" and asked < 0:
                over = started < 0
                asked = int(ms) if started >= 0 else -1
            elif event in ("succeed", "fail", "cancelled"):
                over = True
        state.update((started, asked, over))
        if asked >= 0 and not over:
            state.setTimeoutTimestamp(max(asked + grace_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"task": [key[0]] * len(expired), "force_ended_ms": expired}).astype("int64")

    rows = events.withWatermark(at, late).select(
        F.col(task).cast("bigint").alias("task"), F.col(at), F.unix_millis(at).alias("ms"), "event")
    return rows.groupBy("task").applyInPandasWithState(
        follow, "task bigint, force_ended_ms bigint", "started bigint, asked bigint, over boolean", "append",
        GroupStateTimeout.EventTimeTimeout)
