"""Streams whose state ends: task states, retention and outcome windows with timers of event time.

Each runs as one stateful operator over rows without Spark's own filter for late rows, so that the operator sees them and
tells them apart: what comes behind the watermark for something that is no longer kept leaves as a reject. State is removed by timers
that the watermark sets off. The operators need the state store that `streaming.tables` chooses.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from palimpsest.operators.lifecycle import FINISHES, state_columns

NEVER = (1 << 63) - 1  # a time that has not come
NO_TIME = -(1 << 63)  # a row without a time
SALTS = 32  # keys over which the rows of a window are spread
SHARDS = 2048  # keys over which tasks or stored rows are spread


def micros(interval: str) -> int:
    """The length of an interval such as '2 hours'."""
    import pandas as pd

    return pd.Timedelta(interval).value // 1000


def _key(names: list[str]) -> Column:
    """One key that is never null; the Python side of the operator knows neither null keys nor names of all kinds."""
    return F.to_json(F.struct(*names)).alias("key")


def _unkeyed(rows: DataFrame, names: list[str]) -> list[Column]:
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return [F.from_json("key", types)[c].alias(c) for c in names]


def _shard(shards: int) -> Column:
    """The state key of a row: its own key would be one trip between the JVM and Python per row of state, a shard is one for many."""
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


def _wake(handle, due: int | None) -> None:
    """One timer per shard, for what is due first."""
    timers = list(handle.listTimers())
    for timer in timers:
        if timer != due:
            handle.deleteTimer(timer)
    if due is not None and due not in timers:
        handle.registerTimer(due)


def task_processor(keep: int) -> StatefulProcessor:
    """Five minima per task of a shard; a final task is forgotten when the watermark is `keep` microseconds past its end."""
    import numpy as np
    import pandas as pd

    kinds = ["start", "cancel", *FINISHES]

    def ends(marks: pd.DataFrame) -> pd.Series:
        asked, finished = marks["cancel"], marks[list(FINISHES)].min(axis=1)
        return finished.where(~((asked < marks["start"]) & (asked <= finished)), asked)

    class Tasks(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.marks = handle.getValueState("marks", "key array<string>, " + ", ".join(f"{k} array<bigint>" for k in kinds))

        def load(self) -> pd.DataFrame:
            key, *columns = self.marks.get() if self.marks.exists() else [[] for _ in range(len(kinds) + 1)]
            return pd.DataFrame({k: np.array(c, "int64") for k, c in zip(kinds, columns, strict=True)}, index=pd.Index(key, dtype=object))

        def store(self, marks: pd.DataFrame) -> None:
            if len(marks):
                self.marks.update((marks.index.tolist(), *[marks[k].tolist() for k in kinds]))
            elif self.marks.exists():
                self.marks.clear()
            end = ends(marks)
            end = end[end < NEVER]
            _wake(self.handle, (int(end.min()) + keep) // 1000 + 1 if len(end) else None)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            behind = timerValues.getCurrentWatermarkInMs() * 1000
            marks = self.load()
            parts, touched = [marks], []
            for frame in rows:
                known, lost = frame["key"].isin(marks.index), frame["at_us"] == NO_TIME
                late = ~lost & ~known & (frame["at_us"] < behind)
                for which, reason in ((lost, "NO_TIME"), (late, "LATE")):
                    if which.any():
                        part = frame[which]
                        at = part["at_us"].astype("Int64").where(~lost[which])
                        yield self.out(part["key"], part["kind"], at, reason, None)
                own = frame[~(lost | late)]
                touched += [own["key"], frame.loc[known, "key"]]
                first = own["at_us"].groupby([own["key"], own["kind"].fillna("")]).min()
                if len(first):
                    parts.append(first.unstack(fill_value=NEVER).reindex(columns=kinds, fill_value=NEVER))
            told = pd.concat(touched).unique()
            if not len(told):
                return
            marks = pd.concat(parts).groupby(level=0).min()
            over = ends(marks) < behind - keep
            self.store(marks[~over])
            yield self.out(told, None, None, None, marks.loc[told])

        def out(self, key, event, at, reason, marks) -> pd.DataFrame:
            frame = pd.DataFrame({"key": list(key)})
            frame["event"] = None if event is None else list(event)
            frame["at"] = pd.array([None] * len(frame) if at is None else list(at), "Int64")
            frame["reason"] = reason
            for kind in kinds:
                known = None if marks is None else marks[kind].astype("Int64")
                frame[f"_{kind}"] = pd.array([None] * len(frame), "Int64") if known is None else known.where(known < NEVER).array
            return frame

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            marks = self.load()
            end = ends(marks)
            last = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
            self.store(marks[(end == NEVER) | (end >= last * 1000 - keep)])
            yield from ()

        def close(self) -> None:
            pass

    return Tasks()


def state_stream(events: DataFrame, task: list[str], at: str, late: str = "1 hour", keep: str = "1 day",
                 shards: int = SHARDS) -> DataFrame:
    """Update-mode stream of (task, state, reached, event, at, reason), times in microseconds.

    A row without a reason is the state of its task so far, the same as `task_state` has. A final task leaves the state when the watermark
    (`late` behind the newest event) is `keep` past its end. An event behind the watermark counts while its task is kept; otherwise it is a
    reject LATE, with its kind and time, whether its task is forgotten or was never seen. An event ahead of the watermark of a task
    that is not kept opens it. Events without a time are rejects NO_TIME. Null task keys are a task like others. Open tasks stay.
    A batch reads and writes the states of whole shards, tasks spread by a hash; choose more of them for more than some ten million tasks.
    """
    order = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(NO_TIME))
    rows = events.withWatermark(at, late).select(_key(task), order.alias("at_us"), F.col("event").alias("kind"))
    rows = rows.withColumn("shard", _shard(shards))
    marks = ", ".join(f"_{k} bigint" for k in ("start", "cancel", *FINISHES))
    out = rows.groupBy("shard").transformWithStateInPandas(
        task_processor(micros(keep)), f"key string, event string, at bigint, reason string, {marks}", "Update", "EventTime")
    finished = F.least(*[F.col(f"_{k}") for k in FINISHES])
    finish = F.coalesce(*[F.when(F.col(f"_{k}") == finished, k) for k in FINISHES])
    state, reached = state_columns(F.col("_start"), F.col("_cancel"), finished, finish)
    held = F.col("reason").isNull()
    return out.select(*_unkeyed(events, task), F.when(held, state).alias("state"), F.when(held, reached).alias("reached"), "event", "at", "reason")


def retention_processor(ages: dict[str, int]) -> StatefulProcessor:
    """The newest time per (kind, key) of a shard and the first millisecond in which it is older than its age; a timer lets it go."""
    import numpy as np
    import pandas as pd

    class Retention(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getValueState("held", "key array<string>, at array<bigint>, due array<bigint>")

        def load(self) -> pd.DataFrame:
            key, at, due = self.held.get() if self.held.exists() else ([], [], [])
            return pd.DataFrame({"at": np.array(at, "int64"), "due": np.array(due, "int64")}, index=pd.Index(key, dtype=object))

        def keep(self, held: pd.DataFrame) -> None:
            if len(held):
                self.held.update((held.index.tolist(), held["at"].tolist(), held["due"].tolist()))
            elif self.held.exists():
                self.held.clear()
            _wake(self.handle, int(held["due"].min()) if len(held) else None)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            seen = []
            for frame in rows:
                aged = frame["kind"].isin(list(ages))
                lost = frame[aged & (frame["at_us"] == NO_TIME)]
                if len(lost):
                    yield self.out(lost["key"], None, "NO_TIME")
                seen.append(frame.groupby("key").agg(at=("at_us", "max"), kind=("kind", "first")))
            rows = pd.concat(seen).groupby(level=0).agg(at=("at", "max"), kind=("kind", "first"))
            aged = rows["kind"].isin(list(ages))
            if not aged.all():
                yield self.out(rows.index[~aged], None, "NO_AGE")
            rows = rows[aged & (rows["at"] != NO_TIME)]
            rows = pd.DataFrame({"at": rows["at"], "due": (rows["at"] + np.array([ages[k] for k in rows["kind"]], "int64")) // 1000 + 1})
            held = pd.concat([self.load(), rows]).groupby(level=0).max()
            gone = held["due"] <= timerValues.getCurrentWatermarkInMs()
            gone &= held.index.isin(rows.index)  # what had no row in this batch leaves by its timer
            self.keep(held[~gone])
            if gone.any():
                yield self.out(held.index[gone], held.loc[gone, "at"], None)

        def out(self, key, at, reason) -> pd.DataFrame:
            return pd.DataFrame({"key": list(key), "at": pd.array([None] * len(key) if at is None else at.tolist(), "Int64"), "reason": reason})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            held = self.load()
            gone = held["due"] <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
            self.keep(held[~gone])
            yield self.out(held.index[gone], held.loc[gone, "at"], None)

        def close(self) -> None:
            pass

    return Retention()


def expire_stream(rows: DataFrame, kind: str, key: str, at: str, ages: dict[str, str], late: str = "0 seconds",
                  shards: int = SHARDS) -> DataFrame:
    """Append-mode stream of (kind, key, at, reason): what has become older than the age of its kind, when the watermark tells it.

    Only the newest time of a row counts, so a row that is written again stays on. A row that is too old on arrival leaves at once. A kind without
    an age is a reject NO_AGE, rows without a time are rejects NO_TIME. Nothing stays in the state after it has left. Keys share the state of their shard, as in `state_stream`.
    """
    order = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(NO_TIME))
    named = rows.withColumn("kind", F.col(kind))
    timed = named.withWatermark(at, late).select(_key(["kind", key]), F.col("kind").cast("string").alias("kind"), order.alias("at_us"))
    out = timed.withColumn("shard", _shard(shards)).groupBy("shard").transformWithStateInPandas(
        retention_processor({k: micros(v) for k, v in ages.items()}), "key string, at bigint, reason string", "Append", "EventTime")
    named_kind, named_key = _unkeyed(named, ["kind", key])
    return out.select(named_kind.alias(kind), named_key, "at", "reason")


def window_processor(length: int) -> StatefulProcessor:
    """Counts of one window and salt, told when the watermark passes the window's end; later rows leave one by one."""
    import pandas as pd

    class Windows(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.counts = handle.getValueState("counts", "n_events bigint, n_succeeded bigint, n_failed bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            end = (key[0] + length) // 1000
            n = list(self.counts.get()) if self.counts.exists() else [0, 0, 0]
            for frame in rows:
                if end <= timerValues.getCurrentWatermarkInMs():
                    yield self.out(key, frame["event"], frame["at_us"], [[1, int(e == "succeed"), int(e == "fail")] for e in frame["event"]], "LATE")
                else:
                    n = [n[0] + len(frame), n[1] + int((frame["event"] == "succeed").sum()), n[2] + int((frame["event"] == "fail").sum())]
            if n[0] and end > timerValues.getCurrentWatermarkInMs():
                if not self.counts.exists():
                    self.handle.registerTimer(end)
                self.counts.update(tuple(n))

        def out(self, key, event, at, counts, reason) -> pd.DataFrame:
            n = pd.DataFrame(counts, columns=["n_events", "n_succeeded", "n_failed"], dtype="int64")
            n.insert(0, "window_start", key[0] // 1_000_000)
            return n.assign(event=list(event), at=pd.array(list(at), "Int64"), reason=reason)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            n = self.counts.get()
            self.counts.clear()
            yield self.out(key, [None], [None], [n], None)

        def close(self) -> None:
            pass

    return Windows()


def starts(at: Column, length: int, slide: int) -> Column:
    """The starts of all windows that hold a time, all in microseconds."""
    newest = at - F.pmod(at, F.lit(slide))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(-(-length // slide) - 1)), lambda i: newest - i * slide), lambda s: s + length > at)


def outcomes_with_late(events: DataFrame, at: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Append-mode stream of (window_start, n_events, n_succeeded, n_failed, event, at, reason): outcome counts, and the rows that came too late.

    A row without a reason is a part of a window's counts (one of at most SALTS, so that no window is one key); parts come out when the watermark has
    passed the window's end, and `outcome_totals` adds them up. A row with reason LATE is an event for a window that was told already. Every
    event is in one of both, or in a window that is still open, once for every window it belongs to. Events without a time are left out.
    The counts of both are observed as `outcomes` in the progress of the query.
    """
    width, step = micros(length), micros(slide or length)
    rows = events.withWatermark(at, late).select(F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), "event")
    rows = rows.where("at_us is not null").select("at_us", "event", F.explode(starts(F.col("at_us"), width, step)).alias("start_us"))
    salt = F.pmod(F.xxhash64("at_us", "event"), F.lit(SALTS)).cast("int")
    out = rows.withColumn("salt", salt).groupBy("start_us", "salt").transformWithStateInPandas(
        window_processor(width), "window_start bigint, n_events bigint, n_succeeded bigint, n_failed bigint, event string, at bigint, reason string",
        "Append", "EventTime")
    told = F.when(F.col("reason").isNull(), F.col("n_events"))
    return out.observe("outcomes", F.coalesce(F.sum(told), F.lit(0)).alias("n_told"), F.count("reason").alias("n_late"))


def outcome_totals(rows: DataFrame) -> DataFrame:
    """(window_start, n_events, n_succeeded, n_failed, n_late) from what `outcomes_with_late` wrote; windows with late rows only have no events."""
    own = F.col("reason").isNull()
    sums = [F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).alias(c) for c in ("n_events", "n_succeeded", "n_failed")]
    return rows.groupBy("window_start").agg(*sums, F.count("reason").alias("n_late"))
