from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palimpsest.operators import lifecycle as life
from palimpsest.streaming import assets as stream_assets
from palimpsest.streaming import retention, tables, tasks, timed
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
EVENTS = "task bigint, at timestamp, event string"


def write_batches(spark, folder, schema, *batches):
    """One file per batch, oldest first, so that a stream of one file per trigger sees them in turn."""
    import os
    for i, data in enumerate(batches):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
        for name in os.listdir(f"{folder}/b{i}"):
            os.utime(f"{folder}/b{i}/{name}", (1_000_000 + i * 100, 1_000_000 + i * 100))


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def followed(stream, mode):
    """Rows of every batch of an update- or append-mode stream, and the size of its state after each batch."""
    import tempfile

    seen, folder = [], tempfile.mkdtemp(prefix="spark-test-", dir="/tmp")
    with tables.state_store(stream.sparkSession):
        query = (stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect()))
                 .option("checkpointLocation", folder).trigger(availableNow=True).start())
    query.awaitTermination()
    return seen, [(p["batchId"], p["stateOperators"][0]["numRowsTotal"]) for p in query.recentProgress if p["stateOperators"]], query


def test_states_over_several_batches_equal_the_table(spark, tmp_path):
    batches = [[(1, at(0), "queue"), (2, at(1), "start")], [(1, at(5), "start"), (2, at(6), "succeed")],
               [(1, at(4), "cancel"), (2, at(9), "fail"), (3, at(1), "queue"), (None, at(2), "start")], [(None, at(1), "cancel")]]
    folder = str(tmp_path)
    write_batches(spark, folder, EVENTS, *batches)
    stream = timed.state_stream(source(spark, folder, EVENTS), ["task"], "at").where("reason is null").select("task", "state", "reached")
    got = tables.latest(stream, ["task"], "t")
    table = life.task_state(spark.read.schema(EVENTS).parquet(f"{folder}/*"), ["task"], F.unix_micros("at"))
    assert rows(got) == rows(table)
    assert dict(rows(table.select("task", "state"))) == {1: "cancelled", 2: "succeeded", 3: "queued", None: "cancelled"}


def test_final_tasks_leave_the_state(spark, tmp_path):
    batches = [[(1, at(0), "queue"), (2, at(1), "start"), (5, None, "start")], [(2, at(6), "succeed"), (3, at(4000), "queue")],
               [(3, at(9000), "start"), (4, at(10), "fail")], [(2, at(9), "fail"), (1, at(4), "start"), (3, at(9100), "succeed")],
               [(9, at(40000), "queue")], [(3, at(9150), "fail")], [(3, at(9200), "fail"), (9, at(40001), "cancel")]]
    folder = str(tmp_path)
    write_batches(spark, folder, EVENTS, *batches)
    seen, sizes, _ = followed(timed.state_stream(source(spark, folder, EVENTS), ["task"], "at", late="10 minutes", keep="30 minutes"), "update")
    told = {r[1]: r[2] for r in seen if r[-1] is None}
    assert told == {1: "running", 2: "succeeded", 3: "succeeded", 9: "cancelled"}

    def us(s):
        return int((at(s) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000

    # timers go off after a batch's rows, so the row at 9150 still finds its task and the one at 9200 does not
    assert sorted((r[1], *r[4:]) for r in seen if r[-1]) == [
        (2, "fail", us(9), "LATE"), (3, "fail", us(9200), "LATE"), (4, "fail", us(10), "LATE"), (5, "start", None, "NO_TIME")]
    # a task in the state is its marks and, once final, its timer; at the end 1 is open and 9 is final but not yet forgotten
    last, most = sizes[-1][1], max(n for _, n in sizes)
    _, open_only, _ = followed(timed.state_stream(source(spark, f"{folder}/b0", EVENTS).where("task = 1"), ["task"], "at"), "update")
    assert last < most and open_only[-1][1] == 1


def test_retention_follows_the_watermark(spark, tmp_path):
    schema = "kind string, task bigint, at timestamp"
    day = 86_400
    batches = [[("a", 1, at(0)), ("a", 2, at(0)), ("b", 1, at(0)), (None, 4, at(0)), ("b", 5, None)], [("a", 2, at(5 * day)), ("clock", 0, at(7 * day))],
               [("clock", 0, at(7 * day) + timedelta(milliseconds=1)), ("b", 7, at(1))], [("clock", 0, at(8 * day))], [("clock", 0, at(12 * day) + timedelta(seconds=1)), ("a", 1, at(12 * day))]]
    folder = str(tmp_path)
    write_batches(spark, folder, schema, *batches)
    stream = timed.expire_stream(source(spark, folder, schema), "kind", "task", "at", {"a": "7 days", "b": "1 day"})
    assert stream.columns == ["kind", "task", "at", "reason"]
    seen, sizes, _ = followed(stream, "append")
    assert {(k, t, r) for _, k, t, _, r in seen if r and k != "clock"} == {(None, 4, "NO_AGE"), ("b", 5, "NO_TIME")}
    assert sorted((k, t) for _, k, t, _, r in seen if not r) == [("a", 1), ("a", 2), ("b", 1), ("b", 7)]
    # exactly seven days old is not older: a 1 goes with the batch after the clock of a millisecond later
    first = {(k, t): n for n, k, t, _, r in seen if not r}
    assert first["b", 1] < first["a", 1] and first["a", 1] == 3 and first["a", 2] > first["a", 1]
    assert sizes[-1][1] == 1 < max(n for _, n in sizes)  # only the new a 1 is left


def test_kept_and_late_rows_are_all_rows(spark, tmp_path):
    batches = [[(1, at(0), "succeed"), (1, at(60), "fail"), (7, None, "fail")], [(1, at(7200), "queue")], [(1, at(30), "fail"), (1, at(7300), "queue"), (2, at(3700), "succeed")],
               [(1, at(10), "succeed"), (1, at(14400), "queue")], [(1, at(40000), "queue")], [(1, at(14500), "fail"), (1, at(40100), "queue")]]
    folder = str(tmp_path)
    write_batches(spark, folder, EVENTS, *batches)
    start = int((T0 - datetime(1970, 1, 1)).total_seconds())
    for length, slide in (("1 hour", None), ("2 hours", "1 hour")):
        seen, _, query = followed(timed.outcomes_with_late(source(spark, folder, EVENTS), "at", length, slide, late="10 minutes"), "append")
        per = 2 if slide else 1
        late = [(r[1] - start, r[5]) for r in seen if r[-1] == "LATE"]
        told = sum(r[2] for r in seen if r[-1] is None)
        assert told + len(late) + (2 if per == 1 else 4) == 11 * per  # the two newest rows stand in windows that are open
        observed = [p["observedMetrics"]["outcomes"] for p in query.recentProgress if p.get("observedMetrics")]
        assert sum(int(o["n_late"]) for o in observed) == len(late) and sum(int(o["n_told"]) for o in observed) == told
        if per == 1:
            assert sorted(late) == [(0, "fail"), (0, "succeed"), (14400, "fail")]
            frame = spark.createDataFrame([r[1:] for r in seen], "window_start long, n_events long, n_succeeded long, n_failed long, event string, at long, reason string")
            assert [(r[0] - start, *r[1:]) for r in rows(timed.outcome_totals(frame))] == [(0, 2, 1, 1, 2), (3600, 1, 1, 0, 0), (7200, 2, 0, 0, 0), (14400, 1, 0, 0, 1)]


def test_grace_timer(spark, tmp_path):
    batches = [[(1, at(0), "start"), (2, at(0), "start"), (3, at(0), "start")], [(1, at(10), "cancel"), (2, at(10), "cancel"), (3, at(10), "cancel"), (3, at(10), "succeed")],
               [(2, at(11), "succeed"), (9, at(300), "queue")], [(9, at(900), "queue")], [(9, at(1800), "queue")]]
    folder = str(tmp_path)
    write_batches(spark, folder, EVENTS, *batches)
    got = tables.appended(tasks.grace_stream(source(spark, folder, EVENTS), "at", "task", 2000), "grace")
    assert rows(got) == [(1, int((at(12) - datetime(1970, 1, 1)).total_seconds() * 1000))]


def test_late_rows_are_dropped_and_sessions_close(spark, tmp_path):
    batches = [[(1, at(0), "succeed"), (1, at(60), "fail")], [(1, at(7200), "queue")], [(1, at(7300), "queue")], [(1, at(10), "succeed"), (1, at(14400), "queue")], [(1, at(40000), "queue")]]
    folder = str(tmp_path)
    write_batches(spark, folder, EVENTS, *batches)
    got = tables.appended(tasks.outcomes_stream(source(spark, folder, EVENTS), "at", "1 hour", late="10 minutes"), "o")
    start = int((T0 - datetime(1970, 1, 1)).total_seconds())
    assert rows(got.select(F.col("window_start") - start, "n_events", "n_succeeded"))[:2] == [(0, 2, 1), (7200, 2, 0)]
    sessions = tables.appended(tasks.sessions_stream(source(spark, folder, EVENTS), "at", "task", "5 minutes", "10 minutes"), "s")
    assert [r.n_events for r in sessions.orderBy("session_start").collect()] == [2, 2, 1]


def test_new_files_without_copies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"a.pdf": b"%PDF-1", "b.pdf": b"%PDF-1", "c.png": b"\x89PNG\r\n\x1a\n"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    stream = stream_assets.dedupe_assets(stream_assets.stream_assets(spark, str(tmp_path / "in")))
    assert rows(tables.appended(stream.select("kind", "size_bytes"), "a")) == [("pdf", 6), ("png", 8)]


def test_progress_and_recovery(spark, tmp_path):
    schema = "participant_id int, status string"
    write_batches(spark, str(tmp_path / "p"), schema, [(1, "completed"), (1, None)], [(1, "failed"), (2, "completed")])
    got = tables.latest(tasks.progress_stream(source(spark, str(tmp_path / "p"), schema), "participant_id"), ["participant_id"], "p")
    assert rows(got) == [(1, 2, 3, False), (2, 1, 1, True)]
    stored = "task_id int, status string, progress double"
    write_batches(spark, str(tmp_path / "t"), stored, [(1, "running", 0.5)], [(2, "cancelling", 0.5)])
    retention.recover_stream(source(spark, str(tmp_path / "t"), stored), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert rows(out.select("task_id", "status", "progress")) == [(1, "queued", 0.0), (2, "cancelled", 1.0)]


def test_many_tasks_share_the_state_of_a_shard(spark, tmp_path):
    batches = [[(i, at(i), ("start", "queue")[i % 2]) for i in range(300)], [(i, at(400 + i), ("succeed", "cancel", "fail")[i % 3]) for i in range(0, 300, 2)],
               [(i, at(4000 + i), "start") for i in range(1, 300, 7)], [(999, at(9000), "queue")], [(999, at(9001), "start")], [(0, at(1), "fail"), (1, at(1), "cancel")]]
    folder = str(tmp_path)
    write_batches(spark, folder, EVENTS, *batches)
    seen, sizes, _ = followed(timed.state_stream(source(spark, folder, EVENTS), ["task"], "at", late="10 minutes", keep="30 minutes", shards=4), "update")
    assert max(n for _, n in sizes) <= 8  # a shard is one value and one timer, where 301 tasks were one value each
    table = life.task_state(spark.read.schema(EVENTS).parquet(*[f"{folder}/b{i}" for i in range(5)]), ["task"], F.unix_micros("at"))
    told = {r[1]: r[2:4] for r in seen if r[-1] is None and r[0] < 5}
    assert told == {r["task"]: (r["state"], r["reached"]) for r in table.collect()}
    # 0 is over and forgotten, 1 is open and takes what comes late
    assert [(r[1], r[2], r[4], r[6]) for r in seen if r[0] >= 5] in ([(0, None, "fail", "LATE"), (1, "cancelled", None, None)], [(1, "cancelled", None, None), (0, None, "fail", "LATE")])

    kept = "kind string, task bigint, at timestamp"
    write_batches(spark, f"{folder}/k", kept, [("ab"[i % 2], i, at(i)) for i in range(200)], [("a", 0, at(86_400 - 9)), ("c", 0, at(86_400 + 100))], [("c", 1, at(86_400 + 100))])
    stream = timed.expire_stream(source(spark, f"{folder}/k", kept), "kind", "task", "at", {"a": "1 day", "b": "2 days"}, shards=4)
    seen, sizes, _ = followed(stream, "append")
    assert sorted(r[2] for r in seen if r[-1] is None) == list(range(2, 100, 2)) and max(n for _, n in sizes) <= 8
