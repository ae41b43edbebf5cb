from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palimpsest.functions.measures import structure_status
from palimpsest.operators import governance as gov
from palimpsest.operators import lifecycle as life
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def test_operations(spark):
    cands = spark.createDataFrame([("a", "ambiguous", ["object"]), ("b", "content", ["object"]), ("c", "confirmed", [])],
                                  "candidate_id string, classification string, allowed_strategies array<string>")
    ops = spark.createDataFrame([(1, "a", "object"), (1, "b", "object"), (1, "c", "object"), (1, "x", "object"), (2, "a", "region"), (3, "a", "object"), (3, "a", "object")],
                                "plan int, candidate_id string, strategy string")
    got = gov.operation_status(ops, cands, ["plan"]).select("plan", "candidate_id", "status")
    assert rows(got) == [(1, "a", "OK"), (1, "b", "CONTENT_SELECTED"), (1, "c", "STRATEGY_NOT_ALLOWED"), (1, "x", "UNKNOWN_CANDIDATE"),
                         (2, "a", "STRATEGY_NOT_ALLOWED"), (3, "a", "DUPLICATE_CANDIDATE"), (3, "a", "DUPLICATE_CANDIDATE")]


def test_acknowledgements(spark):
    need = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "x")], "plan int, code string")
    got = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (3, "z")], "plan int, code string")
    out = gov.acknowledgement_status(gov.acknowledgements(need, got, "plan"), "plan").select("plan", "status")
    assert rows(out) == [(1, "ACKNOWLEDGEMENT_REQUIRED"), (2, "OK"), (3, "ACKNOWLEDGEMENT_INVALID")]


def test_freshness(spark):
    plans = spark.createDataFrame([(i, a, n, "d") for i, a, n in ((1, 1, 1), (2, 9, 1), (3, 2, 1), (4, 1, 9), (5, 1, 2), (6, 1, 3))],
                                  "plan_id int, asset_id int, analysis_id int, asset_sha256 string")
    analyses = spark.createDataFrame([(1, 1, "d"), (2, 1, "old"), (3, 2, "d")], "analysis_id int, asset_id int, asset_sha256 string")
    assets = spark.createDataFrame([(1, "d"), (2, "new")], "asset_id int, sha256 string")
    assert dict(rows(gov.freshness(plans, analyses, assets))) == {
        1: "OK", 2: "ASSET_NOT_FOUND", 3: "PLAN_STALE", 4: "ANALYSIS_NOT_FOUND", 5: "PLAN_STALE", 6: "PLAN_STALE"}


def test_structure_status(spark):
    cases = [(None, 1, "unavailable"), (1, None, "unavailable"), (0, 0, "absent"), (3, 3, "count_unchanged"), (3, 0, "removed"), (3, 1, "count_reduced"),
             (0, 2, "created"), (1, 2, "count_increased")]
    df = spark.createDataFrame(cases, "s int, o int, w string")
    assert all(r.v == r.w for r in df.select(structure_status(F.col("s"), F.col("o")).alias("v"), "w").collect())
    long = lambda data: spark.createDataFrame(data, "page int, probe string, n int")
    got = gov.compare_structure(long([(1, "links", 2), (1, "text", 1)]), long([(1, "links", 0), (2, "links", 1)]), ["page"]).select("page", "probe", "status")
    assert rows(got) == [(1, "links", "removed"), (1, "text", "unavailable"), (2, "links", "unavailable")]


def test_report_is_private_and_complete(spark):
    tasks = spark.createDataFrame([(1, 1, "failed", 1.0, T0, T0 + timedelta(seconds=3), '{"code":"X","message":"/home/me"}', "stage"),
                                   (2, 1, "running", 0.5, T0, T0, None, "stage")],
                                  "task_id int, plan_id int, status string, progress double, created_at timestamp, updated_at timestamp, error_json string, stage string")
    plans, assets = spark.createDataFrame([(1, 7, "k")], ["plan_id", "asset_id", "kind"]), spark.createDataFrame([(7, "secret.pdf", "m", 5, "d")], ["asset_id", "display_name", "media_type", "size_bytes", "sha256"])
    arts = spark.createDataFrame([(1, "output", 10), (1, "source_preview", 5)], ["task_id", "role", "size_bytes"])
    got = gov.public_report(gov.task_report(tasks, plans, assets, arts.withColumnRenamed("size_bytes", "size_bytes"), F.lit(T0 + timedelta(minutes=1))))
    assert "display_name" not in got.columns and "stage" not in got.columns
    found = {r.task_id: (r.duration_seconds, r.error_code, r.artifact_count, r.source_page_count) for r in got.collect()}
    assert found == {1: (3.0, "X", 2, 1), 2: (60.0, None, 0, 0)}


def test_reading_order_and_pages(spark):
    arts = spark.createDataFrame([(1, "result_preview", 1, "r1"), (1, "output", None, "o"), (1, "source_preview", 2, "s2"), (1, "source_preview", 1, "s1")],
                                 "task_id int, role string, page_number int, path string")
    assert [r.path for r in gov.reading_order(arts).orderBy("position").collect()] == ["o", "s1", "s2", "r1"]
    assert rows(gov.align_pages(arts)) == [(1, 1, "s1", "r1"), (1, 2, "s2", None)]
    far = spark.createDataFrame([(1, "source_preview", 1_500_000_000, "s"), (1, "result_preview", 1, "r"), (1, "source_preview", 1_023_999_999, "q")],
                                "task_id int, role string, page_number int, path string")
    assert [r.path for r in gov.reading_order(far).orderBy("position").collect()] == ["q", "s", "r"]


def test_page_text(spark):
    data = [(2, False, False, None, 0, 2), (0, False, False, None, 0, 0), (0, True, False, None, 0, 0), (0, True, True, "completed", 3, 3),
            (0, True, True, "completed", 0, 0), (0, True, True, "failed", 0, 0), (0, True, True, "completed", 3, 0), (2, False, False, None, 0, 0)]
    df = spark.createDataFrame(data, "source_words int, ocr_enabled boolean, ocr_available boolean, ocr_attempt string, ocr_words int, inserted_words int")
    got = [(r.text_source, r.ocr_status, r.unsearchable_reason) for r in gov.page_text_status(df).collect()]
    assert got == [("source_text", "not_needed", None), ("none", "disabled", "ocr_disabled"), ("none", "unavailable", "ocr_unavailable"),
                   ("ocr", "completed", None), ("none", "completed", "ocr_no_text"), ("none", "failed", "ocr_failed"),
                   ("none", "failed", "text_layer_insert_failed"), ("none", "not_needed", "text_layer_insert_failed")]


def states(spark, *events):
    data = [(1, i, e) for i, e in enumerate(events)]
    return life.task_state(spark.createDataFrame(data, "task int, at int, event string"), ["task"], F.col("at")).first()


def test_task_states(spark):
    cases = {("queue",): ("queued", None), ("queue", "start"): ("running", 1), ("queue", "cancel", "succeed"): ("cancelled", 1),
             ("queue", "start", "cancel"): ("cancelling", 2), ("queue", "start", "cancel", "succeed"): ("cancelled", 3),
             ("start", "succeed", "cancel", "fail"): ("succeeded", 1), ("start", "fail", "start"): ("failed", 1),
             ("start", "cancelled"): ("cancelled", 1), ("cancel", "start"): ("cancelled", 0)}
    for events, wanted in cases.items():
        got = states(spark, *events)
        assert (got.state, got.reached) == wanted, events


def test_recovery_retention_and_cleanup(spark):
    tasks = spark.createDataFrame([(1, "queued", 0.3), (2, "running", 0.3), (3, "cancelling", 0.3), (4, "failed", 1.0)], "task_id int, status string, progress double")
    assert rows(life.recover(tasks)) == [(1, "queued", 0.0, True), (2, "queued", 0.0, True), (3, "cancelled", 1.0, False), (4, "failed", 1.0, False)]
    old, new = T0 - timedelta(days=31), T0 - timedelta(days=1)
    done = spark.createDataFrame([(1, "succeeded", old), (2, "running", old), (3, "failed", new)], "task_id int, status string, updated_at timestamp")
    arts = spark.createDataFrame([(1,), (1,), (2,), (3,)], "task_id int")
    assets = spark.createDataFrame([(1, old), (2, old), (3, new)], "asset_id int, created_at timestamp")
    plans = spark.createDataFrame([(2,)], "asset_id int")
    temp = spark.createDataFrame([(old,), (T0,)], "modified_at timestamp")
    got = gov.cleanup_summary(done, arts, assets, plans, temp, F.lit(T0), life.ARTIFACT_AGE, life.ASSET_AGE, life.TEMPORARY_AGE).first()
    assert tuple(got) == (2, 1, 1)


def test_grace_and_sessions(spark):
    events = spark.createDataFrame([(1, 0, "start"), (1, 10, "cancel"), (1, 13, "succeed"), (2, 0, "start"), (2, 10, "cancel"), (2, 12, "succeed"),
                                    (3, 0, "cancel"), (4, 0, "start"), (4, 5, "cancel")], "task int, at int, event string")
    assert rows(life.grace_expired(events, ["task"], F.col("at"), F.lit(100), 2)) == [(1, 12), (4, 7)]
    clicks = spark.createDataFrame([("u", 0), ("u", 9), ("u", 19), ("u", 28), ("v", 5)], "user string, at bigint")
    assert rows(life.sessions(clicks, ["user"], F.col("at"), 10)) == [("u", 0, 19, 2), ("u", 19, 38, 2), ("v", 5, 15, 1)]
