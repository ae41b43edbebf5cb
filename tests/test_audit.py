import pytest
from pyspark.sql import functions as F

from palimpsest.operators import audit, trials as tr
from palimpsest.operators.identity import reject_split, require_unique, strict
from tests.conftest import rows

RESULT = "sample_id int, pair_id int, kind string, true_positive int, false_positive int, false_negative int, expected_count int"


def test_empty_denominators(spark):
    df = spark.createDataFrame([("none", 0, 0, 0), ("zero", 0, 2, 3)], "s string, true_positive int, false_positive int, false_negative int")
    got = {r.s: (r.precision, r.recall, r.f1) for r in audit.prf(df, ["s"]).collect()}
    assert got == {"none": (1.0, 1.0, 1.0), "zero": (0.0, 0.0, 0.0)}


def test_published_totals_are_reproduced(spark):
    """Counts behind the published rates 0.487 / 0.792 / 0.603 and 0.750 / 0.750 / 0.750."""
    df = spark.createDataFrame([("all", 19, 20, 5), ("gated", 18, 6, 6)], "s string, true_positive int, false_positive int, false_negative int")
    got = {r.s: (round(r.precision, 3), round(r.recall, 3), round(r.f1, 3)) for r in audit.prf(df, ["s"]).collect()}
    assert got == {"all": (0.487, 0.792, 0.603), "gated": (0.75, 0.75, 0.75)}


def test_pairs(spark):
    data = [(1, 1, "positive", 1, 0, 0, 1), (2, 1, "negative", 0, 0, 0, 0), (3, 2, "positive", 1, 0, 0, 1), (4, 2, "negative", 0, 1, 0, 0),
            (5, 3, "positive", 1, 0, 0, 1), (6, 4, "positive", 0, 0, 1, 1), (7, 4, "negative", 0, 0, 0, 0), (8, None, "negative", 0, 0, 0, 0)]
    got = audit.pair_diagnostics(spark.createDataFrame(data, RESULT), "pair_id").select("pair_id", "pair_passed", "status")
    assert rows(got) == [(1, True, "OK"), (2, False, "OK"), (3, False, "INCOMPLETE_PAIR"), (4, False, "OK")]


def test_pair_audit_order_of_rules(spark):
    n, p = "clean_negative", "watermark_positive"
    data = [(1, n, 5, "a"), (1, p, 5, "b"), (2, n, 5, "a"), (2, p, 6, "b"), (3, n, 5, "a"), (3, p, 5, "a"), (4, n, 5, "a"), (4, n, 5, "b"),
            (5, n, 5, "a"), (6, n, None, "a"), (6, p, None, "b"), (7, n, None, "a"), (7, p, 1, "b"), (8, "x", 1, "b")]
    df = spark.createDataFrame(data, "pair int, role string, width int, sha string")
    assert dict(rows(audit.pair_audit(df, "pair", "role", ["width"], ["sha"]))) == {
        1: "OK", 2: "METADATA_MISMATCH:width", 3: "IMAGES_NOT_DISTINCT", 4: "DUPLICATE_ROLE", 5: "INCOMPLETE_PAIR", 6: "OK",
        7: "METADATA_MISMATCH:width", 8: "INVALID_ROLE"}


def test_align_and_strict(spark):
    a = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id int")
    b = spark.createDataFrame([(1,), (4,), (3,), (5,), (5,)], "id int")
    got = audit.align(a, b, ["id"])
    assert {r.id: r.status for r in got.collect()} == {
        1: "OK", 2: "MISSING_PREDICTION", 3: "DUPLICATE_SAMPLE", 4: "UNKNOWN_SAMPLE", 5: "DUPLICATE_PREDICTION"}
    ok, bad = reject_split(got)
    assert ok.count() == 1 and bad.count() == 4
    with pytest.raises(Exception, match="MISSING_PREDICTION|DUPLICATE|UNKNOWN"):
        strict(got).collect()
    with pytest.raises(Exception, match="DUPLICATE_KEY"):
        require_unique(a, ["id"]).collect()


def test_gates(spark):
    summary = spark.createDataFrame([(0.75, 0.84, 24)], ["precision", "recall", "sample_count"])
    g = audit.gates(summary, {"precision": 0.75, "recall": 0.85, "sample_count": 20})
    assert {r.gate: r.passed for r in g.collect()} == {"precision": True, "recall": False, "sample_count": True}
    assert audit.claim_allowed(g, True).first()[0] is False
    fine = audit.gates(summary, {"precision": 0.7})
    assert audit.claim_allowed(fine, True).first()[0] is True and audit.claim_allowed(fine, False).first()[0] is False


def test_fields_provenance_and_expectations(spark):
    df = spark.createDataFrame([(" ", "true", "2", "1.5"), ("a", "yes", "2.5", "nan"), (None, None, None, None), ("a", "false", "7", "0")], ["t", "b", "i", "n"])
    got = audit.missing_fields(df, {"t": "text", "b": "bool", "i": "positive_int", "n": "number"})
    assert [list(r.errors) for r in got.collect()] == [["t:text"], ["b:bool", "i:positive_int", "n:number"], ["t:text", "b:bool", "i:positive_int", "n:number"], []]
    ok = dict(source_sha256="a" * 64, license="l", attribution="x", contains_user_data=False, source_record="https://h/x", usage_terms_url="https://h/t")
    cases = [({}, "OK"), ({"source_sha256": "A" * 64}, "BAD_DIGEST"), ({"license": " "}, "MISSING_LICENSE"), ({"contains_user_data": None}, "USER_DATA"),
             ({"source_record": "http://h/x"}, "SOURCE_NOT_PUBLIC_HTTPS"), ({"usage_terms_url": "https://u@h/"}, "TERMS_NOT_PUBLIC_HTTPS")]
    schema = "source_sha256 string, license string, attribution string, contains_user_data boolean, source_record string, usage_terms_url string"
    table = spark.createDataFrame([tuple({**ok, **change}.values()) for change, _ in cases], schema)
    assert [r.status for r in audit.provenance_status(table).collect()] == [wanted for _, wanted in cases]
    e, a = spark.createDataFrame([(1, 2, None)], "k int, x int, y string"), spark.createDataFrame([(1, 3, None)], "k int, x int, y string")
    assert list(audit.expect_diff(e, a, ["k"], ["x", "y"]).first().mismatches) == ["x: expected 2, got 3"]


def test_reconcile_and_corpus_status(spark):
    e = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], "path string, size_bytes int, sha256 string")
    a = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 1, "y"), ("z", 1, "x")], "path string, size_bytes int, sha256 string")
    assert dict(rows(audit.reconcile(e, a, "path"))) == {"a": "OK", "b": "SIZE_MISMATCH", "c": "DIGEST_MISMATCH", "d": "MISSING", "z": "UNEXPECTED"}
    table = lambda data: spark.createDataFrame(data, "mismatches array<string>, provenance string")
    gen = "repository_generated"
    assert [audit.corpus_status(table(d)).first().status for d in ([([], gen)], [([], gen), ([], "real")], [(["m"], "real")])] == ["generated_only", "pass", "review"]


TRIAL = "participant string, sample_id int, workflow string, total_seconds double, correction_seconds double, status string, failure_reason string"


def test_trial_rules(spark):
    cases = [("completed", 5.0, 1.0, None, "OK"), ("failed", 5.0, 1.0, None, "REASON_REQUIRED"), ("failed", 5.0, 1.0, "bored", "REASON_UNSUPPORTED"),
             ("failed", 5.0, 5.0, " other ", "OK"), ("completed", 5.0, 1.0, "other", "REASON_NOT_ALLOWED"), ("completed", 5.0, 5.1, None, "TIMING_INCONSISTENT"),
             ("completed", 0.0, 0.0, None, "TIMING_INCONSISTENT"), (None, 1.0, 0.0, None, "STATUS_INVALID")]
    df = spark.createDataFrame([("p", 1, "box", t, c, s, r) for s, t, c, r, _ in cases], TRIAL)
    assert [r.v for r in df.select(tr.trial_status().alias("v")).collect()] == [c[-1] for c in cases]


def test_workflow_summary_and_pairs(spark):
    data = [("p", s, w, 10.0 * s + i, 1.0, "completed", None) for s in (1, 2) for i, w in enumerate(tr.WORKFLOWS)] + [("p", 3, "box", 1.0, 1.0, "failed", "other")]
    df = spark.createDataFrame(data, TRIAL)
    got = {r.workflow: (r.trial_count, r.failure_rate, r.total_median_seconds) for r in tr.workflow_summary(df).collect()}
    assert got == {"manual": (2, 0.0, 15.0), "box": (3, 0.333333, 16.0), "refined": (2, 0.0, 17.0)}
    assert rows(tr.paired_samples(df)) == [(1,), (2,)]
    ratios = tr.median_ratios(tr.workflow_summary(df)).first()
    assert (ratios.refined_to_manual, ratios.refined_to_box) == (1.133333, 1.0625)
    assert rows(tr.progress(df, "participant")) == [("p", 7, 7, True)]


def test_timing_report(spark):
    good = [(p, s, w, t, 1.0, "completed", None) for p in range(3) for s in range(8) for w, t in (("manual", 20.0), ("box", 16.0), ("refined", 14.0))]
    schema = "participant_id int, sample_id int, workflow string, total_seconds double, correction_seconds double, status string, failure_reason string"
    got = {r.gate: (r.value, r.passed) for r in tr.timing_report(spark.createDataFrame(good, schema)).collect()}
    assert got == {"participants": (3.0, True), "paired_samples": (8.0, True), "failure_rate": (0.0, True), "to_manual": (0.7, True), "to_box": (0.875, True)}
    bad = [r for r in good if r[2] != "box" and r[0] < 2] + [(9, 1, "manual", 5.0, 1.0, "failed", "other")] * 9
    got = {r.gate: r.passed for r in tr.timing_report(spark.createDataFrame(bad, schema)).collect()}
    assert got == {"participants": True, "paired_samples": False, "failure_rate": False, "to_manual": True, "to_box": False}


def test_localization_report(spark):
    rows_ = [(f"s{i % 4}", i % 7, "positive" if i % 2 else "negative", i % 2, 0, 0, 0.8 * (i % 2)) for i in range(20)]
    schema = "scene string, pair int, kind string, true_positive int, false_positive int, false_negative int, iou_sum double"
    got = audit.localization_report(spark.createDataFrame(rows_, schema), "scene", "pair", True).first()
    assert (got.sample_count, got.negative_count, got.scene_count, got.pair_count, got.mean_matched_iou) == (20, 10, 4, 7, 0.8)
    assert got.metric_gate and got.evidence_gate and got.release_claim_allowed
    none = audit.localization_report(spark.createDataFrame([], schema), "scene", "pair", True).first()
    assert none.mean_matched_iou == 0.0 and not none.evidence_gate and not none.release_claim_allowed


def test_assignments_are_balanced(spark):
    pairs = spark.createDataFrame([(p, s) for p in range(4) for s in range(30)], "p int, s int")
    got = tr.assignments(pairs, "p", "s", "seed")
    assert got.count() == 4 * 30 * 3
    assert got.groupBy("p", "block", "workflow").count().select(F.min("count"), F.max("count")).first() == (10, 10)
    assert got.groupBy("p", "s").agg(F.countDistinct("workflow").alias("n")).filter("n <> 3").count() == 0
