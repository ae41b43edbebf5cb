from pyspark.sql import functions as F

from palimpsest.functions import ids, text
from palimpsest.operators import fragments as frag
from tests.conftest import rows


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_norm_collapses_and_folds(spark):
    assert one(spark, text.norm(F.col("t")), t="  Über\t GROSS Straße\n") == "über gross strasse"
    assert one(spark, text.clean(F.col("t"), 5), t=" a  b c d") == "a b c"
    assert one(spark, text.clean(F.col("t"), 5), t=" \n ") is None


def test_safe_name(spark):
    cases = {"a/b/c.txt": "c.txt", " .x\x01\x02y. ": "x_y", "...": "upload.bin", "n" * 300: "n" * 255}
    for given, wanted in cases.items():
        assert one(spark, text.safe_name(F.col("t")), t=given) == wanted


def test_lexicon_and_target(spark):
    names = spark.createDataFrame([("My  WaterMark",), ("body",), ("机密 layer",), ("Logo Acme",)], ["name"])
    got = rows(frag.layer_candidates(names, "name", target="acme"))
    assert dict(got) == {"My  WaterMark": "ambiguous", "body": "content", "机密 layer": "ambiguous", "Logo Acme": "ambiguous"}


def test_digest_is_plain_sha_of_joined_parts(spark):
    import hashlib
    wanted = hashlib.sha256(b"a|3|None").hexdigest()[:20]
    assert one(spark, ids.digest(20, F.lit("a"), F.lit(3), F.lit(None))) == wanted


def docs(spark, table):
    return spark.createDataFrame([(a, p, t) for (a, p), t in table.items()], "asset string, page int, text string")


def repeated(spark, table, **options):
    pages = docs(spark, table)
    lines = frag.fragments(pages, "text", ["asset", "page"])
    out = frag.repeated_text(lines, pages, "asset", "page", **options)
    return rows(out.select("asset", "page", "occurrence", "norm_text", "n_pages"))


def test_repeated_text_needs_two_pages_and_half(spark):
    table = {("a", 1): "Draft\nx1", ("a", 2): "  DRAFT \n\nx2", ("a", 3): "x3", ("a", 4): "x4",
             ("b", 1): "once", ("b", 2): "other", ("c", 1): "t\nt"}
    assert repeated(spark, table) == [("a", 1, 0, "draft", 2), ("a", 2, 0, "draft", 2)]
    assert repeated(spark, {**table, ("a", 5): "x5"}) == []  # 2 of 5 pages
    assert repeated(spark, table, target="X3") == [
        ("a", 1, 0, "draft", 2), ("a", 2, 0, "draft", 2), ("a", 3, 0, "x3", 0)]
    across = {("a", 1): "same", ("b", 1): "same", ("b", 2): "q"}
    assert repeated(spark, across) == []
    assert [r[:2] for r in repeated(spark, across, scope="corpus")] == [("a", 1), ("b", 1)]


def test_fragment_limits(spark):
    table = {("a", 1): "\n" + "x" * 200 + "\n" + "y" * 201 + "\nend"}
    lines = frag.fragments(docs(spark, table), "text", ["page"])
    assert [(r.occurrence, r.line_no, len(r.content)) for r in lines.orderBy("occurrence").collect()] == [(0, 1, 200), (1, 3, 3)]


def test_objects_annotations_and_status(spark):
    uses = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y")], ["asset", "page", "ref"])
    got = frag.repeated_objects(uses, "asset", "page", "ref")
    assert {(r.ref, r.classification) for r in got.collect()} == {("x", "ambiguous"), ("y", "content")}
    notes = spark.createDataFrame([("/Watermark",), ("/Stamp",), ("/Link",)], ["subtype"])
    assert rows(frag.annotation_candidates(notes)) == [("/Stamp", "ambiguous"), ("/Watermark", "confirmed")]
    assets = spark.createDataFrame([("a",), ("b",), ("c",)], ["asset"])
    cands = spark.createDataFrame([("a", "ambiguous"), ("a", "confirmed"), ("b", "ambiguous")], ["asset", "classification"])
    assert rows(frag.match_status(assets, cands, "asset")) == [("a", "matched"), ("b", "needs_review"), ("c", "not_found")]


def test_size_guard_finds_the_first_page_over(spark):
    pages = spark.createDataFrame([("a", i * 40_000, 10) for i in range(10)] + [("b", 0, 5)], ["asset", "page", "size"])
    got = rows(frag.size_guard(pages, "asset", "page", F.col("size"), 55))
    assert got == [("a", 100, 200_000, "RESOURCE_LIMIT"), ("b", 5, -1, "OK")]


def test_unchanged_reports_every_difference(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], ["k", "v"])
    after = spark.createDataFrame([(1, "a"), (2, "x"), (4, "y"), (6, "n")], ["k", "v"])
    selected = spark.createDataFrame([(4,), (5,)], ["k"])
    assert rows(frag.unchanged(before, after, selected, ["k"], "v")) == [
        (1, "UNCHANGED"), (2, "CHANGED"), (3, "MISSING"), (4, "EDITED_AS_SELECTED"), (5, "REMOVED_AS_SELECTED"), (6, "UNEXPECTED")]
