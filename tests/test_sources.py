import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import assets, images, manifest, ocr, pages, parts, report, store
from tests.conftest import rows


def png(pixels):
    """A minimal RGB PNG file."""
    height, width = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_asset_scan_kinds_and_admission(spark, tmp_path):
    files = {"a.pdf": b"%PDF-1.7", "b.png": b"\x89PNG\r\n\x1a\nxx", "c.jpg": b"\xff\xd8\xff\xe0", "d.DOCX": b"PK\x03\x04zz", "e.zip": b"PK\x03\x04zz",
             "f.webp": b"RIFF1234WEBPxx", "g.riff": b"RIFF1234WAVExx", "i.bin": b"%PDF-" + b"x" * 100}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = assets.scan_assets(spark, str(tmp_path))
    kinds = {r["name"]: r.kind for r in found.collect()}
    assert kinds == {"a.pdf": "pdf", "b.png": "png", "c.jpg": "jpeg", "d.DOCX": "docx", "e.zip": None, "f.webp": "webp", "g.riff": None, "i.bin": "pdf"}
    ok, bad = assets.admit(found, 50)
    assert ok.count() == 5
    assert rows(bad.select("name", "code")) == [("e.zip", "UNSUPPORTED_FORMAT"), ("g.riff", "UNSUPPORTED_FORMAT"), ("i.bin", "RESOURCE_LIMIT")]
    assert assets.scan_assets(spark, str(tmp_path), "*.pdf").count() == 1
    empty = spark.createDataFrame([(0, None)], "size_bytes bigint, kind string")
    assert rows(assets.admit(empty)[1].select("code")) == [("INVALID_FILE",)]


def test_artifact_roles(spark):
    cases = [("a/1/result.pdf", "application/pdf", "output", None), ("a/1/source/page-12.png", "image/png", "source_preview", 12),
             ("a/1/result/page-x.png", "image/png", "result_preview", None), ("a/1/result/page.png", "image/png", "result_preview", None), ("a/other/page-1.png", "image/png", "output", None)]
    df = spark.createDataFrame([c[:2] for c in cases], ["p", "m"])
    role, page = assets.artifact_role(F.col("p"), F.col("m"))
    assert [tuple(r) for r in df.select(role, page).collect()] == [c[2:] for c in cases]


def test_image_limits(spark):
    cases = [("png", "jpeg", 1, 1, 1, "FORMAT_MISMATCH"), ("png", "png", 0, 1, 1, "INVALID_IMAGE"), ("png", "png", 20001, 1, 1, "RESOURCE_LIMIT_SIDE"),
             ("png", "png", 8000, 5001, 1, "RESOURCE_LIMIT_PIXELS"), ("png", "png", 9, 9, 101, "RESOURCE_LIMIT_FRAMES"), ("png", "png", 8000, 5000, 100, "OK")]
    df = spark.createDataFrame(cases, "a string, b string, w int, h int, f int, wanted string")
    got = df.select(assets.image_limits(*[F.col(c) for c in "abwhf"]).alias("v"), "wanted").collect()
    assert all(r.v == r.wanted for r in got)


def test_manifests(spark, tmp_path):
    good = {"schema_version": 1, "detector": {"id": "d"}, "samples": [{"id": "s1", "boxes": [{"x0": 1.0}]}, {"id": "s2", "boxes": []}]}
    for name, text in {"good": json.dumps(good, indent=1), "old": json.dumps({**good, "schema_version": 2}), "none": json.dumps({**good, "samples": []}), "bad": "{nope"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = manifest.read_manifest(spark, str(tmp_path), "id: string, boxes: array<struct<x0: double>>", "detector struct<id: string>")
    found = rows(got.select(F.regexp_extract("file_path", r"(\w+)\.json", 1), "status", "row_no", "id", "detector.id"))
    assert found == [("bad", "INVALID_JSON", None, None, None), ("good", "OK", 0, "s1", "d"), ("good", "OK", 1, "s2", "d"),
                     ("none", "EMPTY_CORPUS", None, None, "d"), ("old", "UNSUPPORTED_SCHEMA", None, None, "d")]


def test_ocr_words(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("left\ttop\twidth\theight\tconf\ttext\n10\t20\t30\t40\t30\tkeep\n10\t20\t30\t40\t29\tlow\n10\t20\t30\t40\t90\t \n"
                                    "10\t20\t0\t40\t90\tthin\nx\t20\t1\t40\t90\tbad\n0\t0\t1\t1\t96.5\t\"q\n")
    got = ocr.ocr_words(ocr.read_ocr_tsv(spark, str(tmp_path)), F.lit(100), F.lit(200), F.lit(50.0), F.lit(100.0), [])
    assert rows(got) == [('"q', 0.0, 0.0, 0.5, 0.5), ("keep", 5.0, 10.0, 20.0, 30.0)]


def test_pages(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<p>ü</p>".encode() + b"\xff")
    (tmp_path / "b.html").write_bytes(b"x" * 100)
    got = rows(pages.scan_pages(spark, str(tmp_path), 50).select("size_bytes", "html", "status"))
    assert got == [(10, "<p>ü</p>�", "OK"), (100, None, "RESPONSE_TOO_LARGE")]


def test_pixels(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(png([[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (10, 20, 30)], [(0, 0, 0), (255, 255, 255)]]))
    (tmp_path / "j.png").write_bytes(b"no image")
    read = images.read_images(spark, str(tmp_path))
    got = rows(images.scan_pixels(read).select("y", "x", "r", "g", "b", "gray"))
    assert got == [(0, 0, 255, 0, 0, 76), (0, 1, 0, 255, 0, 150), (1, 0, 0, 0, 255, 29), (1, 1, 10, 20, 30, 18), (2, 0, 0, 0, 0, 0), (2, 1, 255, 255, 255, 255)]
    assert list(images.gray_arrays(read).first().gray) == [76, 150, 29, 18, 0, 255]
    assert sorted((r.image_id[-5:], r.status, r.width) for r in read.collect()) == [("i.png", "OK", 2), ("j.png", "IMAGE_UNREADABLE", None)]


def test_store_gains_columns_and_reports_go_stale(spark, tmp_path):
    path = str(tmp_path / "tasks")
    store.save(spark.createDataFrame([(1, "queued")], ["id", "status"]), path, ["status"])
    store.save(spark.createDataFrame([(2, "failed", "{}")], ["id", "status", "result_json"]), path, ["status"])
    assert rows(store.load(spark, path).select("id", "status", "result_json")) == [(1, "queued", None), (2, "failed", "{}")]
    bad = store.decode_record(spark.createDataFrame([("{\"k\":1}",), ("oops",), (None,)], "j string"), "j", "k int", "p")
    assert [r.k for r in bad.select("p.k").collect()] == [1, None, None]
    fresh = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], ["k", "v"])
    report.write_report(fresh, str(tmp_path / "report"))
    stored = spark.read.schema("k bigint, v string").json(str(tmp_path / "report"))
    report.check_golden(fresh, stored)
    with pytest.raises(ValueError, match="STALE"):
        report.check_golden(fresh.distinct(), stored)
    assert rows(report.golden_diff(fresh.distinct(), stored)) == [(1, "a", "ONLY_STORED")]


def test_part_scan(spark, tmp_path):
    data = [("d", n, 1, False, "<x/>") for n in ("word/header1.xml", "word/footer.xml", "word/document.xml", "word/header1.xml.rels")]
    spark.createDataFrame(data, parts.SCHEMA).write.parquet(str(tmp_path / "p"))
    assert rows(parts.scan_header_parts(spark, str(tmp_path / "p")).select("part_name")) == [("word/footer.xml",), ("word/header1.xml",)]


def test_records_of_any_version(spark):
    from palimpsest.sources.store import decode_variant, record_schema

    deep = '{"a":' * 200 + "1" + "}" * 200
    data = [(1, '{"k": 1, "t": {"x": "y"}}'), (2, '{"k": "7"}'), (3, '{"k": "no"}'), (4, '{"k": '), (5, None), (6, ""), (7, "[1, 2]"), (8, '{"k": 1e400}'), (9, deep)]
    df = spark.createDataFrame(data, "id int, doc string")
    got = decode_variant(df, "doc", {"k": ("$.k", "bigint"), "x": ("$.t.x", "string"), "second": ("$[1]", "int")})
    assert got.columns == ["id", "doc", "k", "x", "second", "record_status"]
    by = {r["id"]: (r["k"], r["x"], r["second"], r["record_status"]) for r in got.collect()}
    assert by[1] == (1, "y", None, "OK") and by[2] == (7, None, None, "OK") and by[3] == (None, None, None, "OK")
    assert by[4][3] == "MALFORMED" and by[5][3] == "EMPTY" and by[6][3] == "MALFORMED" and by[7] == (None, None, 2, "OK") and by[9][:3] == (None, None, None)
    shape = record_schema(df.where("id < 7"), "doc").first()
    assert "k" in shape.record_schema and "x: STRING" in shape.record_schema and (shape.n_records, shape.n_malformed) == (3, 2)


def test_scores_in_sql(spark):
    from palimpsest.functions.measures import entropy_cols
    from palimpsest.functions.sql import register
    from pyspark.sql import functions as F

    assert "entropy_of" in register(spark) and register(spark)
    got = spark.sql("SELECT precision_of(3, 1), recall_of(0, 0), f1_of(3, 1, 1), f1_of(0, 1, 1), entropy_of(array(1D, 1D, 0D, 2D)), entropy_of(array()), safe_ratio(1, 0, NULL)").first()
    assert tuple(got) == (0.75, 1.0, 0.75, 0.0, 1.5, 0.0, None)
    counts = spark.createDataFrame([(1,), (1,), (0,), (2,), (None,)], "n int")
    assert counts.agg(entropy_cols(F.col("n"))).first()[0] == 1.5 and counts.where("false").agg(entropy_cols(F.col("n"))).first()[0] == 0.0
