import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import html as markup
from palimpsest.functions import paths, urls
from palimpsest.operators import links, packages as pk, sequences as sq
from tests.conftest import rows


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.o for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_share_text(spark):
    texts = ["no link", "see https://a.example/x。", "https://a.example/x https://b.example/y", "HTTPS://a.example/q?x=1!!!"]
    assert values(spark, lambda c: urls.share_status(urls.share_links(c)), texts) == ["NOT_FOUND", "OK", "MULTIPLE_LINKS", "OK"]
    assert values(spark, urls.share_links, texts[1:2]) == [["https://a.example/x"]]


def test_url_rules(spark):
    cases = {"https://a.example/x": "OK", "http://a.example/x": "HTTPS_REQUIRED", "https://u:p@a.example/x": "LINK_INVALID", "https://a.example:444/": "LINK_INVALID",
             "https://a.example:443/": "OK", "https://evil.test/": "HOST_NOT_ALLOWED", "https://a.example.evil.test/": "HOST_NOT_ALLOWED",
             "https://A.EXAMPLE/": "OK", "https://x.sub.test/": "OK", "https://" + "a" * 2048: "LINK_INVALID", "ftp://a.example/": "HTTPS_REQUIRED"}
    assert values(spark, lambda c: urls.url_status(c, ["a.example", ".sub.test"]), cases) == list(cases.values())
    assert values(spark, urls.canonical, ["https://H.x/a/b?q#f", "https://h.x"]) == ["https://h.x/a/b", "https://h.x/"]
    ids = {"https://h/explore/abcdefgh": "abcdefgh", "https://h/discovery/item/abc_-12345": "abc_-12345", "https://h/explore/short": None, "https://h/x/abcdefgh": None}
    assert values(spark, urls.path_id, ids) == list(ids.values())


def test_media_rules(spark):
    cases = {"http://cdn.test/a.png": "https://cdn.test/a.png", "https://x.cdn.test/a?w=1": "https://x.cdn.test/a?w=1", "https://cdn.test/": None,
             "https://xcdn.test/a": None, "https://cdn.test:443/a": None, "data:x": None}
    assert values(spark, lambda c: urls.media_url(c, "cdn.test"), cases) == list(cases.values())
    base = F.lit("https://h.x/dir/page?q=1")
    refs = {"a.png": "https://h.x/dir/a.png", "/a": "https://h.x/a", "//c.d/e": "https://c.d/e", "?z": "https://h.x/dir/page?z", "": "https://h.x/dir/page?q=1", "http://q/": "http://q/"}
    assert values(spark, lambda c: urls.url_join(base, c), refs) == list(refs.values())


PAGE = '<html><head><title> A &amp;amp; B\n</title><!-- <meta property="og:image" content="no"> --><script>"<meta name=x content=y>"</script>{}</head></html>'


def meta(*pairs):
    return PAGE.format("".join(f'<meta property="{k}" content="{v}">' for k, v in pairs))


def with_media(spark, html):
    page = spark.createDataFrame([(1, "https://h.cdn.test/p", html)], "page int, page_url string, html string")
    rows = page.withColumn("declared", links.attached(links.meta_items(markup.start_tags(F.col("html")))))
    return rows.withColumn("usable", links.usable_media(F.col("declared"), F.col("page_url"), "cdn.test"))


def status(spark, html):
    rows = with_media(spark, html).withColumn("media", links.top_media(F.col("usable")))
    out = links.page_status(rows, ["page"], "declared", "media", F.col("html").contains("og:title")).first()
    return out.status, out.candidate_count, list(out.diagnostic_codes), rows.first().media


def test_page_structure(spark):
    full = [("og:title", "t"), ("og:image", "https://cdn.test/1.png"), ("og:image:width", "10"), ("og:image:height", "20")]
    assert status(spark, meta(*full))[:3] == ("matched", 1, [])
    assert status(spark, meta())[:3] == ("changed", 0, ["UNRECOGNIZED"])
    assert status(spark, meta(("og:title", "t")))[:3] == ("partial", 0, ["MEDIA_MISSING"])
    assert status(spark, meta(("og:image", "https://other.test/1.png")))[:3] == ("changed", 0, ["MEDIA_UNUSABLE"])
    assert status(spark, meta(*full[:3]))[:3] == ("partial", 1, ["DIMENSIONS_MISSING"])
    assert status(spark, meta(*full, ("og:image:width", "0")))[:3] == ("partial", 1, ["DIMENSIONS_INVALID"])
    split = [("og:image", "http://cdn.test/1.png"), ("og:image:width", "10"), ("og:image", "https://cdn.test/1.png"), ("og:image:height", "20")]
    state, n, codes, media = status(spark, meta(*split))
    assert (state, n, codes) == ("matched", 1, ["DUPLICATES_COLLAPSED"]) and (media[0].width, media[0].height) == (10, 20)


def test_only_the_first_twenty_media(spark):
    urls_ = [("og:image", f"https://cdn.test/{i}.png") for i in range(25)] + [("og:image", "https://cdn.test/0.png"), ("og:image:width", "5")]
    _, n, codes, media = status(spark, meta(*urls_))
    assert n == 20 and [m.position for m in media] == list(range(1, 21)) and media[0].role == "cover" and media[1].role == "gallery"
    assert media[0].width is None and "DUPLICATES_COLLAPSED" not in codes and all(m.overflow for m in media)


def test_tags(spark):
    page = meta(("og:a", "x > y"))
    assert values(spark, markup.title, [page]) == ["A &amp; B"]
    assert values(spark, lambda c: F.size(markup.start_tags(c)), [page]) == [4]


def test_paths(spark):
    cases = {"a/./b//../c": "a/c", "../a": "../a", "a/..": ".", "../../x": "../../x"}
    assert values(spark, paths.normal_path, cases) == list(cases.values())
    owner = F.lit("word/header1.xml")
    targets = {"media/a.png": "word/media/a.png", "../x.png": "x.png", "../../x.png": None, "/word/a%20b.png#f": "word/a b.png", "a+b.png": "word/a+b.png"}
    assert values(spark, lambda c: paths.part_path(owner, c), targets) == list(targets.values())
    assert values(spark, paths.relationship_part, ["word/header1.xml", "x.xml"]) == ["word/_rels/header1.xml.rels", "_rels/x.xml.rels"]


HEADER = """<w:hdr xmlns:v="urn:schemas-microsoft-com:vml"><v:shape id="s1" type="#_x0000_t136" style="w:1"><v:textpath string=" Draft "/></v:shape>
<v:shape id="s2" type="#other"><v:textpath string="draft"/></v:shape><v:shape id="s3"><v:fill/></v:shape>
<wp:anchor behindDoc="1"><wp:extent cx="5" cy="6"/><wp:docPr id="1" name="Logo" descr="ACME mark"/><a:blip r:embed="rId1"/></wp:anchor>
<wp:inline><wp:docPr id="2" name="Pic"/><a:blip r:embed="rId2"/></wp:inline></w:hdr>"""


def test_header_shapes_and_drawings(spark):
    parts = spark.createDataFrame([("d", "word/header1.xml", HEADER), ("d", "word/document.xml", HEADER)], "asset string, part_name string, xml string")
    shapes = pk.shape_candidates(parts, "asset", "DRAFT").select("shape_index", "content", "classification", "evidence")
    assert rows(shapes) == [(0, "Draft", "confirmed", "HEADER_TEXT_SHAPE；BUILT_IN_MARK_SHAPE；EXACT_TARGET_TEXT"), (1, "draft", "ambiguous", "HEADER_TEXT_SHAPE；EXACT_TARGET_TEXT")]
    names = spark.createDataFrame([("d", "word/media/a.png"), ("d", "word/media/b.emf")], "asset string, part_name string")
    image = "http://x/relationships/image"
    rels = spark.createDataFrame([("d", "word/header1.xml", "rId1", "media/a.png", None, image), ("d", "word/header1.xml", "rId2", "media/b.emf", None, image),
                                  ("d", "word/header1.xml", "rId3", "http://q/x.png", "External", image), ("d", "word/header1.xml", "rId4", "gone.png", None, image)],
                                 "asset string, owner string, rel_id string, target string, target_mode string, type string")
    resolved = pk.resolve_rels(rels, names, ["asset"])
    assert {r.rel_id: r.status for r in resolved.collect()} == {"rId1": "OK", "rId2": "OK", "rId3": "EXTERNAL", "rId4": "INVALID_TARGET"}
    assert [r.rel_id for r in pk.dangling(rels, names, ["asset"]).collect()] == ["rId4"]
    media = spark.createDataFrame([("d", "word/media/a.png", "s1", "image/png"), ("d", "word/media/b.emf", "s2", None)], "asset string, part_name string, sha256 string, media_type string")
    got = pk.drawing_candidates(parts, resolved, media, "asset", "acme").select("drawing_index", "content", "evidence", F.size("allowed_strategies"))
    assert rows(got) == [(0, "ACME mark · Logo", "HEADER_IMAGE；FLOATING；BEHIND_TEXT；LABEL_HAS_TARGET", 1), (1, "Pic", "HEADER_IMAGE；NOT_PREVIEWABLE", 0)]


def test_markup_is_read_as_xml(spark):
    """Nested shapes, comments, character data, bound prefixes, single quotes, and parts that are no XML."""
    ns = 'xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:other"'
    parts = [
        (1, "word/header1.xml", f"<w {ns}><v:shape type='#_x0000_t136'><v:group><v:shape><v:textpath string='in'/></v:shape></v:group><v:textpath string=' out '/></v:shape></w>"),
        (2, "word/header1.xml", f"<w {ns}><!-- <v:shape><v:textpath string='no'/></v:shape> --><![CDATA[<v:shape><v:textpath string='no'/></v:shape>]]><v:shape><v:textpath string='a &#62; b'/></v:shape></w>"),
        (3, "word/header1.xml", f"<w {ns}><o:shape><o:textpath string='other'/></o:shape><x:shape xmlns:x='urn:schemas-microsoft-com:vml'><x:textpath string='bound'/></x:shape></w>"),
        (4, "word/header1.xml", "<v:shape><v:textpath string='open'/>"), (5, "word/header1.xml", None), (6, "word/header1.xml", ""),
        (7, "word/header1.xml", "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>"), (8, "word/footer2.xml", "<w/>"), (9, "word/document.xml", "<broken"),
        (None, "word/header3.xml", "<wp:inline><a:blip/><wp:anchor behindDoc='true'><wp:docPr name='n' title=' t '/><a:blip r:embed='r2'/></wp:anchor><a:blip r:embed='r1'/></wp:inline>"),
    ]
    table = spark.createDataFrame(parts, "asset int, part_name string, xml string")
    shapes = pk.shape_candidates(table, "asset", "out").select("asset", "shape_index", "content", "classification")
    assert rows(shapes) == [(1, 0, "in out", "ambiguous"), (1, 1, "in", "ambiguous"), (2, 0, "a > b", "ambiguous"), (3, 0, "bound", "ambiguous")]
    assert rows(pk.malformed(table, "asset")) == [(i, "word/header1.xml", "INVALID_MARKUP") for i in (4, 5, 6, 7)]
    read = pk.read_parts(table, ["asset"]).where("kind = 'drawing'").select("idx", "type", "embed", "behind", "labels").collect()
    assert [(r[0], r[1], r[2], r[3], list(r[4])) for r in read] == [(0, "inline", None, None, [" t ", "n"]), (1, "anchor", "r2", "true", [" t ", "n"])]
    assert pk.shape_candidates(table.where("false"), "asset").count() == 0


def test_package_limits_follow_entry_order(spark):
    data = [("ok", 1, "a.xml", 5, False), ("big", 1, "a.xml", 50, False), ("big", 2, "../b.xml", 60, False), ("bad", 1, "/b.xml", 5, True), ("bad2", 1, "x", 99, False), ("bad2", 2, "a/../b", 1, False), ("many", 1, "a", 1, True)] + [("many", i, "a", 1, False) for i in range(2, 6)]
    df = spark.createDataFrame(data, "asset string, no int, part_name string, size_bytes int, encrypted boolean")
    got = pk.package_status(df, "asset", ["no"], F.floor(F.col("no") / 2), 4, 100).select("asset", "status")
    assert dict(rows(got)) == {"ok": "OK", "big": "INVALID_DOCX", "bad": "PASSWORD_REQUIRED", "bad2": "INVALID_DOCX", "many": "RESOURCE_LIMIT"}


def operators(spark, *pages):
    data = [(p, i, op, name) for p, ops in enumerate(pages) for i, (op, name) in enumerate(ops)]
    return spark.createDataFrame(data, "page int, pos int, op string, name string")


def fill(name, other=None, gs=True):
    body = [("CS", "/Pattern"), ("cs", "/Pattern"), ("SCN", name), ("scn", other or name)]
    return body + ([("gs", "/G")] if gs else []) + [("re", None), ("f", None)]


def test_pattern_fill_signature(spark):
    broken = [("CS", "/Pattern"), ("cs", "/Other"), ("SCN", "/P"), ("scn", "/P"), ("re", None), ("f", None)]
    df = operators(spark, [("q", None), *fill("/P1"), *fill("/P2", gs=False)], fill("/P", "/Q"), broken, fill("/P")[:-1])
    for chunk in (6, 4096):
        got = sq.sequence_match(df, ["page"], chunk=chunk)
        assert rows(got) == [(0, 1, 7, "/P1"), (0, 8, 6, "/P2")]
    found = sq.sequence_match(df, ["page"])
    resources = spark.createDataFrame([(0, "/P1", 1, "5 0"), (0, "/P9", 2, "6 0")], "page int, name string, pattern_type int, object_ref string")
    resolved = sq.resolve_patterns(found, resources, ["page"])
    assert {r.name: r.classification for r in resolved.collect()} == {"/P1": "confirmed", "/P2": "ambiguous"}
    d = sq.diagnostics(df.withColumn("asset", F.lit(1)), resources.withColumn("asset", F.lit(1)), resolved.withColumn("asset", F.lit(1)), ["asset"], "page").first()
    assert tuple(d) == (1, 4, 1, 2, 1, 2, 1, 1)


def test_pages_with_very_many_media(spark):
    html = PAGE.format("".join(f'<meta property="og:image" content="https://cdn.test/{i}.png">' for i in range(1200)))
    rows = with_media(spark, html).withColumn("media", links.dedupe_fill(F.col("usable")))
    assert links.page_status(rows, ["page"], "declared", "media", F.lit(True)).first().candidate_count == 1200
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_attributes_are_decoded(spark):
    one = spark.createDataFrame([('<v:shape type="#_x0000_t136"><v:textpath string="A &amp; STRASSE"/></v:shape>',)], "xml string")
    parts = one.selectExpr("1 AS asset", "'word/header1.xml' AS part_name", "xml")
    got = pk.shape_candidates(parts, "asset", "a & straße").first()
    assert (got.content, got.classification) == ("A & STRASSE", "confirmed")


@pytest.mark.parametrize("fan", [2, 256])
def test_nonoverlapping_counts_for_any_chunk(spark, fan, monkeypatch):
    monkeypatch.setattr(sq, "FAN", fan)
    rng = random.Random(2)
    data = [(p, i, rng.choice((3, 4))) for p in range(3) for i in range(400) if rng.random() < 0.6]
    df = spark.createDataFrame(data, "page int, pos int, length int")
    wanted = {}
    for p in range(3):
        free = n = 0
        for _, i, size in sorted(d for d in data if d[0] == p):
            if i >= free:
                n, free = n + 1, i + size
        wanted[p] = n
    for chunk in (5, 64, 4096):
        assert dict(rows(sq.nonoverlapping(df, ["page"], 4, chunk=chunk))) == wanted


def test_equal_parts_of_a_batch_are_read_once(monkeypatch):
    import pyarrow as pa

    from palimpsest.operators import markup

    one, two = '<h><v:shape type="a"><v:textpath string="x"/></v:shape><inline/></h>', "<h><v:shape/><v:shape/><v:shape/></h>"
    parts = [one, None, two, "<h>", one, "<h/>", None, one, two]
    want = [(i, r) for i, p in enumerate(parts) for r in (markup.read_part(p) if markup.read_part(p) is not None else [{"kind": "malformed"}])]
    read, plain = [], markup.read_part
    monkeypatch.setattr(markup, "read_part", lambda xml: read.append(xml) or plain(xml))
    rows, place, row = markup.read_distinct(pa.array(parts))
    assert [(i, rows[r]) for i, r in zip(place.tolist(), row.tolist(), strict=True)] == want
    assert len(read) == 5
    assert [len(x) for x in markup.read_distinct(pa.array([], pa.string()))] == [0, 0, 0]
