"""Main text of pages."""

import html
import random

from palimpsest.llm import sst

FRAME = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a
href="/a">Menu</a></li></ul></nav><!-- no --><div class="ad">Buy {n}</div>{body}<div id="comments"><p>First {n}!</p></div><aside>Side {n}</aside>
<form><p>Mail</p><input value="x"></form><footer>&copy; {n}</footer></body></html>"""


def write(spark, pages, tmp_path, **more):
    frame = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string")
    frame.coalesce(2).write.parquet(str(tmp_path / "pages"))
    return spark.read.parquet(str(tmp_path / "pages"))


def test_articles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sst, "DEPTH", 5)
    body = "<article><header>Head</header><h1>A &amp; B &lt;c&gt;</h1><p><b>Bold &am<br>next\n line<p>Two&nbsp; <i>t</i>wo &amp\n<div class='share'>Share</div>" \
           "<ul><li>One<li>Two</ul><p>same</p><p>same</p></article>"
    want = "A & B <c>\nBold &am next line\nTwo two &\nOne\nTwo\nsame\nsame"
    pages = [("http://a.example/1", FRAME.format(n=1, body=body)), ("http://a.example/2", FRAME.format(n=2, body=body)),
             (None, FRAME.format(n=3, body="<article></article>")), ("x", None), ("http://b.example", ""), ("http://b.example", "plain < text 1<2"),
             ("http://c.example/1", "<article><p>cut off <b>he"), ("http://c.example/2", "<article><p>ok</p><p clas"),
             ("http://d.example", "<div class=page-header><main><p>" + "long " * 40_000 + "</main>"), ("http://e.example", "<p>" * 3000 + "deep" + "<div>" * 3000 + "er")]
    got = {r["page_id"]: r["text"] for r in sst.main_text(write(spark, pages, tmp_path)).collect()}
    assert got[0] == got[1] == want
    assert [got[i] for i in range(2, 8)] == ["Menu" * 0, "", "", "plain < text 1<2", "cut off he", "ok"]
    assert got[8] == ("long " * 40_000).strip() and got[9] == "deep\ner"
    assert sst.main_text(write(spark, [], tmp_path / "none")).count() == 0


def test_the_site_tree_finds_what_repeats(spark, tmp_path):
    rng = random.Random(4)
    pages = []
    for i in range(30):
        own = " ".join("w%d" % rng.randrange(10**6) for _ in range(30))
        pages.append(("https://WWW.site.example:80/%d" % i, f"<div class=top><p>Site name</p></div><div class=body><h2>t{i}</h2><p>{own}</p>"
                      + "<p>more %d</p>" % i * rng.randint(0, 3) + "</div><div class=legalese><p>All rights kept</p></div>"))
    pages.append(("https://other.example/", "<div class=top><p>Site name</p></div>"))
    got = {r["page_id"]: r["text"] for r in sst.main_text(write(spark, pages, tmp_path)).collect()}
    for i in range(30):
        assert got[i].startswith(f"t{i}\nw") and "Site name" not in got[i] and "rights" not in got[i]
        assert got[i].count("\n") == pages[i][1].count("<p>") - 2
    assert got[30] == "Site name"  # one page tells nothing


def test_repeated_blocks_in_articles_and_words_on_wrappers(spark, tmp_path):
    rng = random.Random(6)
    pages = []
    for i in range(24):
        own = " ".join("w%d" % rng.randrange(10**6) for _ in range(40))
        rail, box = "<div class=rail><p>Our other sites</p></div>", "<div class=feedback><p>Was this helpful?</p></div>"
        pages.append((f"https://one.example/{i}", f"<article><h1>t{i}</h1>{rail}<div class=body><p>{own}</p></div>{box}</article>"))
        pages.append((f"https://two.example/{i}", f"<main>{rail}<article><p>{own}</p></article>{box}</main>"))
        pages.append((f"https://three.example/{i}", f"<div class='layout with-sidebar'><div class=search><p>Find {i}</p></div><h1>t{i}</h1><p>{own}</p></div>"))
    pages.append(("https://four.example/", "<div class='page legal'><p>The only page.</p></div><div class=share><p>Tell</p></div>"))
    got = {r["page_id"]: r["text"] for r in sst.main_text(write(spark, pages, tmp_path)).collect()}
    for i in range(24):
        assert got[3 * i].startswith(f"t{i}\nw") and got[3 * i].count("\n") == 1
        assert got[3 * i + 1].startswith("w") and "\n" not in got[3 * i + 1]
        assert got[3 * i + 2].startswith(f"t{i}\nw") and got[3 * i + 2].count("\n") == 1
    assert got[72] == "The only page."


def test_given_pages(spark):
    """The articles of the given pages, cut out by their own markup."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in sst.main_text(pages).collect()}
    for r in pages.collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)
