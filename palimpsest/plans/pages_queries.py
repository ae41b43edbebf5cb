"""Queries over raw pages and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import html as markup
from palimpsest.functions import urls
from palimpsest.functions.measures import declared_dimension
from palimpsest.functions.text import clean
from palimpsest.operators import links
from palimpsest.plans.registry import Tables, query
from palimpsest.sources.pages import page_cap

SHARE = "'see ' || url || CASE WHEN page_id % 3 = 0 THEN '。 and ' || url || '/b!)' WHEN page_id % 5 = 0 THEN '' ELSE '.' END"


@query("url_extract", f"""
WITH s AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'no link' ELSE {SHARE} END AS txt FROM pages),
l AS (SELECT page_id, list_transform(regexp_extract_all(txt, '(?i)https?://[^\\s<>"''，。；：！？、）》】}}\\)\\]]+'), lambda u: regexp_replace(u, '[.,;:!?，。；：！？、）》】}}\\)\\]]+$', '')) AS links FROM s)
SELECT page_id, array_to_string(links, ' ') AS links, CASE WHEN len(links) = 0 THEN 'NOT_FOUND' WHEN len(links) > 1 THEN 'MULTIPLE_LINKS' ELSE 'OK' END AS status FROM l""")
def url_extract(t: Tables) -> DataFrame:
    page = F.col("page_id")
    tail = F.when(page % 3 == 0, F.concat(F.lit("。 and "), "url", F.lit("/b!)"))).when(page % 5 == 0, "").otherwise(".")
    shared = F.when(page % 7 == 0, "no link").otherwise(F.concat(F.lit("see "), "url", tail))
    rows = t.pages.select("page_id", urls.share_links(shared).alias("l"))
    return rows.select("page_id", F.array_join("l", " ").alias("links"), urls.share_status(F.col("l")).alias("status"))


def variants(t: Tables) -> DataFrame:
    """Page addresses, some with a user, a port, an upper-case scheme or too many characters."""
    page, url = F.col("page_id"), F.col("url")
    rest = F.regexp_replace(url, "^https?://", "")
    return t.pages.select("page_id", F.when(page % 8 == 0, F.concat(F.lit("https://me@"), rest))
                          .when(page % 8 == 1, F.regexp_replace(url, "(://[^/]+)", "$1:8443")).when(page % 8 == 2, F.regexp_replace(url, "(://[^/]+)", "$1:443"))
                          .when(page % 8 == 3, F.regexp_replace(url, "^https", "HTTPS")).when(page % 8 == 4, F.concat(url, F.repeat(F.lit("x"), F.lit(2100))))
                          .otherwise(url).alias("url"))


VARIANTS = """
v AS (SELECT page_id, url AS raw, CASE page_id % 8 WHEN 0 THEN 'https://me@' || regexp_replace(url, '^https?://', '') WHEN 1 THEN regexp_replace(url, '(://[^/]+)', '\\1:8443')
 WHEN 2 THEN regexp_replace(url, '(://[^/]+)', '\\1:443') WHEN 3 THEN regexp_replace(url, '^https', 'HTTPS') WHEN 4 THEN url || repeat('x', 2100) ELSE url END AS url,
 regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages)
"""


@query("url_status", f"""WITH {VARIANTS}
SELECT page_id, CASE WHEN length(url) > 2048 THEN 'LINK_INVALID' WHEN lower(url) NOT LIKE 'https://%' THEN 'HTTPS_REQUIRED' WHEN page_id % 8 IN (0, 1) THEN 'LINK_INVALID'
 WHEN NOT (host LIKE '%.example.com' OR host = 'ththth.example.net' OR host = 'm.ththth.example.net') THEN 'HOST_NOT_ALLOWED' ELSE 'OK' END AS status FROM v""")
def url_status(t: Tables) -> DataFrame:
    allowed = [".example.com", "ththth.example.net", "m.ththth.example.net"]
    return variants(t).select("page_id", urls.url_status(F.col("url"), allowed).alias("status"))


@query("url_canonical", f"""WITH {VARIANTS}, p AS (SELECT page_id, host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM v)
SELECT page_id, 'https://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END AS canonical,
 coalesce(CASE WHEN regexp_matches(path, '^/+(en|fr|de)/+[A-Za-z0-9_.-]+/*$') THEN nullif(regexp_extract(path, '^/+(en|fr|de)/+([A-Za-z0-9_.-]+)/*$', 2), '') END, '') AS path_id FROM p""")
def url_canonical(t: Tables) -> DataFrame:
    shapes = [("en",), ("fr",), ("de",)]
    found = urls.path_id(F.col("url"), shapes, r"^[A-Za-z0-9_.-]+$")
    return variants(t).select("page_id", urls.canonical(F.col("url")).alias("canonical"), F.coalesce(found, F.lit("")).alias("path_id"))


@query("media_url", f"""WITH {VARIANTS}, p AS (SELECT *, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(\\?[^#]*)', 1) AS q FROM v),
s AS (SELECT *, CASE WHEN length(url) > 4096 THEN 'MEDIA_URL_INVALID' WHEN page_id % 8 IN (0, 1, 2) THEN 'MEDIA_URL_INVALID'
 WHEN NOT (host = 'example.com' OR host LIKE '%.example.com') THEN 'MEDIA_HOST_NOT_ALLOWED' WHEN path IN ('', '/') THEN 'MEDIA_URL_INVALID' ELSE 'OK' END AS status FROM p)
SELECT page_id, status, CASE WHEN status = 'OK' THEN 'https://' || host || path || q ELSE '' END AS media FROM s""")
def media_url(t: Tables) -> DataFrame:
    u = F.col("url")
    return variants(t).select("page_id", urls.media_status(u, "example.com").alias("status"),
                              F.coalesce(urls.media_url(u, "example.com"), F.lit("")).alias("media"))


LINKS = r"""
vis AS (SELECT page_id, url AS page_url, html, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g') AS vis FROM pages),
arr AS (SELECT page_id, page_url, regexp_extract_all(vis, '<[A-Za-z](?:"[^"]*"|''[^'']*''|[^''">])*>') AS tags FROM vis),
tags AS (SELECT page_id, page_url, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos FROM arr),
named AS (SELECT *, lower(regexp_extract(tag, '^<([A-Za-z][A-Za-z0-9]*)', 1)) AS name, regexp_extract(tag, '(?is)\shref\s*=\s*"([^"]*)"', 1) AS href FROM tags)
"""


def link_rows(t: Tables) -> DataFrame:
    """Links of each page with their target as written."""
    rows = links.tags(t.pages, ["page_id", "url"], "html")
    href = markup.attribute(F.col("tag"), "href")
    return rows.filter(markup.tag_name(F.col("tag")) == "a").select("page_id", "url", F.col("pos").cast("bigint").alias("pos"), href.alias("href"))


DECODE = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"


@query("url_join", rf"""WITH {LINKS},
h AS (SELECT page_id, pos, page_url, {DECODE.format('href')} AS href FROM named WHERE name = 'a' AND href <> ''),
r AS (SELECT *, CASE pos % 7 WHEN 1 THEN 'ftp://other.example/a' WHEN 2 THEN '//cdn.example' || href WHEN 3 THEN substr(href, 2) WHEN 4 THEN '' WHEN 5 THEN '?q=' || pos
  WHEN 6 THEN '#top' ELSE href END AS ref, lower(regexp_extract(page_url, '^([A-Za-z]+):', 1)) AS scheme, regexp_extract(page_url, '^[A-Za-z]+://([^/?#]*)', 1) AS host,
  regexp_extract(page_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(page_url, '^[^?#]*(\?[^#]*)', 1) AS q FROM h),
f AS (SELECT *, scheme || '://' || host AS origin, coalesce(nullif(regexp_extract(path, '^(.*/)[^/]*$', 1), ''), '/') AS folder FROM r)
SELECT page_id, pos, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref WHEN ref LIKE '//%' THEN scheme || ':' || ref WHEN ref LIKE '/%' THEN origin || ref
 WHEN ref = '' THEN origin || path || q WHEN ref LIKE '?%' THEN origin || path || ref WHEN ref LIKE '#%' THEN origin || path || q || ref ELSE origin || folder || ref END AS link FROM f""")
def url_join(t: Tables) -> DataFrame:
    """Every link of every page, as it is and rewritten into the other kinds of reference."""
    pos, href = F.col("pos"), F.col("href")
    kind = pos % 7
    ref = (F.when(kind == 1, "ftp://other.example/a").when(kind == 2, F.concat(F.lit("//cdn.example"), href)).when(kind == 3, F.substring(href, 2, 1 << 30))
           .when(kind == 4, "").when(kind == 5, F.concat(F.lit("?q="), pos.cast("string"))).when(kind == 6, "#top").otherwise(href))
    rows = link_rows(t).filter(href != "").withColumn("ref", ref)
    return rows.select("page_id", "pos", urls.url_join(F.col("url"), F.col("ref")).alias("link"))


@query("html_meta", rf"""WITH {LINKS},
c AS (SELECT page_id, count(*) FILTER (name = 'meta') AS n_meta, count(*) FILTER (name = 'a') AS n_links, count(*) AS n_tags FROM named GROUP BY page_id)
SELECT page_id, coalesce(substr(trim(regexp_replace({DECODE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}, '[\t-\r\x1c-\x20\x85\pZ]+', ' ', 'g')), 1, 200), '') AS title,
 coalesce(n_meta, 0) AS n_meta, coalesce(n_links, 0) AS n_links, coalesce(n_tags, 0) AS n_tags FROM vis LEFT JOIN c USING (page_id)""")
def html_meta(t: Tables) -> DataFrame:
    names = F.transform(markup.start_tags(F.col("html")), markup.tag_name)
    rows = t.pages.select("page_id", F.coalesce(clean(markup.title(F.col("html")), 200), F.lit("")).alias("title"), names.alias("_names"))

    def count(name: str):
        return F.size(F.filter("_names", lambda n: n == name)).cast("bigint")

    return rows.select("page_id", "title", count("meta").alias("n_meta"), count("a").alias("n_links"), F.size("_names").cast("bigint").alias("n_tags"))


@query("page_metadata", rf"""WITH {LINKS},
t AS (SELECT page_id, nullif(trim({DECODE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}, ' ' || chr(9) || chr(10) || chr(13)), '') AS title FROM vis)
SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN 'A & B ' || page_id END, title, '') AS title,
 CASE WHEN page_id % 5 = 0 THEN 'first' WHEN page_id % 5 = 1 THEN 'plain' ELSE '' END AS description, CASE WHEN page_id % 4 = 0 THEN 'someone' ELSE '' END AS author,
 CASE page_id % 6 WHEN 0 THEN 'https://www.notes.example/explore/url_' || (10000 + page_id) WHEN 1 THEN 'https://www.notes.example/explore/link_' || (10000 + page_id)
  WHEN 5 THEN '' ELSE 'https://www.notes.example/explore/page-' || (10000 + page_id) END AS canonical_url,
 CASE page_id % 6 WHEN 0 THEN 'url_' || (10000 + page_id) WHEN 1 THEN 'link_' || (10000 + page_id) WHEN 5 THEN '' ELSE 'page-' || (10000 + page_id) END AS note_id,
 page_id % 6 IN (2, 3) AS canonical_ignored FROM t""")
def page_metadata(t: Tables) -> DataFrame:
    """Pages under note addresses, with declarations ahead of their own markup: og:url before a canonical link, a canonical link
    alone, one on another host, one without a note, none, and none on a short address."""
    page, number = F.col("page_id"), (F.col("page_id") + 10_000).cast("string")

    def tag(when, before: str, value, after: str = '">'):
        return F.when(when, F.concat(F.lit(before), value, F.lit(after))).otherwise("")

    link = '<link rel="alternate Canonical" href="'
    head = F.concat(
        tag(page % 6 == 0, '<meta property="og:url" content="https://www.notes.example/discovery/item/url_', number),
        tag(page % 6 == 0, link + "/item/never_", number), tag(page % 6 == 1, link + "/item/link_", number),
        tag(page % 6 == 2, link + "https://elsewhere.example/item/far_", number), tag(page % 6 == 3, link + "/about/", number),
        tag(page % 3 == 0, '<META PROPERTY="OG:title" content=" A &amp; B ', page.cast("string")),
        tag(page % 5 == 1, '<meta name="description" content="', F.lit("plain")), tag(page % 5 == 0, '<meta name="description" content="', F.lit("second")),
        tag(page % 5 == 0, "<meta name='og:description' content='", F.lit("first"), "'>"), tag(page % 4 == 0, '<meta name="article:author" content="', F.lit("someone")))
    url = F.when(page % 6 == 5, F.concat(F.lit("https://n.example/a/"), number)).otherwise(F.concat(F.lit("https://www.notes.example/explore/page-"), number))
    rows = t.pages.select("page_id", url.alias("url"), F.concat(head, "html").alias("html"))
    found = links.page_metadata(rows, ["page_id"], "url", "html", ["www.notes.example"], ["n.example"], "https://www.notes.example")
    return found.fillna("", ["title", "description", "author", "canonical_url", "note_id"])


@query("first_meta", f"""WITH {LINKS}
SELECT page_id, name, min(pos) AS pos, arg_min(tag, pos) AS content FROM named GROUP BY page_id, name""")
def first_meta(t: Tables) -> DataFrame:
    """First start tag of each name per page."""
    entries = F.transform(markup.start_tags(F.col("html")), lambda tag, i: F.struct(
        markup.tag_name(tag).alias("key"), i.cast("bigint").alias("pos"), tag.alias("content")))
    found = t.pages.select("page_id", F.explode(links.first_per_key(entries)).alias("f"))
    return found.select("page_id", F.col("f.key").alias("name"), "f.pos", "f.content")


@query("dim", """
WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR) WHEN 2 THEN CAST(user_id AS VARCHAR) ELSE ' ' || user_id END AS txt FROM events)
SELECT event_id, coalesce(CASE WHEN regexp_full_match(txt, '[0-9]+') AND CAST(CASE WHEN regexp_full_match(txt, '[0-9]+') THEN txt END AS BIGINT) BETWEEN 1 AND 100000 THEN CAST(CASE WHEN regexp_full_match(txt, '[0-9]+') THEN txt END AS BIGINT) END, -1) AS dimension FROM d""")
def dim(t: Tables) -> DataFrame:
    """Numbers as written by four different hands."""
    kind, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    text = (F.when(kind == 0, F.col("value").cast("string")).when(kind == 1, F.round(F.col("value") * 1000).cast("bigint").cast("string"))
            .when(kind == 2, user).otherwise(F.concat(F.lit(" "), user)))
    return t.events.select("event_id", F.coalesce(declared_dimension(text), F.lit(-1)).alias("dimension"))


def with_media(t: Tables) -> DataFrame:
    """Links declare media; paragraphs after them give widths and line breaks heights by their position."""
    def item(tag, i):
        name = markup.tag_name(tag)
        role = F.when(name == "a", "media").when(name.isin("li", "p"), "width").when(name.isin("br", "div"), "height").otherwise("other")
        number = F.when(i % 3 == 0, "n/a").otherwise(i.cast("string"))
        content = F.when(name == "a", F.coalesce(markup.attribute(tag, "href"), F.lit(""))).otherwise(number)
        return F.struct(i.cast("bigint").alias("pos"), role.alias("role"), content.alias("content"))

    items = F.filter(F.transform(markup.start_tags(F.col("html")), item), lambda v: v["content"] != "")
    rows = t.pages.select("page_id", "url", links.attached(items).alias("declared"))
    return rows.withColumn("usable", links.usable_media(F.col("declared"), F.col("url"), "example.com"))


def listed(rows: DataFrame, media, *columns: str) -> DataFrame:
    return rows.select("page_id", F.explode(media).alias("m")).select("page_id", *[f"m.{c}" for c in columns])


DIMS = f"""
{LINKS},
roles AS (SELECT page_id, page_url, pos, CASE WHEN name = 'a' THEN 'media' WHEN name IN ('li', 'p') THEN 'width' WHEN name IN ('br', 'div') THEN 'height' ELSE 'other' END AS role,
  CASE WHEN name = 'a' THEN {DECODE.format('href')} WHEN pos % 3 = 0 THEN 'n/a' ELSE CAST(pos AS VARCHAR) END AS content FROM named),
grp AS (SELECT *, count(*) FILTER (role = 'media') OVER (PARTITION BY page_id ORDER BY pos) AS g FROM roles WHERE role <> 'other' AND content <> ''),
decl AS (SELECT page_id, page_url, min(pos) FILTER (role = 'media') AS pos, max(content) FILTER (role = 'media') AS ref,
  arg_min(CAST(content AS BIGINT), pos) FILTER (role = 'width' AND content <> 'n/a' AND content <> '0') AS width, arg_min(CAST(content AS BIGINT), pos) FILTER (role = 'height' AND content <> 'n/a' AND content <> '0') AS height,
  count(*) FILTER (role <> 'media' AND content IN ('n/a', '0')) AS invalid_dims FROM grp WHERE g > 0 GROUP BY page_id, page_url, g)
""".replace("arg_min(CAST(content AS BIGINT)", "arg_min(TRY_CAST(content AS BIGINT)")


@query("attach_dims", f"""WITH {DIMS} SELECT page_id, pos, ref AS url, coalesce(width, -1) AS width, coalesce(height, -1) AS height, invalid_dims FROM decl""")
def attach_dims(t: Tables) -> DataFrame:
    return listed(with_media(t), F.col("declared"), "pos", "url", "width", "height", "invalid_dims").fillna(-1, ["width", "height"])


MEDIA = f"""
{DIMS},
usable AS (SELECT page_id, pos, width, height, 'https://' || regexp_extract(page_url, '^https?://([^/?#]*)', 1) || regexp_extract(ref, '^([^?#]*)', 1) || regexp_extract(ref, '(\\?[^#]*)', 1) AS url FROM decl
  WHERE ref LIKE '/%' AND ref NOT LIKE '//%' AND regexp_extract(page_url, '^https?://([^/?#]*)', 1) LIKE '%.example.com' AND regexp_extract(ref, '^([^?#]*)', 1) <> '/')
"""


@query("dedupe_fill", f"""WITH {MEDIA}
SELECT page_id, url, min(pos) AS pos, count(*) AS n_declared, coalesce(arg_min(width, pos) FILTER (width IS NOT NULL), -1) AS width, coalesce(arg_min(height, pos) FILTER (height IS NOT NULL), -1) AS height FROM usable GROUP BY ALL""")
def dedupe_fill(t: Tables) -> DataFrame:
    media = links.dedupe_fill(F.col("usable"))
    return listed(with_media(t), media, "url", "pos", "n_declared", "width", "height").fillna(-1, ["width", "height"])


@query("media_positions", f"""WITH {MEDIA}, u AS (SELECT page_id, url, min(pos) AS pos FROM usable GROUP BY ALL)
SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS position, CASE WHEN row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1 THEN 'cover' ELSE 'gallery' END AS role FROM u""")
def media_positions(t: Tables) -> DataFrame:
    return listed(with_media(t), links.positions(links.dedupe_fill(F.col("usable"))), "url", "position", "role")


@query("top_media", f"""WITH {MEDIA}, u AS (SELECT page_id, url, min(pos) AS pos FROM usable GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS position, count(*) OVER (PARTITION BY page_id) AS n FROM u)
SELECT page_id, 'image-' || substr(sha256(url), 1, 20) AS candidate_id, position, n >= 4 AS overflow FROM r WHERE position <= 4""")
def top_media(t: Tables) -> DataFrame:
    """The first four different media per page."""
    return listed(with_media(t), links.top_media(F.col("usable"), 4), "candidate_id", "position", "overflow")


@query("page_status", f"""WITH {MEDIA},
u AS (SELECT page_id, url, count(*) AS n, min(width) AS w, min(height) AS h FROM usable GROUP BY ALL),
c AS (SELECT page_id, count(*) AS k, sum(n - 1) AS dup, count(*) FILTER (w IS NULL OR h IS NULL) AS inc FROM u GROUP BY page_id),
d AS (SELECT page_id, count(*) AS m, sum(invalid_dims) AS bad FROM decl GROUP BY page_id),
j AS (SELECT page_id, coalesce(m, 0) AS m, coalesce(bad, 0) AS bad, coalesce(k, 0) AS k, coalesce(dup, 0) AS dup, coalesce(inc, 0) AS inc, page_id % 13 <> 0 OR coalesce(m, 0) > 0 AS known
  FROM pages LEFT JOIN d USING (page_id) LEFT JOIN c USING (page_id))
SELECT page_id, k AS candidate_count, CASE WHEN NOT known OR (m > 0 AND k = 0) THEN 'changed' WHEN k = 0 OR inc > 0 OR bad > 0 THEN 'partial' ELSE 'matched' END AS status,
 concat_ws(',', CASE WHEN NOT known THEN 'UNRECOGNIZED' WHEN m > 0 AND k = 0 THEN 'MEDIA_UNUSABLE' WHEN k = 0 THEN 'MEDIA_MISSING' WHEN inc > 0 THEN 'DIMENSIONS_MISSING' END,
  CASE WHEN bad > 0 THEN 'DIMENSIONS_INVALID' END, CASE WHEN dup > 0 THEN 'DUPLICATES_COLLAPSED' END) AS codes FROM j""")
def page_status(t: Tables) -> DataFrame:
    """Links as media on example.com; every thirteenth page counts as having no text metadata."""
    rows = with_media(t).withColumn("media", links.dedupe_fill(F.col("usable")))
    out = links.page_status(rows, ["page_id"], "declared", "media", F.col("page_id") % 13 != 0)
    return out.select("page_id", "candidate_count", "status", F.array_join("diagnostic_codes", ",").alias("codes"))


@query("page_cap", "SELECT page_id, octet_length(encode(html)) AS size_bytes, CASE WHEN octet_length(encode(html)) > 5000 THEN 'RESPONSE_TOO_LARGE' ELSE 'OK' END AS status FROM pages")
def page_cap_query(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.octet_length("html").cast("bigint").alias("size_bytes"), page_cap(F.col("html"), 5000).alias("status"))
