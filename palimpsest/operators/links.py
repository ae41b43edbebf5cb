"""Page metadata: tags, declared media with sizes, de-duplication and structure status.

Everything about a page comes from its one row, so all steps fold arrays inside the row: nothing is
shuffled, and no page meets another. Folds sort or scan once, whatever the number of tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import html as markup
from palimpsest.functions.ids import digest_id
from palimpsest.functions.measures import declared_dimension
from palimpsest.functions.text import codes
from palimpsest.functions.urls import let, media_url, parsed_link, url_join

# The tag names that declare a picture, its width and its height.
MEDIA_KEYS = ("og:image", "og:image:url", "og:image:secure_url", "twitter:image")
WIDTH_KEYS = ("og:image:width", "twitter:image:width")
HEIGHT_KEYS = ("og:image:height", "twitter:image:height")
MAX_MEDIA = 20


def tags(pages: DataFrame, keep: list[str], html: str) -> DataFrame:
    """Start tags of each page with their position; numbered inside the row."""
    return pages.select(*keep, F.posexplode(markup.start_tags(F.col(html))).alias("pos", "tag"))


def sorted_heads(rows: Column, key: str) -> Column:
    """(first, size) of every run of equal keys in an array sorted by key."""
    starts = F.filter(F.transform(rows, lambda r, i: F.when((i == 0) | ~r[key].eqNullSafe(F.get(rows, i - 1)[key]), i)), lambda i: i.isNotNull())
    return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(i.alias("first"), (F.coalesce(F.get(at, k + 1), F.size(rows)) - i).alias("size"))))


def first_per_key(entries: Column) -> Column:
    """The first entry (key, pos, content) of each key in document order."""
    return let(F.array_sort(entries), lambda rows: let(sorted_heads(rows, "key"), lambda heads: F.transform(heads, lambda h: F.get(rows, h["first"]))))


def meta_items(tags: Column) -> Column:
    """(pos, role, content) of the meta tags among start tags: media, width, height or other."""
    key = lambda m: m["key"]
    pairs = F.transform(tags, lambda t, i: F.struct(
        i.cast("bigint").alias("pos"), F.coalesce(markup.meta_key(t), F.lit("")).alias("key"),
        F.trim(F.coalesce(markup.attribute(t, "content"), F.lit(""))).alias("content")))
    return F.transform(F.filter(pairs, lambda m: (m["key"] != "") & (m["content"] != "")), lambda m: F.struct(
        m["pos"].alias("pos"), F.when(key(m).isin(*MEDIA_KEYS), "media").when(key(m).isin(*WIDTH_KEYS), "width")
        .when(key(m).isin(*HEIGHT_KEYS), "height").otherwise("other").alias("role"), m["content"].alias("content")))


def attached(items: Column) -> Column:
    """Media declarations with the first valid width and height that follow them before the next one.

    Items have pos, role and content in document order. Sizes before any picture belong to none.
    """
    def side(found: Column, name: str) -> Column:
        return F.get(F.filter(found, lambda v: (v["role"] == name) & v["v"].isNotNull()), F.lit(0))["v"].alias(name)

    def one(sized: Column, starts: Column) -> Column:
        def media(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(sized))
            rest = F.transform(F.slice(sized, at + 2, end - at - 1), lambda v: F.struct(v["role"].alias("role"), declared_dimension(v["content"]).alias("v")))
            return let(rest, lambda found: F.struct(
                F.get(sized, at)["pos"].alias("pos"), F.get(sized, at)["content"].alias("url"), side(found, "width"), side(found, "height"),
                F.size(F.filter(found, lambda v: v["v"].isNull())).cast("bigint").alias("invalid_dims")))

        return F.transform(starts, media)

    def begun(sized: Column) -> Column:
        starts = F.filter(F.transform(sized, lambda v, i: F.when(v["role"] == "media", i)), lambda i: i.isNotNull())
        return let(starts, lambda at: one(sized, at))

    return let(F.filter(items, lambda v: v["role"] != "other"), begun)


def usable_media(declared: Column, base: Column, media_host: str) -> Column:
    """Declarations whose address, resolved against the page, is accepted; `url` becomes its https form."""
    resolved = F.transform(declared, lambda m: m.withField("url", media_url(url_join(base, m["url"]), media_host)))
    return F.filter(resolved, lambda m: m["url"].isNotNull())


def dedupe_fill(media: Column) -> Column:
    """(pos, url, n_declared, width, height): one entry per address at its first position, in document order; missing
    sizes come from the earliest later duplicate."""
    by_url = F.array_sort(F.transform(media, lambda m: F.struct(*[m[c].alias(c) for c in ("url", "pos", "width", "height")])))

    def first(rows: Column, h: Column, side: str) -> Column:
        return F.get(F.filter(F.slice(rows, h["first"] + 1, h["size"]), lambda m: m[side].isNotNull()), F.lit(0))[side].alias(side)

    def folded(rows: Column) -> Column:
        return let(sorted_heads(rows, "url"), lambda heads: F.array_sort(F.transform(heads, lambda h: F.struct(
            F.get(rows, h["first"])["pos"].alias("pos"), F.get(rows, h["first"])["url"].alias("url"), h["size"].cast("bigint").alias("n_declared"),
            first(rows, h, "width"), first(rows, h, "height")))))

    return let(by_url, folded)


def positions(media: Column) -> Column:
    """Media with their position from 1, their role (the first is the cover) and their identifier."""
    return F.transform(media, lambda m, i: m.withField("position", (i + 1).cast("bigint")).withField("role", media_role(i + 1))
                       .withField("candidate_id", digest_id("image-", 20, m["url"])))


def media_role(position: Column) -> Column:
    return F.when(position == 1, "cover").otherwise("gallery")


def top_media(media: Column, n: int = MAX_MEDIA) -> Column:
    """The first n different media, filled from duplicates declared before the n-th one, with positions.

    Reading stops at the n-th different address, so later declarations neither fill
    nor count. `overflow` tells that the limit was reached.
    """
    def cut(stop: Column) -> Column:
        seen = F.filter(media, lambda m: stop.isNull() | (m["pos"] <= stop))
        return F.transform(positions(dedupe_fill(seen)), lambda m: m.withField("overflow", stop.isNotNull()))

    return let(F.get(dedupe_fill(media), F.lit(n - 1))["pos"], cut)


def page_metadata(pages: DataFrame, keep: list[str], url: str, html: str, hosts: list[str], short_hosts: list[str], home: str) -> DataFrame:
    """Title, description, author, canonical address and note id of every page, folded inside its row.

    og:url goes before the canonical link, og:title before the title element, og:description before the description. A
    canonical address counts if it leads directly to a note; `canonical_ignored` tells of one that breaks a rule.
    """
    rows = pages.select(*keep, F.col(url).alias("_url"), F.col(html).alias("_html"), markup.start_tags(F.col(html)).alias("_tags"))
    rows = rows.withColumn("_metas", markup.metas(F.col("_tags")))

    def first(*keys: str) -> Column:
        return F.coalesce(*[markup.first_of(F.col("_metas"), k) for k in keys])

    declared = F.coalesce(first("og:url"), markup.canonical_link(F.col("_tags")))
    rows = rows.withColumn("_declared", F.nullif(declared, F.lit("")))
    rows = rows.withColumns({"_page": parsed_link(F.col("_url"), hosts, short_hosts, home),
                             "_canonical": parsed_link(url_join(F.col("_url"), F.col("_declared")), hosts, short_hosts, home)})
    use = F.col("_declared").isNotNull() & F.coalesce(F.col("_canonical.kind") == "direct", F.lit(False))
    direct = F.col("_page.kind") == "direct"
    return rows.select(
        *keep, F.coalesce(first("og:title"), markup.title(F.col("_html"))).alias("title"), first("og:description", "description").alias("description"),
        first("author", "article:author").alias("author"),
        F.when(use, F.col("_canonical.normalized")).when(direct, F.col("_page.normalized")).alias("canonical_url"),
        F.when(use, F.col("_canonical.note_id")).when(direct, F.col("_page.note_id")).alias("note_id"),
        (F.col("_declared").isNotNull() & (F.col("_canonical.status") != "OK")).alias("canonical_ignored"))


def structure(known: Column, declared: Column, usable: Column, incomplete: Column, invalid: Column, duplicates: Column) -> tuple[Column, Column]:
    """Structure status and ordered diagnostic codes of a page from its counts.

    Returns (status, codes): changed, partial or matched; an invalid size turns matched into partial.
    """
    unrecognized = ~known
    unusable = known & (declared > 0) & (usable == 0)
    missing = known & (declared == 0) & (usable == 0)
    unsized = known & (usable > 0) & (incomplete > 0)
    status = (F.when(unrecognized | unusable, "changed").when(missing | unsized | (invalid > 0), "partial").otherwise("matched"))
    return status, codes((unrecognized, "UNRECOGNIZED"), (unusable, "MEDIA_UNUSABLE"), (missing, "MEDIA_MISSING"),
                         (unsized, "DIMENSIONS_MISSING"), (invalid > 0, "DIMENSIONS_INVALID"), (duplicates > 0, "DUPLICATES_COLLAPSED"))


def page_status(pages: DataFrame, keep: list[str], declared: str, media: str, known: Column) -> DataFrame:
    """Structure status of every page from its declared and its different usable media (array columns);
    `known` tells that the page has any text metadata."""
    def total(array: str, value) -> Column:
        return F.aggregate(F.transform(array, lambda m: value(m).cast("bigint")), F.lit(0).cast("bigint"), lambda acc, v: acc + v)

    rows = pages.withColumns({"_declared": F.size(declared), "candidate_count": F.size(media).cast("bigint"), "_invalid": total(declared, lambda m: m["invalid_dims"]),
                              "_duplicates": total(media, lambda m: m["n_declared"] - 1),
                              "_incomplete": F.size(F.filter(media, lambda m: m["width"].isNull() | m["height"].isNull()))})
    status, found = structure(known | (F.col("_declared") > 0), F.col("_declared"), F.col("candidate_count"),
                              F.col("_incomplete"), F.col("_invalid"), F.col("_duplicates"))
    return rows.select(*keep, "candidate_count", status.alias("status"), found.alias("diagnostic_codes"))
