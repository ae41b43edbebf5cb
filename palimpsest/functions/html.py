"""Start tags, attributes and metadata of raw HTML by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
START_TAG = r"""<[A-Za-z](?:"[^"]*"|'[^']*'|[^'">])*>"""
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
# The five XML entities, the ampersand last so that it is decoded once.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def visible(html: Column) -> Column:
    """Markup without scripts, styles and comments."""
    return F.regexp_replace(html, HIDDEN, "")


def decode(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def title(html: Column) -> Column:
    text = F.regexp_replace(decode(F.regexp_extract(html, TITLE, 1)), r"^\s+|\s+$", "")
    return F.nullif(text, F.lit(""))


def start_tags(html: Column) -> Column:
    """All start tags in document order."""
    return F.regexp_extract_all(visible(html), F.lit(START_TAG), F.lit(0))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^<([A-Za-z][A-Za-z0-9]*)", 1))


def attribute(tag: Column, name: str) -> Column:
    """Decoded attribute value, null where the attribute is missing."""
    form = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = F.concat(*[F.regexp_extract(tag, form, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(form), decode(found))


def meta_key(tag: Column) -> Column:
    """Lower-case property or name of a meta tag."""
    key = F.coalesce(F.nullif(attribute(tag, "property"), F.lit("")), attribute(tag, "name"))
    return F.when(tag_name(tag) == "meta", F.lower(key))


def metas(tags: Column) -> Column:
    """(key, content) of the meta tags among start tags, in document order; only those with both."""
    pairs = F.transform(F.filter(tags, lambda t: tag_name(t) == "meta"), lambda t: F.struct(
        meta_key(t).alias("key"), F.trim(F.coalesce(attribute(t, "content"), F.lit(""))).alias("content")))
    return F.filter(pairs, lambda m: (m["key"] != "") & (m["content"] != ""))


def first_of(pairs: Column, key: str) -> Column:
    """Content of the first meta tag with a key, null without one."""
    return F.get(F.filter(pairs, lambda m: m["key"] == key), F.lit(0))["content"]


def canonical_link(tags: Column) -> Column:
    """Address of the last link tag that calls itself canonical."""
    def canonical(t: Column) -> Column:
        rel = F.split(F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))), r"\s+")
        return (tag_name(t) == "link") & F.array_contains(rel, "canonical")

    return attribute(F.element_at(F.concat(F.array(F.lit("")), F.filter(tags, canonical)), -1), "href")
