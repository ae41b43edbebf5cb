"""URL expressions. Splitting follows the generic URI grammar by regular expressions,
so a malformed address gives empty parts instead of failing the job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends an address inside running text, and what is cut from its end.
URL_IN_TEXT = r"""(?i)https?://[^\s<>"'，。；：！？、）》】}\)\]]+"""
TRAILING = r"""[.,;:!?，。；：！？、）》】}\)\]]+$"""
# Size limits and identifier shapes.
MAX_PAGE_URL, MAX_MEDIA_URL = 2048, 4096
NOTE_ID = r"^[A-Za-z0-9_-]{8,64}$"
SHORT_PATH = r"^/[A-Za-z0-9_./~-]{1,240}$"

GENERIC = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
AUTHORITY = r"^(?:(.*)@)?([^@:]*)(?::(.*))?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute a value once and use it many times in `body`.

    A filter on a derived column is pushed below it by substitution, which would copy
    a long expression at every use; a lambda variable is never substituted.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_url(url: Column) -> Column:
    """Struct of scheme, authority, userinfo (null if absent), host, port text, path, query with its mark."""
    return let(F.regexp_extract(url, GENERIC, 2), lambda authority: F.struct(
        F.lower(F.regexp_extract(url, GENERIC, 1)).alias("scheme"), authority.alias("authority"),
        F.when(F.contains(authority, F.lit("@")), F.regexp_extract(authority, AUTHORITY, 1)).alias("userinfo"),
        F.lower(F.regexp_extract(authority, AUTHORITY, 2)).alias("host"), F.regexp_extract(authority, AUTHORITY, 3).alias("port"),
        F.regexp_extract(url, GENERIC, 3).alias("path"), F.regexp_extract(url, GENERIC, 4).alias("query")))


def share_links(text: Column) -> Column:
    """All addresses in running text, without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(URL_IN_TEXT), F.lit(0))
    return F.transform(found, lambda link: F.regexp_replace(link, TRAILING, ""))


def share_status(links: Column) -> Column:
    return (F.when(F.size(links) == 0, "NOT_FOUND").when(F.size(links) > 1, "MULTIPLE_LINKS").otherwise("OK"))


def url_status(url: Column, allowed_hosts: list[str]) -> Column:
    """First rule an address breaks. `allowed_hosts` entries starting with a dot allow sub-domains too."""
    exact = [h for h in allowed_hosts if not h.startswith(".")]
    suffixes = [h for h in allowed_hosts if h.startswith(".")]

    def rule(p: Column) -> Column:
        known = p["host"].isin(*exact) if exact else F.lit(False)
        for suffix in suffixes:
            known = known | F.endswith(p["host"], F.lit(suffix)) | (p["host"] == suffix[1:])
        bad_port = (p["port"] != "") & ~p["port"].rlike(r"^\d{1,5}$")
        return (F.when(url.isNull() | (F.length(url) > MAX_PAGE_URL) | bad_port, "LINK_INVALID")
                .when(p["scheme"] != "https", "HTTPS_REQUIRED")
                .when(p["userinfo"].isNotNull() | ~p["port"].isin("", "443"), "LINK_INVALID")
                .when(~known, "HOST_NOT_ALLOWED").otherwise("OK"))

    return let(split_url(url), rule)


def canonical(url: Column) -> Column:
    """https, lower-case host and path; no query, fragment, port or user."""
    return let(split_url(url), lambda p: F.concat(
        F.lit("https://"), p["host"], F.when(p["path"] == "", "/").otherwise(p["path"])))


def path_id(url: Column, shapes: list[tuple[str, ...]] = (("explore",), ("item",), ("discovery", "item")),
            pattern: str = NOTE_ID) -> Column:
    """Last path segment where the segments before it have one of the given shapes, else null."""
    def rule(segments: Column) -> Column:
        last = F.try_element_at(segments, F.lit(-1))
        fits = F.lit(False)
        for shape in shapes:
            head = F.array_join(F.slice(segments, 1, len(shape)), "/")
            fits = fits | ((F.size(segments) == len(shape) + 1) & (head == "/".join(shape)))
        return F.when(fits & last.rlike(pattern), last)

    return let(F.filter(F.split(split_url(url)["path"], "/"), lambda s: s != ""), rule)


def parsed_link(url: Column, hosts: list[str], short_hosts: list[str], home: str) -> Column:
    """Struct of status, kind (direct or short), normalized address and note id of a share or page address.

    A short address needs a path of the known form; every other one must lead to a note, whose direct form stands at `home`.
    """
    def rule(p: Column) -> Column:
        path, short, note = F.when(p["path"] == "", "/").otherwise(p["path"]), p["host"].isin(*short_hosts), path_id(url)
        fits = (path != "/") & path.rlike(SHORT_PATH)
        whole = url_status(url, [*hosts, *short_hosts])
        status = (F.when(whole != "OK", whole).when(short & ~fits, "LINK_INVALID")
                  .when(~short & note.isNull(), "NOTE_PATH_UNSUPPORTED").otherwise("OK"))
        return let(F.struct(status.alias("s"), note.alias("n")), lambda c: F.struct(
            c["s"].alias("status"), F.when(c["s"] == "OK", F.when(short, "short").otherwise("direct")).alias("kind"),
            F.when(c["s"] == "OK", F.when(short, F.concat(F.lit("https://"), p["host"], path)).otherwise(
                F.concat(F.lit(home + "/explore/"), c["n"]))).alias("normalized"),
            F.when((c["s"] == "OK") & ~short, c["n"]).alias("note_id")))

    return let(split_url(url), rule)


def media_rule(url: Column, p: Column, media_host: str) -> Column:
    own = (p["host"] == media_host) | F.endswith(p["host"], F.lit("." + media_host))
    return (F.when(url.isNull() | (F.length(url) > MAX_MEDIA_URL), "MEDIA_URL_INVALID")
            .when(~p["scheme"].isin("http", "https"), "MEDIA_HTTPS_REQUIRED")
            .when(p["userinfo"].isNotNull() | (p["port"] != ""), "MEDIA_URL_INVALID")
            .when(~own, "MEDIA_HOST_NOT_ALLOWED")
            .when(p["path"].isin("", "/"), "MEDIA_URL_INVALID").otherwise("OK"))


def media_status(url: Column, media_host: str) -> Column:
    """First rule a page-declared media address breaks; http is allowed and upgraded."""
    return let(split_url(url), lambda p: media_rule(url, p, media_host))


def media_url(url: Column, media_host: str) -> Column:
    """The https form of an accepted media address, else null."""
    def rule(whole: Column) -> Column:
        return let(split_url(whole), lambda p: F.when(media_rule(whole, p, media_host) == "OK", F.concat(
            F.lit("https://"), p["host"], p["path"], F.when(p["query"] != "?", p["query"]).otherwise(""))))

    return let(url, rule)


def url_join(base: Column, ref: Column) -> Column:
    """Resolve a reference against a page address (without dot segments)."""
    def rule(p: Column) -> Column:
        origin = F.concat(p["scheme"], F.lit("://"), p["authority"])
        folder = F.regexp_extract(p["path"], r"^(.*/)[^/]*$", 1)
        folder = F.when(folder == "", "/").otherwise(folder)
        whole = F.concat(origin, p["path"])
        return (F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
                .when(F.startswith(ref, F.lit("//")), F.concat(p["scheme"], F.lit(":"), ref))
                .when(F.startswith(ref, F.lit("/")), F.concat(origin, ref))
                .when(ref == "", F.concat(whole, p["query"]))
                .when(F.startswith(ref, F.lit("?")), F.concat(whole, ref))
                .when(F.startswith(ref, F.lit("#")), F.concat(whole, p["query"], ref))
                .otherwise(F.concat(origin, folder, ref)))

    return let(split_url(base), rule)
