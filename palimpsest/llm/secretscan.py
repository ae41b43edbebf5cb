"""Secret scan with corpus-wide ownership frequency, in Spark SQL functions only.

Base patterns find named assignments, access keys and hexadecimal digests in every text. Values found by them, and long tokens
of mixed characters anywhere, are hashed and counted by distinct repositories and distinct owners. A value of many owners is
a widely copied example; one that stays with its owner looks like a live credential. Tokens outside
the base patterns become spans if their value is an owner's own and either is assigned to a name somewhere in the corpus or
looks random by itself. Base spans stay whatever the counts say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.lookup import looked_up
from palimpsest.llm.store import written

OWNERS = 2  # a value with more owners is an example
REPOSITORIES = 20  # a value of two owners in more repositories is an example too
SHORTEST = 16  # characters of a token outside the base patterns
DIFFERENT = 8  # different characters of a token that is no placeholder
BLOCK = 64  # lengths summed at once

#: The kinds in their order, and the patterns of the base kinds.
KINDS = ("assign", "access", "hex", "copy", "opaque")
NAMES = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(?:password|passwd|secret|token|api_?key)")  # letters in either case
HEAD = NAMES + r"""["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGN = f"{HEAD}{VALUE}+"
ACCESS = "AKIA[A-Z0-9]{16,}"  # runs are taken whole, so the shorter ones need not be matched first
HEX = "[0-9a-f]{24,}"
ASSIGNED = 6  # characters of an assigned value
TOKEN = f"{VALUE}{{{SHORTEST},}}"
APART = f"(?:{ASSIGN})|(?:{TOKEN})"  # an assignment met first takes its value with it


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, although it stands in it several times."""
    return F.get(F.transform(F.array(value), body), 0)


def running(numbers: Column) -> Column:
    """The running totals of an array of numbers: by blocks, so that long arrays do not cost their square."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def blocks(n: Column) -> Column:
        last = F.floor((F.size(n) - 1) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
        return let(sums, lambda s: F.transform(s, lambda x, b: total(F.slice(s, F.lit(1), b))))

    def within(n: Column, before: Column) -> Column:
        block = lambda i: F.floor(i / BLOCK).cast("int")
        return F.transform(n, lambda x, i: F.get(before, block(i)) + total(F.slice(n, block(i) * BLOCK + 1, i % BLOCK + 1)))

    def whole(n: Column) -> Column:
        return let(F.struct(n.alias("n"), blocks(n).alias("before")), lambda s: within(s["n"], s["before"]))

    return F.when(F.size(numbers) > 0, let(numbers, whole)).otherwise(F.array().cast("array<int>"))


def matches(text: str, pattern: str) -> Column:
    """array<struct<start, end, found>>: the leftmost non-overlapping matches of a pattern, by code points, end exclusive."""

    def placed(s: Column) -> Column:
        steps = F.transform(s["found"], lambda f, i: F.length(F.get(s["gaps"], i)) + F.length(f))
        return let(F.struct(running(steps).alias("ends"), s["found"].alias("found")), lambda e: F.transform(
            e["found"], lambda f, i: F.struct((F.get(e["ends"], i) - F.length(f)).alias("start"), F.get(e["ends"], i).alias("end"), f.alias("found"))))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(F.col(text).rlike(pattern), let(both, placed)).otherwise(none)


def _shaped(found: Column, kind: int, value: Callable[[Column], Column]) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), value(s["found"]).alias("value")))


def base_spans(text: str) -> Column:
    """array<struct<start, kind, end, value>> of the base patterns, by start and kind; kind is the place in KINDS."""
    named = _shaped(matches(text, ASSIGN), 0, lambda f: F.regexp_extract(f, f"^{HEAD}({VALUE}+)", 1))
    named = F.filter(named, lambda s: F.length(s["value"]) >= ASSIGNED)
    return F.array_sort(F.concat(named, _shaped(matches(text, ACCESS), 1, lambda f: f), _shaped(matches(text, HEX), 2, lambda f: f)))


def other_tokens(text: str) -> Column:
    """array<struct<start, kind, end, value>> of tokens that no base pattern finds; kind 4 looks random by itself, 3 does not."""
    base = f"{ASSIGN}|{ACCESS}|{HEX}"
    mixed = F.filter(matches(text, APART), lambda s: ~s["found"].rlike(base) & s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]")
                     & (F.size(F.array_distinct(F.split(s["found"], ""))) >= DIFFERENT))
    return F.transform(mixed, lambda s: F.struct(
        s["start"].alias("start"), F.when(s["found"].rlike("[A-Z]") & s["found"].rlike("[a-z]") & (F.length(s["found"]) >= 20), 4).otherwise(3).alias("kind"),
        s["end"].alias("end"), s["found"].alias("value")))


def listed(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_rows, n_owners, n_repositories, named, verdict) of rows (hash, kind, owner, repository).

    Owners and repositories are counted in combinable steps, so a value that a third of all rows hold is counted inside the tasks
    first. A null owner or repository is one like others; a repository is of one owner, equal names of two owners are two.
    """
    repos = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n_rows"), F.max(F.col("kind") == 0).alias("named"))
    owners = repos.groupBy("hash", "owner").agg(F.sum("n_rows").alias("n_rows"), F.max("named").alias("named"), F.count("*").alias("n_repositories"))
    values = owners.groupBy("hash").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_owners"),
                                        F.sum("n_repositories").alias("n_repositories"), F.max("named").alias("named"))
    copied = (F.col("n_owners") > OWNERS) | ((F.col("n_owners") > 1) & (F.col("n_repositories") > REPOSITORIES))
    return values.withColumn("verdict", F.when(copied, "example").otherwise("live"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans, n_live, n_example): the spans of every whole text, with and without those that ownership adds.

    A span is (start, kind, end, hash) in code points; base are the fixed patterns' own, spans all of them, by start and kind. n_live and n_example
    count all spans and the base spans by the verdict on their value (a placeholder of few different characters is an example).
    Null and empty texts have no spans. Every row gives a row: equal rows, null and repeated ids stay apart. Empty tables give none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(owner).alias("owner"),
                       F.col(repository).alias("repository"))

    def hashed(spans: Column) -> Column:
        few = lambda v: F.size(F.array_distinct(F.split(v, ""))) < DIFFERENT
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                                                     F.sha2(s["value"], 256).alias("hash"), few(s["value"]).alias("few")))

    found = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", hashed(base_spans("text")).alias("base"),
                        hashed(other_tokens("text")).alias("more"))
    found = written(found, "spans")
    some = found.where((F.size("base") > 0) | (F.size("more") > 0))
    spans = written(some.select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("span")).select(
        "row", "owner", "repository", "span", F.col("span.hash").alias("hash"), F.col("span.kind").alias("kind")), "values")
    values = written(ownership(spans), "ownership")
    judged = looked_up(spans.select("row", "span", "hash"), values.select("hash", "n_rows", "named", "verdict"), "hash", "n_rows", spans.count())
    kind = F.col("span.kind")
    live = (F.col("verdict") == "live") & ~F.col("span.few")
    added = (kind >= 3) & live & ((kind == 4) | F.col("named"))
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when(added, F.col("span"))).alias("added"),  # no more than a text holds
        F.sum(F.when(live & ((kind < 3) | added), 1).otherwise(0)).alias("n_live"), F.sum(F.when(~live & (kind < 3), 1).otherwise(0)).alias("n_example"))
    out = found.select("row", "doc_id", "base").join(by_row, "row", "left")
    none = F.array().cast(found.schema["base"].dataType)

    def plain(s: Column) -> Column:
        return F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["hash"].alias("hash")))

    return out.select("doc_id", plain(F.col("base")).alias("base"), plain(F.array_sort(F.concat("base", F.coalesce("added", none)))).alias("spans"),
                      F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) of the result of `scan`."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), "n_live", "n_example")
