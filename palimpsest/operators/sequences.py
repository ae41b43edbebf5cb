"""Operator sequences on pages: signatures, counts and the resources they use."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4_096


@dataclass(frozen=True)
class Step:
    """One operator of a signature. `name` pins its operand, `bind` makes all bound operands equal."""

    ops: tuple[str, ...]
    optional: bool = False
    name: str | None = None
    bind: bool = False


# Fixed value: colour spaces set to Pattern, the same pattern for stroke and fill, then a filled rectangle.
PATTERN_FILL = (
    Step(("CS",), name="/Pattern"), Step(("cs",), name="/Pattern"), Step(("SCN",), bind=True), Step(("scn",), bind=True),
    Step(("gs",), optional=True), Step(("re",)), Step(("f", "f*")))


def alternatives(pattern: tuple[Step, ...]) -> list[list[Step]]:
    """The concrete sequences of a signature, longest first."""
    choices = [[(step,), ()] if step.optional else [(step,)] for step in pattern]
    return sorted(([s for part in combo for s in part] for combo in product(*choices)), key=len, reverse=True)


def sequence_match(ops: DataFrame, page: list[str], pattern: tuple[Step, ...] = PATTERN_FILL,
                   pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Positions where the signature starts, with its length and the bound operand.

    Rows have `op` and `name`; positions are dense. A page is cut into chunks, and each
    chunk also sees the first few rows of the next one, so a page of any size is matched
    in many tasks without losing a match across a border.
    """
    longest = len(pattern)
    if chunk < longest - 1:
        raise ValueError("a chunk must hold at least one signature less a step")
    own = F.floor(F.col(pos) / chunk)
    seen_in = F.when((F.col(pos) % chunk < longest - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = ops.select(*page, pos, "op", "name", own.alias("_own"), F.explode(seen_in).alias("_chunk"))
    window = Window.partitionBy(*page, "_chunk").orderBy(pos)
    ahead = rows.select(*page, pos, "_own", "_chunk", *[
        F.lead(F.struct("op", "name"), i).over(window).alias(f"_{i}") for i in range(longest)])
    length, bound = F.lit(None).cast("int"), F.lit(None).cast("string")
    for steps in reversed(alternatives(pattern)):
        fits, first = F.lit(True), None
        for i, step in enumerate(steps):
            cell = F.col(f"_{i}")
            fits = fits & F.coalesce(cell["op"].isin(*step.ops), F.lit(False))
            if step.name is not None:
                fits = fits & F.coalesce(cell["name"] == step.name, F.lit(False))
            if step.bind:
                fits = fits & (F.coalesce(cell["name"] == first, F.lit(False)) if first is not None else cell["name"].isNotNull())
                first = cell["name"] if first is None else first
        length = F.when(fits, len(steps)).otherwise(length)
        bound = F.when(fits, first if first is not None else F.lit(None).cast("string")).otherwise(bound)
    return (ahead.filter(F.col("_own") == F.col("_chunk"))
            .select(*page, pos, length.alias("length"), bound.alias("name")).filter("length IS NOT NULL"))


def nonoverlapping(matches: DataFrame, page: list[str], longest: int, pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Number of matches per page when they are taken from left to right without overlap.

    What a chunk does depends only on how far an earlier match reaches into it, which is
    less than the longest match. So every chunk is folded once per possible reach, in
    parallel, and only these small tables are chained along the page.
    """
    number = F.floor(F.col(pos) / chunk)
    grouped = matches.groupBy(*page, number.alias("_chunk")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(pos).alias("at"), F.col("length").alias("len")))).alias("_m"))
    start, end = F.col("_chunk") * chunk, (F.col("_chunk") + 1) * chunk

    def take(state: Column, m: Column) -> Column:
        free = m["at"] >= state["free"]
        return F.struct(F.when(free, m["at"] + m["len"]).otherwise(state["free"]).alias("free"),
                        (state["n"] + F.when(free, 1).otherwise(0)).alias("n"))

    def folded(reach: Column) -> Column:
        zero = F.struct((start + reach).cast("bigint").alias("free"), F.lit(0).cast("bigint").alias("n"))
        typed = lambda s, m: take(s, m).cast("struct<free:bigint,n:bigint>")
        return F.aggregate("_m", zero, typed, lambda s: F.struct(
            F.greatest(s["free"] - end, F.lit(0)).cast("int").alias("reach"), s["n"].alias("n")))

    maps = F.transform(F.sequence(F.lit(0), F.lit(longest - 1)), folded)
    tables = grouped.select(*page, F.col("_chunk").alias("_first"), F.col("_chunk").alias("_last"), maps.alias("_maps"))
    for level in range(1, LEVELS + 1):
        # tables of neighbouring chunks are put together in rows of at most FAN, level by level
        group = F.floor(F.col("_first") / FAN**level) if level < LEVELS else F.lit(0)
        tables = tables.groupBy(*page, group.alias("_group")).agg(
            F.sort_array(F.collect_list(F.struct("_first", "_last", "_maps"))).alias("_c")).select(*page, composed().alias("_t")).select(*page, "_t.*")
    return tables.select(*page, F.get("_maps", F.lit(0))["n"].alias("n_matches"))


FAN, LEVELS = 256, 4


def composed() -> Column:
    """The tables `_c` of consecutive spans as one: what leaves a span enters the next if that begins right after it."""
    one = "struct<_first:bigint,_last:bigint,_maps:array<struct<reach:int,n:bigint>>>"

    def both(left: Column, right: Column) -> Column:
        def through(m: Column) -> Column:
            result = F.get(right["_maps"], F.when(right["_first"] == left["_last"] + 1, m["reach"]).otherwise(0))
            return F.struct(result["reach"].alias("reach"), (m["n"] + result["n"]).alias("n"))

        return F.struct(left["_first"].alias("_first"), right["_last"].alias("_last"), F.transform(left["_maps"], through).alias("_maps")).cast(one)

    return F.aggregate(F.slice("_c", 2, 1 << 30), F.get("_c", F.lit(0)).cast(one), both)


def resolve_patterns(hits: DataFrame, resources: DataFrame, page: list[str], name: str = "name") -> DataFrame:
    """Confirmed where the page's resource list names a tiling pattern (type 1), else ambiguous."""
    known = resources.select(*page, name, "pattern_type", "object_ref")
    return hits.join(known, [*page, name], "left").withColumn(
        "classification", F.when(F.col("pattern_type") == 1, "confirmed").otherwise("ambiguous"))


def diagnostics(pages: DataFrame, resources: DataFrame, candidates: DataFrame, asset: list[str], page: str) -> DataFrame:
    """Counters per asset over its pages, their pattern resources and the found signatures."""
    p = pages.select(*asset, page).distinct().groupBy(*asset).agg(F.count(F.lit(1)).alias("pages_scanned"))
    r = resources.groupBy(*asset, page).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("pattern_type") == 1).alias("_t"))
    r = r.groupBy(*asset).agg(F.count(F.lit(1)).alias("pages_with_pattern_resources"), F.sum("_n").alias("pattern_resource_count"),
                              F.sum("_t").alias("tiling_pattern_resource_count"))
    c = candidates.groupBy(*asset).agg(
        F.count(F.lit(1)).alias("complete_signature_count"), F.count_if(F.col("classification") == "confirmed").alias("confirmed_signature_count"),
        F.count_if(F.col("classification") == "ambiguous").alias("ambiguous_signature_count"))
    return p.join(r, asset, "left").join(c, asset, "left").fillna(0)
