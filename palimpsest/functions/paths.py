"""Paths inside packages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """Remove empty and dot segments and resolve double dots; an empty result is a dot."""
    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = (part == "..") & last.isNotNull() & (last != "..")
        return (F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
                .otherwise(F.array_append(done, part)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("."))


def part_path(owner: Column, target: Column) -> Column:
    """Part a relationship target points to, seen from the owner's folder; null where it leaves the package."""
    plain = F.regexp_extract(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), "^([^#]*)", 1)
    folder = F.regexp_extract(owner, r"^(.*)/[^/]*$", 1)
    resolved = F.when(F.startswith(plain, F.lit("/")), normal_path(F.regexp_replace(plain, "^/+", ""))).otherwise(
        normal_path(F.concat_ws("/", folder, plain)))
    return F.when((resolved != "..") & ~F.startswith(resolved, F.lit("../")), resolved)


def relationship_part(owner: Column) -> Column:
    """Name of the part that lists an owner's relationships."""
    folder, name = F.regexp_extract(owner, r"^(.*/)?[^/]*$", 1), F.regexp_extract(owner, r"([^/]*)$", 1)
    return F.concat(folder, F.lit("_rels/"), name, F.lit(".rels"))


def unsafe(path: Column) -> Column:
    return F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")
