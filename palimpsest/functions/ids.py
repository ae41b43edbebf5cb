"""Content-addressed identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(n: int, *parts: Column) -> Column:
    """First `n` hex digits of the SHA-256 of the parts joined with a bar.
    A null part is written as None, so it still takes its place."""
    texts = [F.coalesce(part.cast("string"), F.lit("None")) for part in parts]
    return F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, n)


def digest_id(prefix: str, n: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), digest(n, *parts))


def transform_id(page: Column, width: Column, height: Column, rotation: Column,
                 crop_x: Column, crop_y: Column) -> Column:
    """Identifier of a page coordinate frame; lengths carry six decimals."""
    text = F.format_string("%s|%.6f|%.6f|%s|%.6f|%.6f", page.cast("string"),
                           width.cast("double"), height.cast("double"), rotation.cast("string"),
                           crop_x.cast("double"), crop_y.cast("double"))
    return F.substring(F.sha2(text, 256), 1, 24)


def pseudonym(code: Column, protocol: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(protocol + ":"), F.trim(code)), 256), 1, 16)
