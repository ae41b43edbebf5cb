"""Text expressions: normalisation, names, evidence and detail strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character that counts as white space between words: ASCII and Unicode separators, file to unit separators, next line.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
# Words that make a layer name suspicious.
LEXICON = ("watermark", "draft", "confidential", "sample", "水印", "草稿", "机密")
# Fixed value: the separator between pieces of evidence.
EVIDENCE_SEPARATOR = "；"


def collapse(text: Column) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def fold(text: Column) -> Column:
    """Text for comparison without case: lower case, and ss for the sharp s."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def norm(text: Column) -> Column:
    """Case-folded, collapsed text."""
    return collapse(fold(text))


def clean(text: Column, limit: int) -> Column:
    """Collapsed text cut to `limit` characters; blank becomes null."""
    return F.nullif(F.substring(collapse(text), 1, limit), F.lit(""))


def safe_name(name: Column, default: str = "upload.bin", limit: int = 255) -> Column:
    """Last path segment without control characters or outer dots and spaces."""
    base = F.regexp_extract(F.coalesce(name, F.lit(default)), r"([^/]*)/*$", 1)
    printable = F.regexp_replace(base, r"[\x00-\x1f\x7f]+", "_")
    bare = F.regexp_replace(printable, r"^[ .]+|[ .]+$", "")
    return F.substring(F.coalesce(F.nullif(bare, F.lit("")), F.lit(default)), 1, limit)


def text_match(text: Column, target: str | None) -> Column:
    """True where the normalised target occurs in the normalised text."""
    if not target:
        return F.lit(False)
    wanted = norm(F.lit(target))
    return (F.length(wanted) > 0) & F.contains(norm(text), wanted)


def lexicon_hit(name: Column, words=LEXICON, target: str | None = None) -> Column:
    value = norm(name)
    found = F.exists(F.array(*[F.lit(w) for w in words]), lambda word: F.contains(value, word))
    return found | text_match(name, target)


def evidence(*pieces: tuple[Column, Column | str]) -> Column:
    """Join the texts whose condition holds, in the order given."""
    texts = [F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in pieces]
    return F.array_join(F.array_compact(F.array(*texts)), EVIDENCE_SEPARATOR)


def codes(*pieces: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pieces]))


def details_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))
