"""Language identification by compression with per-language zstandard raw-content dictionaries.

The words of a text (its letters, lower-cased) are compressed with each language's dictionary in pieces of PIECE_BYTES, each with
the fresh dictionary, because a frame forgets the dictionary after its window; the smallest sum over all pieces wins. The
relative distance to the runner-up is the score; a text below MARGIN is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.store import kept_in_worker

PIECES, PIECE_CHARS = 512, 2048  # of labelled text per language: the bound of the learning sample
LEVEL = 3
PIECE_BYTES = 1 << 12  # of a text compressed at a time; longer pieces repeat their own words and narrow the margin
MARGIN = 0.001
LETTERS = re.compile(r"[^\W\d_]+")  # with numerals such as a raised two, which are no letters and go below


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", pieces: int = PIECES, piece_chars: int = PIECE_CHARS) -> dict[str, bytes]:
    """Dictionary content per language: at most `pieces` texts, the first of each hash bucket, cut at `piece_chars`.

    Rows with a null or empty text or a null language teach nothing. The result is as large as
    languages x pieces x piece_chars at most, whatever the size of the table.
    """
    digest = F.xxhash64(F.col(text))
    sample = (rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0))
              .groupBy(F.col(lang).alias("lang"), F.pmod(digest, F.lit(pieces)).alias("bucket"))
              .agg(F.min_by(F.substring(F.col(text), 1, piece_chars), digest).alias("piece")))
    found: dict[str, list[str]] = {}
    for r in sorted(sample.collect()):
        found.setdefault(r["lang"], []).append(r["piece"])
    return {k: b"\n".join(map(letters, v)) for k, v in sorted(found.items())}


def letters(text: str) -> bytes:
    """The runs of letters of a text, lower-cased, with one space between them."""
    runs = LETTERS.findall(text.lower())
    own = [r if r.isalpha() else "".join(filter(str.isalpha, r)) for r in runs]
    return " ".join(filter(None, own)).encode("utf-8", "surrogatepass")


def identify(docs: DataFrame, content: dict[str, bytes], text: str = "text", prefix: str = "lang_", margin: float = MARGIN) -> DataFrame:
    """`docs` with {prefix}pred, {prefix}score (0 to 1) and {prefix}rejected.

    Texts that are null or have no letter are `und` with score 0 and rejected. Equal sizes go to the
    first language by name, with score 0. With no language learned every text is `und`.
    Columns of these names in `docs` are replaced.
    """
    names = list(content)
    out = [f"{prefix}pred", f"{prefix}score", f"{prefix}rejected"]
    base = docs.drop(*out)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        presses = kept_in_worker(("langid", hash(tuple(content.items()))), lambda: [
            _press(content[k]) for k in names])
        for texts in batches:
            rows = []
            for t in texts:
                raw = letters(t) if isinstance(t, str) else b""
                if not raw or not presses:
                    rows.append(("und", 0.0, True))
                    continue
                parts = [raw[at:at + PIECE_BYTES] for at in range(0, len(raw), PIECE_BYTES)]
                sizes = [sum(len(p.compress(x)) for x in parts) for p in presses]
                best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
                second = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] * 2)
                score = min(1.0, (second - sizes[best]) / max(second, 1))
                rows.append((names[best], score, score < margin))
            yield pd.DataFrame(rows, columns=["pred", "score", "rejected"])

    label = F.pandas_udf(run, "pred string, score double, rejected boolean")
    guess = base.withColumn("__guess", label(F.col(text)))
    return guess.select(*base.columns, *[F.col(f"__guess.{n}").alias(o) for n, o in zip(("pred", "score", "rejected"), out, strict=True)])


def _press(content: bytes) -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
