"""Reversible line dedup: exact counts of documents per line, behind sharded cuckoo filters.

A store holds, per line key (128-bit hash), the exact number of documents that have it, and per shard a cuckoo
filter of the keys in at least `min_docs` documents. Documents can be inserted and deleted; each change moves only
keys that cross the threshold in or out of the filters. To clean documents, their different keys first pass
the filter of their shard, and only what passes is looked up in the exact table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.blocks import apart, carried, cut, packed, restored, unpacked
from palimpsest.llm.cuckoo import Filter
from palimpsest.llm.store import written

WHITE = b" \t\n\x0b\x0c\r"
COUNTS = "h1 long, h2 long, docs long"


def line_keys(raw: bytes, min_chars: int) -> list[bytes]:
    """The digest of every line, empty where the key has fewer than `min_chars` code points."""
    digest, out = xxhash.xxh3_128_digest, []
    for line in raw.split(b"\n"):
        key = line.strip(WHITE).lower()  # of bytes: A-Z only
        short = not key if min_chars <= 1 else len(key.decode("utf-8", "surrogatepass")) < min_chars
        out.append(b"" if short or not key else digest(key))
    return out


def _longs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def block_lines(docs: DataFrame, min_chars: int, whole_rows: bool = False) -> DataFrame:
    """(block, h1, h2, docs): the different line keys of each block and in how many of its documents each is.
    whole_rows: the texts are those of `carried`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, _, texts in cut(batches):
            seen: Counter[bytes] = Counter()
            for t in texts:
                t = apart(t)[1] if whole_rows else t
                if t:
                    seen.update(set(line_keys(t.encode("utf-8", "surrogatepass"), min_chars)))
            seen.pop(b"", None)
            if seen:
                h = _longs(list(seen))
                yield pd.DataFrame({"block": np.int64(number), "h1": h[:, 0], "h2": h[:, 1], "docs": list(seen.values())})

    return docs.select("doc_id", "text").mapInPandas(run, "block long, h1 long, h2 long, docs long")


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


@dataclass(frozen=True)
class LineStore:
    """A version of the store; insert and delete return the next one and leave this one as it is."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = 10
    min_chars: int = 1

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 64, min_docs: int = 10, min_chars: int = 1) -> LineStore:
        return cls(spark.createDataFrame([], COUNTS), spark.createDataFrame([], "shard int, filter binary"), shards, min_docs, min_chars)

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineStore:
        """Count documents in. Every row is a document; null and empty texts have one empty line, which counts nothing."""
        return self._changed(_named(docs, doc_id, text), 1)

    def delete(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineStore:
        """Take inserted documents out again; a line deleted more often than inserted fails the job."""
        return self._changed(_named(docs, doc_id, text), -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineStore:
        new = block_lines(docs, self.min_chars).select("h1", "h2", F.lit(0).cast("long").alias("old"), (F.col("docs") * sign).alias("docs"))
        old = self.counts.select("h1", "h2", F.col("docs").alias("old"), "docs")
        total = old.unionByName(new).groupBy("h1", "h2").agg(F.sum("old").alias("old"), F.sum("docs").alias("docs"))
        total = total.withColumn("docs", F.when(F.col("docs") < 0, F.raise_error(F.lit("a line deleted more often than inserted")).cast("long")).otherwise(F.col("docs")))
        total = written(total.where("docs > 0 or old > 0"), "line_counts")
        was, now = F.col("old") >= self.min_docs, F.col("docs") >= self.min_docs
        moved = total.where(was != now).select(self._shard(), "h1", now.alias("enters"), F.lit(False).alias("held"))
        left = moved.where("NOT enters").select("shard").distinct()  # their filters may have to be built anew, from all their keys
        held = total.where(now).select(self._shard(), "h1", F.lit(True).alias("enters"), F.lit(True).alias("held")).join(left, "shard", "left_semi")
        moved = moved.unionByName(held)

        def hashes(rows: pd.DataFrame) -> list[int]:
            return rows["h1"].to_numpy(np.int64).view(np.uint64).tolist()

        def run(key: tuple, was: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            one = Filter.from_bytes(was["filter"].iloc[0]) if len(was) else Filter()
            change, every = moved[~moved["held"]], moved[moved["held"]]
            if not change["enters"].all() and not one.deletable:
                one = Filter.of(hashes(every))
            else:
                for h in hashes(change[~change["enters"]]):
                    one.delete(h)
                for h in hashes(change[change["enters"]]):
                    one.insert(h)
            return pd.DataFrame({"shard": [key[0]], "filter": [one.to_bytes()]})

        filters = self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(run, "shard int, filter binary")
        return replace(self, counts=total.where("docs > 0").select("h1", "h2", "docs"), filters=written(filters, "line_filters"))

    def _shard(self) -> F.Column:
        return F.pmod(F.col("h2"), F.lit(self.shards)).cast("int").alias("shard")

    def frequent(self, keys: DataFrame) -> DataFrame:
        """Those of the keys (h1, h2; any repeats) that are in at least min_docs documents: filter first, then exact count."""
        asked = keys.select("h1", "h2").distinct().withColumn("shard", self._shard())

        def run(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(held):
                return keys.iloc[:0][["h1", "h2"]]
            one = Filter.from_bytes(held["filter"].iloc[0])
            return keys.loc[one.contains(keys["h1"].to_numpy(np.int64).view(np.uint64)), ["h1", "h2"]]

        passed = asked.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(run, "h1 long, h2 long")
        return written(passed.join(self.counts.where(F.col("docs") >= self.min_docs), ["h1", "h2"], "left_semi"), "frequent_lines")

    def clean(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """`docs` with all lines of frequent keys dropped from the text, and n_lines (before), n_dropped.

        Null and empty texts count one line, which stays; a null text comes back empty. A text of which no line stays is empty.
        Columns named n_lines or n_dropped are replaced. Documents need not be in the store. `docs` must read the same rows in
        the same order each time, as files do.
        """
        rows = carried(docs, doc_id, text)
        lines = block_lines(rows, self.min_chars, True).select("block", "h1", "h2")
        hits = lines.join(self.frequent(lines), ["h1", "h2"], "left_semi")
        min_chars = self.min_chars

        def run(block: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
            if len(block) != 1:
                raise ValueError("lines without their block: the input changed between two reads")
            b = block.iloc[0]
            pairs = hits[["h1", "h2"]].to_numpy("<i8")
            drop = {r.tobytes() for r in pairs}
            heads, kept, lines, dropped = [], [], [], []
            for line in unpacked(b["sizes"], b["texts"]):
                head, whole = apart(line.decode("utf-8", "surrogatepass"))
                heads.append(head)
                raw = (whole or "").encode("utf-8", "surrogatepass")
                keys = line_keys(raw, min_chars)
                stay = [k not in drop for k in keys]
                left = sum(stay)
                kept.append(raw if left == len(keys) else b"\n".join(x for x, s in zip(raw.split(b"\n"), stay, strict=True) if s))
                lines.append(len(keys))
                dropped.append(len(keys) - left)
            return pd.DataFrame({"head": heads, "text": [k.decode("utf-8", "surrogatepass") for k in kept], "n_lines": lines, "n_dropped": dropped})

        out = packed(rows).groupBy("block").cogroup(hits.groupBy("block")).applyInPandas(
            run, "head string, text string, n_lines long, n_dropped long")
        return restored(out, docs, text, ("n_lines", "n_dropped"))


def shards_for(rows: int) -> int:
    """Shards so that each sees some ten thousand documents' lines."""
    return max(16, -(-rows // 16384))
