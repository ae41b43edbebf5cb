"""Documents in blocks of bounded text, for operators that look at many documents of a task at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_CHARS = 8 << 20  # a block holds this much text, or one longer document

Block = tuple[int, list, list]  # number, ids, texts (None for null)


def cut(batches: Iterator[pd.DataFrame], chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """Blocks of the rows of a task, in their order. Columns: doc_id, text.

    A number is made of the task's partition and the place in it, so a second scan of the same
    files gives the same blocks. Readers compare what they get and fail on a difference.
    """
    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for key, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
            ids.append(None if pd.isna(key) else int(key))
            texts.append(text if isinstance(text, str) else None)
            size += len(text) if isinstance(text, str) else 0
            if size >= chars:
                yield number, ids, texts
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


def packed(docs: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, ids, sizes, texts): one row per block, its texts compressed together; size -1 stands for a null text.
    A null id is held as null; doc_id is a long here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for number, ids, texts in cut(batches, chars):
            raw = [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
            yield pd.DataFrame({"block": [number], "ids": [ids], "sizes": [[-1 if r is None else len(r) for r in raw]],
                                "texts": [press.compress(b"".join(r for r in raw if r))]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        run, "block long, ids array<long>, sizes array<int>, texts binary")


def unpacked(sizes: np.ndarray, texts: bytes) -> list[bytes | None]:
    raw = zstandard.ZstdDecompressor().decompress(texts)
    ends = np.cumsum(np.maximum(sizes, 0)).tolist()
    return [None if n < 0 else raw[e - n:e] for n, e in zip(np.asarray(sizes).tolist(), ends, strict=True)]


def carried(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): all other columns travel as JSON ahead of the text, for operators that return whole rows."""
    rest = [c for c in docs.columns if c != text]
    names = [f"c{i}" for i in range(len(rest))]
    head = F.to_json(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)])) if rest else F.lit("{}")
    mark = F.when(F.col(text).isNull(), "-").otherwise("+")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.concat(mark, F.length(head).cast("string"), F.lit(":"), head, F.coalesce(F.col(text), F.lit(""))).alias("text"))


def apart(line: str) -> tuple[str, str | None]:
    """(JSON of the other columns, text) of what `carried` has joined."""
    size, _, rest = line.partition(":")
    n = int(size[1:])
    return rest[:n], (None if size[0] == "-" else rest[n:])


def restored(rows: DataFrame, docs: DataFrame, text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `docs` from rows (head, text) and the columns `more` after them, which replace those of equal name."""
    rest = [f for f in docs.schema if f.name != text]
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rest))
    head = F.from_json("head", schema) if rest else F.lit(None)
    by_name = {f.name: F.col(f"__head.c{i}").alias(f.name) for i, f in enumerate(rest)} | {text: F.col("text").alias(text)}
    return rows.withColumn("__head", head).select(*[by_name[c] for c in docs.columns if c not in more], *more)


def parts_for(spark: SparkSession) -> int:
    """Parts that keys are dealt to by hash: as many as the session has shuffle partitions, so that they grow with the cluster's setting."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shrunk(values: np.ndarray) -> bytes:
    """An array in little space: the bytes of equal weight together, compressed."""
    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def grown(raw: bytes, kind: str) -> np.ndarray:
    """What `shrunk` was given, of a known type."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): sorted places of distinct 64-bit keys by part and value, and where each part begins."""
    part = (keys.view(np.uint64) >> np.uint64(33)) % np.uint64(parts)
    order = np.lexsort((keys, part))
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
