"""Product codes of vectors, with codebooks found by Orchard search.

Vectors are cut into PARTS pieces, each with a codebook of ENTRIES entries. Every round assigns all pieces to their
nearest entry inside the tasks and sums them per entry; only those sums, as large as the codebooks, reach the driver. The
nearest entry is found by Orchard's walk: every entry has the list of the others by distance; a vector walks the
list of its best entry so far, jumps to the list of a better one, and stops where the list is beyond twice its distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.lookup import looked_up
from palimpsest.llm.store import written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
SAFE = 1 << 26  # components up to here have exact sums of squares in 64 bits (up to 512 a part); larger ones use Python integers

Books = list[np.ndarray]  # per part: (entries, components)


def finite(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances of every two entries, for every entry the others by distance and index)."""
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    n = len(book)
    lists = [sorted((j for j in range(n) if j != i), key=lambda j, i=i: (apart[i, j], j)) for i in range(n)]
    return apart, np.array(lists, np.int64).reshape(n, max(n - 1, 0))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of every row; ties go to the lower index. All rows walk at once."""
    apart, lists = neighbours(book)
    best = np.zeros(len(rows), np.int64)
    far = ((rows - book[0]) ** 2).sum(1)
    seen = np.zeros((len(rows), len(book)), bool)
    seen[:, 0] = True
    at = np.zeros(len(rows), np.int64)
    walking = np.arange(len(rows) if len(book) > 1 else 0)
    while len(walking):
        own = best[walking]
        next_one = lists[own, at[walking]]
        # beyond twice the distance (squared: four times) nothing can be nearer; at exactly twice it can be as near
        on = ~np.asarray(apart[own, next_one] > 4 * far[walking], bool)
        walking, next_one = walking[on], next_one[on]
        at[walking] += 1
        new = ~seen[walking, next_one]
        moving, to = walking[new], next_one[new]
        seen[moving, to] = True
        d = ((rows[moving] - book[to]) ** 2).sum(1)
        nearer = np.asarray((d < far[moving]) | ((d == far[moving]) & (to < best[moving])), bool)
        jump = moving[nearer]
        best[jump], far[jump], at[jump] = to[nearer], d[nearer], 0
        walking = walking[at[walking] < lists.shape[1]]
    return best, far


def _pieces(m: np.ndarray, parts: int) -> list[np.ndarray]:
    """The pieces of the rows of a matrix as integers; 64-bit ones where their squares fit, Python's elsewhere."""
    m = np.floor(m * SCALE)
    if np.abs(m).max(initial=0) <= SAFE and m.shape[1] <= parts * 512:
        m = m.astype(np.int64)
    else:
        m = np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.split(m, parts, axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _started(kept: DataFrame, parts: int, entries: int) -> Books:
    first = kept.orderBy("vec_id", "v").limit(entries).collect()
    return _pieces(np.array([r["v"] for r in first], np.float64), parts) if first else []


def _mixed(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (rows, book) if rows.dtype == book.dtype else (rows.astype(object), book.astype(object))


def _moved(kept: DataFrame, books: Books) -> Books:
    """Every entry as the floored mean of the pieces nearest to it; an entry without pieces stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for p, rows in enumerate(_pieces(_matrix(batch), len(books)) if batch.num_rows else []):
                code, _ = nearest(*_mixed(rows, books[p]))
                for e in np.unique(code):
                    own = rows[code == e]
                    count, sums = total.setdefault((p, int(e)), [0, [0] * rows.shape[1]])
                    total[p, int(e)] = [count + len(own), [a + int(b) for a, b in zip(sums, own.sum(0), strict=True)]]
        for (p, e), (count, sums) in total.items():
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.int32()), pa.array([e] * n, pa.int32()), pa.array(range(n), pa.int32()),
                                              pa.array([count] * n, pa.int64()), pa.array([str(x) for x in sums])],
                                             ["part", "entry", "place", "count", "total"])

    sums = kept.select("v").mapInArrow(run, "part int, entry int, place int, count long, total string")
    wide = F.sum(F.col("total").cast("decimal(38,0)")).cast("string")
    new = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("count").alias("count"), wide.alias("total")).collect():  # as many as the codebooks have components
        new[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["count"]
    return new


def codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code array<int>, error, label_error, codebooks array<array<array<long>>>) of every vector with finite components.

    Rows with a null vector or a null or non-finite component go; a repeated or null id keeps all its rows. The codebooks start
    with the `entries` smallest ids (equal ids by vector; null ids first), or as many as there are. All vectors need one length, divisible by
    `parts`; others, and distances or sums beyond a long, fail the job. label_error sums the errors of equal labels, nulls together.
    Codebooks, the only thing that reaches the driver, have entries x length components. Empty tables give no rows.
    """
    rows = vectors.where(finite(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
                                                F.col(vector).cast("array<double>").alias("v"))
    kept = written(rows, "vectors")
    sizes = kept.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if sizes["low"] is not None and (sizes["low"] != sizes["high"] or sizes["low"] % parts or not sizes["low"]):
        raise ValueError(f"vectors must have one length divisible by {parts}")
    books = _started(kept, parts, entries)
    for _ in range(rounds if books else 0):
        books = _moved(kept, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [nearest(*_mixed(rows, books[p])) for p, rows in enumerate(_pieces(_matrix(batch), parts))]
            error = [sum(int(d) for d in row) for row in zip(*[f for _, f in found], strict=True)]
            if max(error) >= 1 << 63:
                raise OverflowError("an error is beyond 64 bits")
            code = np.stack([c for c, _ in found], 1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1) * parts, pa.int32()), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists, pa.array(error, pa.int64())],
                                             ["vec_id", "label", "code", "error"])

    shape = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code array<int>, error long"
    coded = written(kept.mapInArrow(run, shape), "codes")
    by_label = written(coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "labels")
    book = F.from_json(F.lit(str([[[int(x) for x in e] for e in b] for b in books])), "array<array<array<long>>>")
    return looked_up(coded, by_label, "label", "n", coded.count()).withColumn("codebooks", book)


def digests(coded: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the result of `codes`, codes as two hexadecimal digits a part."""
    text = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    listed = F.array_join(F.flatten(F.flatten("codebooks")).cast("array<string>"), ",")
    return coded.select("vec_id", text.alias("code"), "error", "label_error", F.sha2(listed, 256).alias("codebooks_sha256"))
