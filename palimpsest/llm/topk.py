"""Exact top-k inner products: tiled matrix products of query blocks and candidate shards.

Vectors are packed into query blocks and candidate shards of bounded size. Every (block, shard)
pair is a tile of its own key, so tiles spread over all tasks; a tile keeps its own top k per query,
and the lists are merged in a tree of fan-in FAN. No score leaves a tile but those k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.store import written

QUERY_BLOCK = 2048
SHARD = 8192
STRIP = 256  # queries of a tile multiplied at once
FAN = 16


def scaled(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): components as floor(scale * x); rows with a null id, a null vector or a null or non-finite component go; an empty vector stays and scores 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of one length (shorter vectors are filled with zeros), in the smallest integer type that holds them."""
    width = max((len(x) for x in vectors), default=0)
    out = np.zeros((len(vectors), width), np.float64)
    for i, x in enumerate(vectors):
        out[i, :len(x)] = x
    top = np.abs(out).max(initial=0)
    return out.astype(np.int8 if top < 128 else np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64)


def _packed(rows: DataFrame, part: str) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        m = _matrix(group["v"])
        return pd.DataFrame({part: group[part].iloc[:1].to_numpy(), f"{part}_ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
                             f"{part}_type": [m.dtype.str], f"{part}_rows": [m.tobytes()]})

    return rows.groupBy(part).applyInPandas(run, f"{part} int, {part}_ids binary, {part}_type string, {part}_rows binary")


def _tile_top(own: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query ids, candidate ids, scores) of the k best candidates of each query; ids are ascending, ties go to the smaller."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width].astype(np.float64), c[:, :width].astype(np.float64)
    exact = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(width, 1) < 2**53
    across = c.T if exact else c.T.astype(object)
    for at in range(0, len(own), STRIP):
        names = own[at:at + STRIP]
        part = q[at:at + STRIP]
        score = part @ across if exact else np.array([[int(s) for s in row] for row in part.astype(object) @ across], object).reshape(len(part), -1)
        allowed = ids[None, :] != names[:, None]
        if exact:
            score[~allowed] = -np.inf
            n = score.shape[1]
            floor = np.partition(score, n - k, axis=1)[:, n - k:n - k + 1] if n > k else np.full((len(names), 1), -np.inf)
            above, level = score > floor, (score == floor) & allowed
            chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)))
        else:
            chosen = np.zeros(score.shape, bool)
            for i in range(len(names)):
                best = sorted(np.flatnonzero(allowed[i]).tolist(), key=lambda j: (-score[i, j], j))[:k]
                chosen[i, best] = True
        row, col = np.nonzero(chosen)
        yield names[row], ids[col], score[row, col].astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
          scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with every other row.

    Vectors of different length are compared over the shorter length. A repeated id keeps all its rows as candidates
    and is one query (of its smallest vector); rows of the query's own id are not candidates. Ties go to the
    smaller vec_id. Scores beyond a long fail the job. Empty tables give an empty result.
    """
    rows = written(scaled(vectors, vec_id, vector, scale), "vectors")
    asks = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = rows.count(), asks.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // QUERY_BLOCK))

    def part(count: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(count)).cast("int")

    tiles = _packed(rows.withColumn("shard", part(shards, 1)), "shard").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    questions = _packed(asks.withColumn("block", part(blocks, 2)), "block").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                own, ids = np.frombuffer(t.block_ids, np.int64), np.frombuffer(t.shard_ids, np.int64)
                q = np.frombuffer(t.block_rows, t.block_type).reshape(len(own), -1)
                c = np.frombuffer(t.shard_rows, t.shard_type).reshape(len(ids), -1)
                for query, found, score in _tile_top(own, q, ids, c, k):
                    yield pd.DataFrame({"query_id": query, "vec_id": found, "score": score, "part": np.int32(t.shard)})

    tops = questions.join(tiles, ["block", "shard"]).mapInPandas(run, "query_id long, vec_id long, score long, part int")
    order = [F.desc("score"), F.asc("vec_id")]
    while shards > FAN:
        shards = -(-shards // FAN)
        tops = (tops.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
                .withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order)))
                .where(F.col("rank") <= k).drop("rank"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return tops.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
