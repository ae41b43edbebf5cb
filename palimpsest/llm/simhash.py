"""SimHash fingerprints, linked through sharded BK-trees.

Fingerprints are dealt to shards by block keys: of BLOCKS blocks at least BLOCKS - radius are
equal between linked fingerprints, so each pair of blocks is a key and every link meets in a shard.
A shard's tree is built where the shard's rows are; it is searched along edges within the radius only.
A shard above CHUNK rows is cut into chunks, and each pair of chunks is a shard of its own, one
chunk the tree and the other its queries. That bounds memory and spreads a hot key without losing a link.
Links leave a shard as stars around the smallest member of each of its groups, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bktree import Forest
from palimpsest.llm.blocks import apart, carried, cut, packed, restored, unpacked
from palimpsest.llm.components import components
from palimpsest.llm.store import written

CHUNK = 1024  # rows of a tree, and of its queries
BLOCKS = 6
SEED = 42
SIGN = np.uint64(1 << 63)


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of `words` words, repeats included; fewer words make one shingle, none make none."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and [\x20\x09-\x0D]
    if not raw:
        return np.zeros(0, np.uint64)
    line, size = b" ".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    ends = ends[min(words, len(raw)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if more than half the hashes have it set; no hashes give zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 4, out: str = "fp") -> DataFrame:
    """`docs` without the text and with the fingerprint as a signed long."""
    schema = docs.drop(text).withColumn(out, F.lit(0).cast("long")).schema
    keep = [f.name for f in schema][:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = [fingerprint(shingles(t, words)) for t in batch[text]]
            yield batch[keep].assign(**{out: np.array(prints, np.uint64).view(np.int64)})

    return docs.mapInPandas(run, schema)


def block_keys(fp: str, radius: int) -> F.Column:
    """The shard keys of a fingerprint: every choice of BLOCKS - radius of its blocks, or pairs at radius 4."""
    if not 0 <= radius < BLOCKS:
        raise ValueError("block keys serve radii below the number of blocks")
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    part = [F.shiftrightunsigned(F.col(fp), cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(BLOCKS)]
    return F.array(*[F.xxhash64(F.lit(n), *[part[i] for i in chosen])
                     for n, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius))])


def _pairs_of(shard: np.ndarray, probe: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """Row numbers (query, node) within the radius in the same shard; a shard without probes is searched by its own rows."""
    ids, dense = np.unique(shard, return_inverse=True)
    asks = np.zeros(len(ids), bool)
    asks[dense[probe]] = True
    tree_rows = np.flatnonzero(~probe)
    query_rows = np.flatnonzero(probe | ~asks[dense])
    # rows of the same shard and fingerprint share a node
    order = tree_rows[np.lexsort((prints[tree_rows], dense[tree_rows]))]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (dense[order][1:] != dense[order][:-1]) | (prints[order][1:] != prints[order][:-1])
    first = np.flatnonzero(fresh)
    width = np.diff(np.append(first, len(order)))
    forest = Forest(dense[order][first], prints[order][first])
    size = np.bincount(dense[order][first], minlength=len(ids))
    turn = np.cumsum(size[dense[query_rows]]) // (CHUNK * CHUNK // 2)  # bounds the search front
    found = [(rows[q], n, d) for rows in (query_rows[turn == t] for t in np.unique(turn))
             for q, n, d in [forest.search(dense[rows], prints[rows], radius)]]
    query, node, d = (np.concatenate(x) for x in zip(*found, strict=True))
    many = width[node]
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(query, many), order[np.repeat(first[node], many) + step], np.repeat(d, many)


class Links:
    """Groups of row numbers, joined one by one; the smallest row number is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _jaccard(sets: list[np.ndarray], one: int, others: list[int]) -> np.ndarray:
    """The Jaccard similarity of one sorted set of distinct hashes to each of the others."""
    sizes = np.array([len(sets[x]) for x in others], np.int64)
    joined = np.concatenate([sets[x] for x in others])
    mine = sets[one]
    at = np.minimum(np.searchsorted(mine, joined), max(len(mine) - 1, 0))
    hits = mine[at] == joined if len(mine) else np.zeros(len(joined), bool)
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(hits)])
    both = total[ends] - total[ends - sizes]
    return both / np.maximum(len(mine) + sizes - both, 1)


def _grouped(query: np.ndarray, node: np.ndarray, d: np.ndarray, n: int, sets: list[np.ndarray] | None, least: float) -> Links:
    """Join the pairs; with sets, only those of enough similarity, and only between groups that are still apart."""
    links = Links(n)
    apart = query != node
    query, node, d = query[apart], node[apart], d[apart]
    if sets is None:
        for x, y in zip(query.tolist(), node.tolist(), strict=True):
            links.join(x, y)
        return links
    order = np.lexsort((d, query))
    query, node = query[order], node[order]
    bounds = np.flatnonzero(np.diff(query, prepend=-1, append=-1)) if len(query) else np.zeros(1, np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        one, near = int(query[a]), node[a:b].tolist()
        while near:  # nearest first, in growing turns; a link found makes the rest of its group needless
            turn, near = near[:64], near[64:]
            turn = [x for x in turn if links.root(x) != links.root(one)]
            if turn:
                for x, s in zip(turn, _jaccard(sets, one, turn), strict=True):
                    if s >= least:
                        links.join(one, x)
    return links


def shard_links(rows: DataFrame, radius: int, least: float | None = None) -> DataFrame:
    """Links (a, b) that connect what lies within the radius in a shard, directly or through other rows of it.

    rows: (key long, fp long, node long) and, if `least` is given, (hashes array<int>), the sorted distinct
    shingle hashes; a link then also needs this Jaccard similarity.
    """
    return _in_shards(rows, radius, least, False)


def _in_shards(rows: DataFrame, radius: int, least: float | None, rows_only: bool) -> DataFrame:
    crowded = rows.groupBy("key").count().where(F.col("count") > CHUNK).select(
        "key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    crowded = written(crowded, "crowded")
    chunks = F.coalesce(F.col("chunks"), F.lit(1))
    own = F.pmod(F.xxhash64("node", F.lit(7)), chunks).cast("int")
    dealt = rows.join(crowded, "key", "left").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn(
        "shard", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).withColumn(
        "probe", F.col("own") > F.col("other"))
    columns = ["shard", "probe", "fp", "node"] + (["key"] if rows_only else []) + (["hashes"] if least is not None else [])
    dealt = dealt.select(*columns).repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            last = batch["shard"].iloc[-1] if len(batch) else None
            if last is None or (batch["shard"].iloc[0] == last and (not held or held[-1]["shard"].iloc[-1] == last)):
                held.append(batch)
                continue
            cut = int(np.searchsorted(batch["shard"].to_numpy(), last))
            yield from solved(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
            held = [batch.iloc[cut:]]
        if held:
            yield from solved(pd.concat(held, ignore_index=True))

    def solved(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        shard = part["shard"].to_numpy()
        if not len(shard):
            return
        _, dense, size = np.unique(shard, return_inverse=True, return_counts=True)
        part = part[size[dense] > 1].reset_index(drop=True)
        shard = part["shard"].to_numpy()
        if not len(shard):
            return
        edges = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
        work = np.concatenate([[0], np.cumsum(np.diff(edges) ** 2)])
        at = 0
        while at < len(edges) - 1:  # whole shards, about CHUNK * CHUNK pairs at a time
            stop = max(int(np.searchsorted(work, work[at] + CHUNK * CHUNK, "right")) - 1, at + 1)
            piece = part.iloc[int(edges[at]):int(edges[stop])]
            at = stop
            prints = piece["fp"].to_numpy().view(np.uint64)
            query, node, d = _pairs_of(piece["shard"].to_numpy(), piece["probe"].to_numpy().astype(bool), prints, radius)
            if rows_only:
                apart = query != node
                both = np.unique(np.concatenate([query[apart], node[apart]]))
                yield piece.iloc[both][["key", "fp", "node"]]
                continue
            sets = [np.asarray(x) for x in piece["hashes"]] if least is not None else None
            links = _grouped(query, node, d, len(piece), sets, least or 0.0)
            root = np.array([links.root(x) for x in range(len(piece))])
            moved = np.flatnonzero(root != np.arange(len(piece)))
            names = piece["node"].to_numpy()
            if len(moved):
                yield pd.DataFrame({"a": names[moved], "b": names[root[moved]]})

    return dealt.mapInPandas(run, "key long, fp long, node long" if rows_only else "a long, b long").distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints differ in at most `radius` bits are linked.

    Null and empty texts have no word and fingerprint zero, which links like any other. Repeated
    rows each return a row; equal fingerprints are one node, so copies never make pairs.
    component_id is the smallest non-null id reachable (null if all are null). Further columns are not returned.
    """
    prints = written(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    rows = nodes.select(F.explode(block_keys("fp", radius)).alias("key"), "fp", F.col("fp").alias("node"))
    group = components(shard_links(rows, radius))
    named = nodes.join(group.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named, "named")
    component = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    by_print = written(named.join(component, "root").select("fp", "component_id"), "by_print")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


KEYS = 6  # shard keys of a document by its shingle set: a pair of similarity s shares none with chance (1 - s) ** KEYS
WIDE = 26  # bits in which fingerprints of sets at a similarity of 0.8 may differ: above it 1.3e-5 of pairs of 4 and 5 shingles, 7e-7 of 12 and more
TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)


def _set_keys(shingle_set: np.ndarray) -> list[int]:
    """The smallest hash of the set under each of KEYS orders."""
    return [xxhash.xxh64_intdigest(np.uint64((t := shingle_set * turn)[int(np.argmin(t ^ (t >> np.uint64(29))))]).tobytes(), n) - (1 << 63)
            for n, turn in enumerate(TURNS)] if len(shingle_set) else [0]


def _short(shingle_set: np.ndarray) -> np.ndarray:
    """Sorted distinct 32-bit halves of the hashes."""
    return np.unique((shingle_set >> np.uint64(32)).astype(np.uint32).view(np.int32))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8,
                radius: int = WIDE) -> DataFrame:
    """(block, at, doc_id, root): every row of `docs` by its place, and the group of near copies it is in.

    Texts of the same word sequence are one node. Nodes are dealt to shards by the smallest hashes of their sets of word
    shingles, the BK-tree of a shard finds fingerprints of the sets within the radius, and pairs found are kept if the Jaccard similarity
    of their sets is high enough. Null and empty texts are one node without links. `docs` must read the same rows in the same order each time.
    """
    rows = carried(docs, doc_id, text)

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, ids, texts in cut(batches):
            out = []
            for at, (name, line) in enumerate(zip(ids, texts, strict=True)):
                hashes = shingles(apart(line)[1], words)
                same, one = xxhash.xxh64_intdigest(hashes.tobytes(), len(hashes)) - (1 << 63), np.unique(hashes)
                out.append((number, at, name, same, int(np.uint64(fingerprint(one)).view(np.int64)), _set_keys(one), len(hashes)))
            frame = pd.DataFrame(out, columns=["block", "at", "doc_id", "node", "fp", "keys", "n"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    every = written(rows.mapInPandas(prints, "block long, at int, doc_id long, node long, fp long, keys array<long>, n int"), "near_prints")
    nodes = written(every.where("n > 0").groupBy("node").agg(F.min_by(F.struct("block", "at", "fp", "keys"), F.struct("block", "at")).alias("x"))
                    .select("node", "x.*"), "near_nodes")
    dealt = nodes.select("node", "fp", F.explode("keys").alias("key"))
    near = written(shard_matches(dealt, radius), "near")
    wanted = nodes.join(near.select("node").distinct(), "node", "left_semi").select("block", "at", "node")

    def sets(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted):
            return pd.DataFrame({"node": [], "hashes": []})
        b = block.iloc[0]
        texts = unpacked(b["sizes"], b["texts"])
        found = [_short(np.unique(shingles(apart(texts[at].decode("utf-8", "surrogatepass"))[1], words))) for at in wanted["at"]]
        return pd.DataFrame({"node": wanted["node"].to_numpy(), "hashes": found})

    blocks = packed(rows)
    with_sets = blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(sets, "node long, hashes array<int>")
    links = shard_links(near.join(with_sets, "node"), radius, similarity)
    return every.join(components(links), "node", "left").select("block", "at", "doc_id", F.coalesce("root", "node").alias("root"))


def shard_matches(rows: DataFrame, radius: int) -> DataFrame:
    """Those of the rows (key, fp, node) that have another fingerprint within the radius in their shard."""
    return _in_shards(rows, radius, None, True)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each group of near copies: that of the smallest id (null ids last), then the first by place."""
    groups = near_groups(docs, doc_id, text, words, similarity)
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "block", "at")
    kept = groups.groupBy("root").agg(F.min(first).alias("x")).select("x.block", "x.at")

    def run(block: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if not len(kept):
            return pd.DataFrame({"head": [], "text": []})
        b = block.iloc[0]
        texts = unpacked(b["sizes"], b["texts"])
        parts = [apart(texts[at].decode("utf-8", "surrogatepass")) for at in sorted(kept["at"])]
        return pd.DataFrame({"head": [h for h, _ in parts], "text": [t for _, t in parts]})

    out = packed(carried(docs, doc_id, text)).groupBy("block").cogroup(kept.groupBy("block")).applyInPandas(run, "head string, text string")
    return restored(out, docs, text)
