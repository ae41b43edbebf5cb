"""Substring dedup by lookups of word runs against everything that comes earlier.

The reference is all earlier text, in blocks, held as an index from runs of `window` words to the place where
each first starts. Window lookups stand in for a greedy parse: every run of a document is looked up, the words of those that
start earlier go, and neighbours whose first places are consecutive are merged to spans. No span grows against reference
text, so one breaks where the first place of its runs changes. Spans have at least `window` words.

Only runs that can repeat enter the index. Every run has an anchor, the smallest hash of the GRAM-word runs
inside; equal runs have equal anchors, so runs whose anchor occurs once in all documents are left out exactly.
Blocks send each different anchor and run once, dealt to parts by hash, so a passage of every document is one entry per
block; a part answers each block in the order it was asked, so answers carry no keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.blocks import cut, dealt, grown, packed, parts_for, shrunk, unpacked
from palimpsest.llm.store import written

GRAM = 5
BLOCK_CHARS = 6 << 20  # text of a block
LAST = (1 << 63) - 1  # place of documents without an id: after all others
BASE = 0x9E3779B97F4A7C15


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Runs:
    """The word runs of a block: `at` (place in the block's words), `doc`, `start` in the document, `hash`, `anchor`."""

    def __init__(self, texts: list[bytes | None], window: int) -> None:
        known, parts = _Words(), []
        for t in texts:  # split() of bytes: [\x20\x09-\x0D]
            parts.append(np.array(list(map(known.__getitem__, (t or b"").split())), np.uint64))
        del known
        self.sizes = sizes = np.array([len(w) for w in parts], np.int64)
        total = int(sizes.sum())
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        del parts
        power = np.full(total + 1, BASE, np.uint64)
        back = np.full(total + 1, _inverse(BASE), np.uint64)
        power[0] = back[0] = 1
        power, back = np.cumprod(power), np.cumprod(back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:total])])
        gram = min(GRAM, window)

        def runs(length: int) -> np.ndarray:
            n = max(total - length + 1, 0)
            x = (sums[length:length + n] - sums[:n]) * back[:n]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(29))

        del h, power
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = np.flatnonzero(place + window <= np.repeat(sizes, sizes))
        grams = runs(gram)
        if len(inside):
            wide = window - gram + 1
            least, step = grams, 1  # minimum of `wide` neighbours, by doubling
            while step * 2 <= wide:
                least, step = np.minimum(least[:len(least) - step], least[step:]), step * 2
            anchor = np.minimum(least[inside], least[inside + wide - step])
            self.hash = runs(window)[inside].view(np.int64)
        else:
            anchor, self.hash = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.doc, self.start, self.anchor = inside, doc[inside], place[inside], anchor.view(np.int64)


def _different(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys by part and value, bounds of the parts, place of each key among them)."""
    own, place = np.unique(keys, return_inverse=True)
    order, bounds = dealt(own, parts)
    back = np.empty(len(own), np.int64)
    back[order] = np.arange(len(own))
    return own[order], bounds, back[place]


def _anchor_questions(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """(block, part, keys, twice): the different anchors of each block, and whether a run of this anchor repeats in the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, _, texts in cut(batches, BLOCK_CHARS):
            runs = Runs([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts], window)
            _, same, count = np.unique(runs.hash, return_inverse=True, return_counts=True)
            keys, bounds, place = _different(runs.anchor, parts)
            twice = np.zeros(len(keys), bool)
            twice[place[count[same] > 1]] = True
            used = np.flatnonzero(np.diff(bounds))
            yield pd.DataFrame({"block": np.int64(number), "part": used.astype(np.int32),
                                "keys": [shrunk(keys[bounds[p]:bounds[p + 1]]) for p in used],
                                "twice": [np.packbits(twice[bounds[p]:bounds[p + 1]]).tobytes() for p in used]})

    return docs.mapInPandas(run, "block long, part int, keys binary, twice binary")


def _repeated(asked: pd.DataFrame) -> pd.DataFrame:
    """(block, part, kind, a, b): for every block of a part, which of its anchors occur in another block or repeat in their own."""
    keys = [grown(k, "<i8") for k in asked["keys"]]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)).astype(bool) for k, t in zip(keys, asked["twice"], strict=True)]
    _, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    more = (count[place] > 1) | np.concatenate(twice)
    ends = np.cumsum([len(k) for k in keys])
    return pd.DataFrame({"block": asked["block"], "part": asked["part"], "kind": np.int32(0),
                         "a": [np.packbits(more[e - len(k):e]).tobytes() for k, e in zip(keys, ends.tolist(), strict=True)], "b": None})


def _first_places(asked: pd.DataFrame) -> pd.DataFrame:
    """(block, part, kind, a, b): for every block of a part, where each of its runs first starts (document, word); -1 where nowhere else."""
    runs, docs = [grown(x, "<i8") for x in asked["keys"]], [grown(x, "<i8") for x in asked["docs"]]
    starts = [grown(x, "<i4") for x in asked["starts"]]
    run, doc, start = np.concatenate(runs), np.concatenate(docs), np.concatenate(starts)
    many = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)).astype(bool) for k, t in zip(runs, asked["twice"], strict=True)])
    order = np.lexsort((start, doc, run))
    fresh = np.ones(len(run), bool)
    fresh[1:] = run[order][1:] != run[order][:-1]
    head = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    known = (np.diff(np.append(head, len(run))) > 1)[group] | many[order]
    ref_doc, ref_start = np.full(len(run), -1, np.int64), np.full(len(run), -1, np.int32)
    ref_doc[order] = np.where(known, doc[order][head][group], -1)
    ref_start[order] = np.where(known, start[order][head][group], -1)
    ends = np.cumsum([len(k) for k in runs]).tolist()
    return pd.DataFrame({"block": asked["block"], "part": asked["part"], "kind": np.int32(1),
                         "a": [shrunk(ref_doc[e - len(k):e]) for k, e in zip(runs, ends, strict=True)],
                         "b": [shrunk(ref_start[e - len(k):e]) for k, e in zip(runs, ends, strict=True)]})


def _order(ids: list) -> np.ndarray:
    return np.array([LAST if pd.isna(x) else int(x) for x in ids], np.int64)


def duplicate_spans(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed, spans): what is left of each document, its words joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes if some run of `window` words that covers it also starts earlier: in a
    document of a smaller id, or further ahead in the same one. All runs are judged on the input. spans lists the
    factors as (start, length, ref_doc, ref_start) in words; they may overlap. Null and empty texts have no words. Rows of
    a null id come after all others; rows of one id are one place and do not shorten each other. `docs` must read the
    same rows in the same order each time, as files do.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = parts_for(docs.sparkSession)
    answer = "block long, part int, kind int, a binary, b binary"
    anchors = written(_anchor_questions(docs, window, parts).groupBy("part").applyInPandas(_repeated, answer), "anchors")
    blocks = packed(docs, BLOCK_CHARS)

    def looked_up(block: pd.DataFrame, answers: pd.DataFrame) -> tuple[list, list[bytes | None], Runs, np.ndarray]:
        """(ids, texts, runs, which runs have an anchor that repeats)"""
        if len(block) != 1:
            raise ValueError("answers without their block: the input changed between two reads")
        b = block.iloc[0]
        texts = unpacked(b["sizes"], b["texts"])
        runs = Runs(texts, window)
        keys, bounds, place = _different(runs.anchor, parts)
        may = np.zeros(len(keys), bool)
        for p, bits in zip(answers["part"].tolist(), answers["a"].tolist(), strict=True):
            may[bounds[p]:bounds[p + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=bounds[p + 1] - bounds[p])
        return list(b["ids"]), texts, runs, may[place]

    def candidates(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, _, runs, may = looked_up(block, answers)
        keys, bounds, place = _different(runs.hash[may], parts)
        doc, start = _order(ids)[runs.doc[may]], runs.start[may]
        first = np.full(len(keys), -1, np.int64)  # the first place of each different run in the block
        order = np.lexsort((start, doc, place))[::-1]
        first[place[order]] = order
        many = np.bincount(place, minlength=len(keys)) > 1
        doc, start, used = doc[first], start[first].astype(np.int32), np.flatnonzero(np.diff(bounds))
        cutting = [slice(bounds[p], bounds[p + 1]) for p in used]
        return pd.DataFrame({"block": block["block"].iloc[0], "part": used.astype(np.int32), "keys": [shrunk(keys[c]) for c in cutting],
                             "docs": [shrunk(doc[c]) for c in cutting], "starts": [shrunk(start[c]) for c in cutting],
                             "twice": [np.packbits(many[c]).tobytes() for c in cutting]})

    asked = blocks.groupBy("block").cogroup(anchors.groupBy("block")).applyInPandas(
        candidates, "block long, part int, keys binary, docs binary, starts binary, twice binary")
    index = anchors.unionByName(asked.groupBy("part").applyInPandas(_first_places, answer))

    def parse(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names, texts, runs, may = looked_up(block, answers[answers["kind"] == 0])
        ids = _order(names)
        spans: list[list[dict]] = [[] for _ in texts]
        gone = [None] * len(texts)
        keys, bounds, place = _different(runs.hash[may], parts)
        if len(keys):
            ref_doc, ref_start = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
            for r in answers[answers["kind"] == 1].itertuples():
                at = slice(bounds[r.part], bounds[r.part + 1])
                ref_doc[at], ref_start[at] = grown(r.a, "<i8"), grown(r.b, "<i4")
            run_doc, run_start = runs.doc[may], runs.start[may]
            ref_doc, ref_start = ref_doc[place], ref_start[place]
            own = ids[run_doc]
            earlier = (ref_start >= 0) & ((ref_doc < own) | ((ref_doc == own) & (ref_start < run_start)))
            hit = np.flatnonzero(earlier)
            if len(hit):
                doc, start, ref_doc, ref_start = run_doc[hit], run_start[hit], ref_doc[hit], ref_start[hit]
                grows = ((doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + 1) & (ref_doc[1:] == ref_doc[:-1])
                         & (ref_start[1:] == ref_start[:-1] + 1))
                head = np.flatnonzero(np.append(True, ~grows))
                length = np.diff(np.append(head, len(hit))) + window - 1
                for d, s, n, rd, rs in zip(doc[head].tolist(), start[head].tolist(), length.tolist(),
                                           ref_doc[head].tolist(), ref_start[head].tolist(), strict=True):
                    spans[d].append({"start": s, "length": n, "ref_doc": None if rd == LAST else rd, "ref_start": rs})
                    if gone[d] is None:
                        gone[d] = np.zeros(int(runs.sizes[d]), bool)
                    gone[d][s:s + n] = True
        kept = [b" ".join((t or b"").split() if g is None else [x for x, out in zip(t.split(), g.tolist(), strict=True) if not out])
                for t, g in zip(texts, gone, strict=True)]
        return pd.DataFrame({
            "doc_id": pd.array([None if pd.isna(x) else int(x) for x in names], "Int64"),
            "text": [w.decode("utf-8", "surrogatepass") for w in kept],
            "n_words": runs.sizes, "n_removed": [0 if g is None else int(g.sum()) for g in gone], "spans": spans})

    return blocks.groupBy("block").cogroup(index.groupBy("block")).applyInPandas(
        parse, "doc_id long, text string, n_words long, n_removed long, "
               "spans array<struct<start:int,length:int,ref_doc:long,ref_start:int>>")
