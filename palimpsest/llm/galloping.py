"""Alignment of two tokenizers' tokens by galloping intersection of their byte ends.

A text is encoded by a byte-level vocabulary (A, with a space ahead) and a piece vocabulary (B, which adds that space itself).
The shorter list of byte ends drives an exponential and then binary search into the longer one. Ends in both lists cut the tokens into groups,
and differences of ranks say which tokens overlap. Pairs of ids that overlap are counted once a document, inside blocks first,
and the corpus-wide counts go back to the blocks that hold the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.blocks import cut, grown, shrunk
from palimpsest.llm.bpe import loaded, pieces
from palimpsest.llm.store import kept_in_worker, written

BLOCK_CHARS = 4 << 20
BATCH_CHARS = 1 << 18  # text encoded at once, or one longer document
KNOWN = 200_000  # words a worker keeps the ids of
LONG_WORD = 64  # characters of a word that is not kept
RUN = 32  # ends of the shorter list that start from one place in the longer
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")  # neither vocabulary has a token over this place
OTHER_SPACE = re.compile(r"[^\S \n]")
SHIFT = 1 << 32  # a pair's key is its A id times this plus its B id


class Sides:
    """Both vocabularies: encoders, the bytes of every id, and their lengths."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.a = loaded(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        table = pieces(byte_path)
        self.a_bytes = [table.get(i, b"") for i in range(max(table) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        inner = any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.b_bytes)))
        self.cut = None if inner else SAFE_CUT
        self.a_of: dict[str, bytes] = {}
        self.b_of: dict[str, bytes] = {}
        self.bad: set[str] = set()  # words that one side does not give back
        self.again: set[str] = set()  # known words asked again since the last were dropped
        # an id with the mark that follows it, so that a document's groups are one join of table entries
        self.marks = [b"%d%c" % (i, m) for m in b",|" for i in range(len(self.a_bytes))] + [b"%d%c" % (i, m) for m in b",;" for i in range(len(self.b_bytes))]

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[1:-1], 16)])
        return b"" if self.b.is_control(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def words(self, text: str) -> list[str]:
        """A text with a space ahead, in words that begin with a space and are encoded alike alone and together."""
        text = " " + text
        if self.cut is None:
            return [text]
        if "\0" in text or "  " in text or " \n" in text or "\n " in text or text[-1] == " " or OTHER_SPACE.search(text):
            return self.cut.split(text)
        return text.replace(" ", "\0 ").split("\0")[1:]

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet. One is bad if its tokens do not join to it."""
        by_a = [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)]
        by_b = self.b.encode([w[1:] for w in words], num_threads=1)
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        good = np.ones(len(words), bool)
        for lists, of, table, width in ((by_a, self.a_of, self.a_bytes, self.a_size), (by_b, self.b_of, self.b_bytes, self.b_size)):
            ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
            flat = np.fromiter(chain.from_iterable(lists), "<u4", int(ends[-1]) if len(ends) else 0)
            packed, at = flat.tobytes(), (ends * 4).tolist()
            of.update(zip(words, map(packed.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True))
            total = np.concatenate([[0], np.cumsum(width[flat])])
            good &= np.diff(total[np.concatenate([[0], ends])]) == sizes
            if b"".join(map(table.__getitem__, flat.tolist())) != b"".join(raw):  # some word is another one: look at each
                good &= [b"".join(map(table.__getitem__, x)) == r for x, r in zip(lists, raw, strict=True)]
        self.bad.update(words[i] for i in np.flatnonzero(~good))

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A and by B of every text; none where a text is null, empty, or not what its tokens join to. Known words are looked up."""
        none = np.zeros(0, "<u4")
        a, b = [none] * len(texts), [none] * len(texts)
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < BATCH_CHARS:
                if texts[at]:
                    group.append((at, self.words(texts[at])))
                    size += len(texts[at])
                at += 1
            asked = set(chain.from_iterable(words for _, words in group))
            if len(self.a_of) > KNOWN:  # go on with the words that were asked again
                self.a_of, self.b_of = ({w: of[w] for w in self.again} for of in (self.a_of, self.b_of))
                self.bad &= self.again
                self.again = set()
            fresh = asked - self.a_of.keys()
            self.again |= asked - fresh
            self.learn(list(fresh))
            for i, words in group:
                if self.bad.isdisjoint(words):
                    a[i] = np.frombuffer(b"".join(map(self.a_of.__getitem__, words)), "<u4")
                    b[i] = np.frombuffer(b"".join(map(self.b_of.__getitem__, words)), "<u4")
            for w in fresh:
                if len(w) > LONG_WORD:
                    del self.a_of[w], self.b_of[w]
                    self.bad.discard(w)
        return a, b


def galloped(short: np.ndarray, long: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every value of `short` the first place in `long` with a value not below it; both ascend, and one is there.

    `first` is a place in `long` not after the one wanted. Every RUN-th value gallops from there, the others from the place
    of the value that opens their run: steps double until they pass the value, and a binary search in the last step finds it.
    All values of a round step together.
    """
    place = np.empty(len(short), np.int64)
    heads = np.arange(0, len(short), RUN)
    place[heads] = _gallop(short[heads], long, first[heads])
    place[:] = _gallop(short, long, np.maximum(first, place[heads][np.arange(len(short)) // RUN]))
    return place


def _gallop(values: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    low, step = start.copy(), np.ones(len(values), np.int64)  # all before low is below the value
    high = low.copy()
    last = len(long) - 1
    going = np.flatnonzero(long[high] < values)
    while len(going):
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step[going], last)
        step[going] *= 2
        going = going[long[high[going]] < values[going]]
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        below = long[middle] < values[going]
        low[going] = np.where(below, middle + 1, low[going])
        high[going] = np.where(below, high[going], middle)
        going = going[low[going] < high[going]]
    return low


def aligned(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a place, b place of every common end; a token, b token of every overlapping pair, in byte order) of ascending ends.

    `a_from` and `b_from` give, for every token of one side, where the other side's tokens of its text begin.
    """
    swapped = len(a_ends) > len(b_ends)
    short, long, first = (b_ends, a_ends, b_from) if swapped else (a_ends, b_ends, a_from)
    place = galloped(short, long, first)
    common = np.flatnonzero(long[place] == short)
    # tokens of `long` that end by the end of a token of `short`; those after the previous one's, with the one across, overlap
    done = place.copy()
    done[common] += 1
    begin = np.concatenate([[0], done[:-1]]) if len(done) else done
    n = place - begin + 1
    mine = np.repeat(np.arange(len(short)), n)
    other = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    return (place[common], common, other, mine) if swapped else (common, place[common], mine, other)


def _block(sides: Sides, texts: list[str | None]) -> dict:
    a, b = sides.encode(texts)
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    none = [np.zeros(0, np.int64)]
    ids_a, ids_b = (np.concatenate(side or none).astype(np.int64) for side in (a, b))
    ends_a, ends_b = np.cumsum(sides.a_size[ids_a]), np.cumsum(sides.b_size[ids_b])
    from_a, from_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    at_a, at_b, link_a, link_b = aligned(ends_a, ends_b, np.repeat(from_b, n_a), np.repeat(from_a, n_b))
    doc_a = np.repeat(np.arange(len(texts)), n_a)
    n_groups = np.bincount(doc_a[at_a], minlength=len(texts))
    # groups as text: every token goes to its place among the tokens of both sides, with the mark that follows it
    marks = np.empty(len(ids_a) + len(ids_b), np.int64)
    close_a, close_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    close_a[at_a], close_b[at_b] = True, True
    group_a, group_b = np.cumsum(close_a) - close_a, np.cumsum(close_b) - close_b
    marks[np.arange(len(ids_a)) + np.concatenate([[0], at_b + 1])[group_a]] = ids_a + close_a * len(sides.a_bytes)
    marks[np.arange(len(ids_b)) + at_a[group_b] + 1] = ids_b + close_b * len(sides.b_bytes) + 2 * len(sides.a_bytes)
    bounds = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    digest = [sha256(b"".join(map(sides.marks.__getitem__, marks[s:e].tolist()))[:-1]).hexdigest() if e > s else ""
              for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    # pairs: a document's different pairs with how often they stand in it, by their place among the block's different pairs
    pairs, index = np.unique(ids_a[link_a] * SHIFT + ids_b[link_b], return_inverse=True)
    own, times = np.unique(doc_a[link_a] * max(len(pairs), 1) + index, return_counts=True)
    doc, pair = np.divmod(own, max(len(pairs), 1))
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(doc_a[link_a], minlength=len(texts)), "groups": digest,
            "pairs": pairs, "docs": np.bincount(pair, minlength=len(pairs)), "held": np.bincount(doc, minlength=len(texts)), "pair": pair, "times": times}


PACKED = ("block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, "
          "pairs array<long>, docs array<long>, held array<long>, pair binary, times binary")


def alignment(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", chars: int = BLOCK_CHARS
              ) -> tuple[DataFrame, DataFrame]:
    """(blocks, pairs). blocks: the alignment of whole texts, a row per block. pairs: (pair, n_docs, best), a row per id pair.

    n_docs is the number of rows (documents) that hold the pair linked, best whether it is the highest of its A id, ties included. Null and
    empty texts, and texts whose tokens do not join to a space and the text, have no tokens. Equal rows and ids are documents of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = kept_in_worker(("sides", byte_path, piece_path), lambda: Sides(byte_path, piece_path))
        for number, ids, texts in cut(batches, chars):
            found = _block(sides, texts)
            yield pd.DataFrame({"block": [number], "ids": [ids], **{k: [found[k]] for k in ("n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "docs", "held")},
                                "pair": [shrunk(found["pair"].astype("<u4"))], "times": [shrunk(found["times"].astype("<u4"))]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = written(rows.mapInPandas(run, PACKED), "aligned")
    each = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.*")
    counts = written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n_docs")), "pairs")
    first = F.max("n_docs").over(Window.partitionBy(F.floor(F.col("pair") / SHIFT)))  # no more rows than B has ids
    return blocks, counts.withColumn("best", F.col("n_docs") == first)


def align(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document; see `alignment` for unusual rows.

    n_best counts the links whose pair is the best of its A id, count_sum sums the counts of their pairs over all links. An empty table gives no rows.
    """
    blocks, pairs = alignment(docs, byte_path, piece_path, doc_id, text, chars)
    asked = blocks.select(F.col("block").alias("asker"), F.explode("pairs").alias("pair"))
    answers = asked.join(pairs, "pair").groupBy("asker")  # a pair is asked once a block

    def run(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        b = block.iloc[0]
        told = told.sort_values("pair")
        if not np.array_equal(told["pair"].to_numpy(np.int64), np.asarray(b["pairs"], np.int64)):
            raise ValueError("a block's pairs without their counts")
        held = np.repeat(np.arange(len(b["held"])), b["held"])
        pair, times = grown(b["pair"], "<u4"), grown(b["times"], "<u4").astype(np.int64)
        best, total = np.zeros(len(b["held"]), np.int64), np.zeros(len(b["held"]), np.int64)
        np.add.at(best, held, times * told["best"].to_numpy(bool)[pair])
        np.add.at(total, held, times * told["n_docs"].to_numpy(np.int64)[pair])
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in b["ids"]], "Int64"),
                             **{k: b[k] for k in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": best, "count_sum": total, "groups_sha256": b["groups"]})

    return blocks.drop("docs").groupBy("block").cogroup(answers).applyInPandas(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
