"""Byte-level BPE through a table of distinct words.

Documents are cut into blocks; a block sends each of its different words once, dealt to parts by hash. A part is a piece
of the table of distinct words: each word is encoded once, and its ids are joined to the vocabulary's pieces, a table of
bounded size, to decode it again. Ids and pieces go back to the blocks in the order asked and are put in place by position.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.blocks import cut, grown, packed, parts_for, shrunk, unpacked
from palimpsest.llm.store import document_batches, give_back, kept_in_worker

BLOCK_CHARS = 4 << 20  # a block's words and ids are held in a worker beside its text
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Classes of Latin-1 characters: a letter or digit, a comma or full stop, other white space than space and line end, or else.
KINDS = bytes((b"a" if chr(i).isalnum() else b"," if chr(i) in ",." else b"?" if chr(i).isspace() and chr(i) not in " \n" else b"#")[0] for i in range(256))


def regular(text: str) -> bool:
    """Whether a text may be cut before every space, line end, comma and full stop."""
    try:
        kinds = text.encode("latin-1").translate(KINDS)
    except UnicodeEncodeError:
        return False
    return not (kinds[:1] == b"," or b"#," in kinds or b",," in kinds or b"?" in kinds or text[0] in " \n" or text[-1] in " \n"
                or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text)


def words_of(text: str) -> list[str]:
    """A text in pieces whose encodings, one after the other, are the text's own.

    The vocabulary's own splitting never joins what lies on two sides of a single space or line end
    between other characters, nor a letter or digit and the punctuation after it.
    """
    if not text:
        return []
    if not regular(text):
        return CUT.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").replace(",", "\0,").replace(".", "\0.").split("\0")


def loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def pieces(path: str) -> dict[int, bytes]:
    """The bytes of every id, special tokens included. As large as the vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    other = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(other)}
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    special = {t["id"]: t["content"].encode() for t in stored.get("added_tokens", [])}
    return {i: bytes(byte[c] for c in t) for t, i in stored["model"]["vocab"].items() if i not in special} | special


def _parted(words: dict[str, None], parts: int) -> list[list[str]]:
    """Words by part, in their order of appearance."""
    out: list[list[str]] = [[] for _ in range(parts)]
    for w in words:
        out[crc32(w.encode("utf-8", "surrogatepass")) % parts].append(w)
    return out


def distinct_words(docs: DataFrame, parts: int) -> DataFrame:
    """(block, part, sizes, words): the different words of every block by part, in order of appearance. docs: (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        press = zstandard.ZstdCompressor(level=3)
        for number, _, texts in cut(batches, BLOCK_CHARS):
            words: dict[str, None] = {}
            for t in texts:
                if t:
                    words.update(dict.fromkeys(words_of(t)))
            for part, own in enumerate(_parted(words, parts)):
                if own:
                    raw = [w.encode("utf-8", "surrogatepass") for w in own]
                    yield pd.DataFrame({"block": np.int64(number), "part": np.int32(part), "sizes": [shrunk(np.array([len(r) for r in raw], "<u4"))],
                                        "words": [press.compress(b"".join(raw))]})

    return docs.mapInPandas(run, "block long, part int, sizes binary, words binary")


def coded_words(words: DataFrame, path: str) -> DataFrame:
    """(block, part, counts, ids, odd, pieces): the ids of each word asked, one after the other, and the decoded form of those
    words (by place) that do not decode to themselves. Every distinct word is encoded and decoded once."""

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        give_back()
        tokenizer = kept_in_worker(("bpe", path), lambda: loaded(path))
        piece = kept_in_worker(("pieces", path), lambda: pieces(path))

        def lists() -> Iterator[list[bytes]]:
            """The words of one block after the other; only different ones are kept."""
            for s, w in zip(asked["sizes"], asked["words"], strict=True):
                yield unpacked(grown(s, "<u4").astype(np.int64), w)

        table = list(set(chain.from_iterable(lists())))
        ids: dict[bytes, bytes] = {}
        wrong: dict[bytes, bytes] = {}
        for at in range(0, len(table), 10_000):
            some = table[at:at + 10_000]
            for word, e in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                ids[word] = np.array(e.ids, "<u4").tobytes()
                if (back := b"".join(map(piece.__getitem__, e.ids))) != word:
                    wrong[word] = back
        counts, coded, odd, pieces_of = [], [], [], []
        for own in lists():
            found = [ids[w] for w in own]
            counts.append(shrunk(np.array([len(i) // 4 for i in found], "<u4")))
            coded.append(shrunk(np.frombuffer(b"".join(found), "<u4")))
            odd.append([i for i, w in enumerate(own) if w in wrong] if wrong else [])
            pieces_of.append([wrong[own[i]] for i in odd[-1]])
        return pd.DataFrame({"block": asked["block"], "part": asked["part"], "counts": counts, "ids": coded, "odd": odd, "pieces": pieces_of})

    return words.groupBy("part").applyInPandas(run, "block long, part int, counts binary, ids binary, odd array<int>, pieces array<binary>")


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, decoded): the ids of every whole text and the text they decode to, by a byte-level vocabulary.

    With `digest` the last column is decoded_sha256, so that no decoded text leaves its worker.
    Nulls and empty texts have no ids and decode to an empty text. Every row gives a row, whatever its id.
    `docs` must read the same rows in the same order each time, as files do; a block that does not get its own
    words back fails the job.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    document_batches(docs.sparkSession)
    parts = parts_for(docs.sparkSession)
    words = coded_words(distinct_words(rows, parts), path).groupBy("block")

    def run(block: pd.DataFrame, code: pd.DataFrame) -> pd.DataFrame:
        give_back()
        if len(block) != 1:
            raise ValueError("words without their block: the input changed between two reads")
        b = block.iloc[0]
        raw = unpacked(b["sizes"], b["texts"])

        def split() -> Iterator[list[str]]:
            """The words of one text after the other; only different ones are kept."""
            for r in raw:
                yield words_of(r.decode("utf-8", "surrogatepass")) if r else []

        own: dict[str, None] = {}
        for w in split():
            own.update(dict.fromkeys(w))
        asked = _parted(own, parts)
        ids: dict[str, bytes] = {}
        wrong: dict[str, bytes] = {}
        for r in code.itertuples():
            ends, packed_ids, mine = (np.cumsum(grown(r.counts, "<u4").astype(np.int64)) * 4).tolist(), grown(r.ids, "<u4").tobytes(), asked[r.part]
            ids.update(zip(mine, map(packed_ids.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            wrong.update({mine[i]: p for i, p in zip(r.odd, r.pieces, strict=True)})
        if len(ids) != len(own):
            raise ValueError("a block has other words than before: the input changed between two reads")
        coded, decoded = [], []
        for w in split():
            coded.append(np.frombuffer(b"".join(map(ids.__getitem__, w)), "<i4"))
            back = "".join(w) if not wrong else b"".join(wrong[x] if x in wrong else x.encode() for x in w).decode("utf-8", "replace")
            decoded.append(sha256(back.encode()).hexdigest() if digest else back)
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in b["ids"]], "Int64"), "ids": coded, last: decoded})

    last = "decoded_sha256" if digest else "decoded"
    return packed(rows, BLOCK_CHARS).groupBy("block").cogroup(words).applyInPandas(run, f"doc_id long, ids array<int>, {last} string")


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the result of encode_decode with digests."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), "decoded_sha256")
