"""Token ids as binary files of rANS blocks, written and read by Spark tasks.

A file is a sequence of records. Each has a fixed head (magic, length, CRC-32 of the body) and a body: the first holds
the frequency table, each other one a block of whole documents: their ids and lengths, the checkpoints and the words.
Records are independent, so a reader can start at any of them and, within a block, at any checkpoint.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.blocks import cut
from palimpsest.llm.bpe import loaded, regular
from palimpsest.llm.rans import LANES, Table, decode, encode
from palimpsest.llm.store import kept_in_worker, new_folder, written

MAGIC = b"RTOK"
HEAD = "<4sQI"  # magic, length and CRC-32 of the body
BLOCK_IDS = 1 << 20  # a block holds this many ids, or one longer document
FILE_IDS = 16 << 20  # ids a file is planned for
BLOCK_CHARS = 8 << 20  # text whose words are looked up together
KNOWN_WORDS = 500_000  # words a worker remembers besides those of its block
JOINED = 1_000  # words of letters that are encoded as one text
LETTERS = re.compile("[a-zà-öø-ÿ]+").fullmatch


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def bare(text: str) -> str:
    """A text as pieces with one space between them, whose encodings, one after the other, are the text's own, for vocabularies
    that drop white space and case: what stands between spaces and line ends and, where that is safe, before commas and full stops."""
    if regular(text) and "<|" not in text:
        return text.lower().replace(",", " ,").replace(".", " .").replace("\n", " ")
    return " ".join(w for w in text.replace("\n", " ").split(" ") if w)


def encoded_words(tokenizer, words: list[str], code: str, last: frozenset[int]) -> dict[str, bytes]:
    """The ids of each word. Words of small letters are encoded many at a time and told apart by the ids that end a word, `last`;
    where those are not as many as the words each is encoded alone, and so are other words."""
    out: dict[str, bytes] = {}
    plain, alone = [], []
    for w in words:
        (plain if last and LETTERS(w) else alone).append(w)
    groups = [plain[at:at + JOINED] for at in range(0, len(plain), JOINED)]
    for at in range(0, len(groups), 20):
        some = groups[at:at + 20]
        for group, e in zip(some, tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False), strict=True):
            ids = e.ids
            ends = [i for i, x in enumerate(ids, 1) if x in last]
            if len(ends) != len(group) or ends[-1] != len(ids):
                alone += group
                continue
            raw, width = struct.pack(f"<{len(ids)}{code}", *ids), struct.calcsize(f"<{code}")
            ends = [width * i for i in ends]
            out.update(zip(group, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))
    for at in range(0, len(alone), 10_000):
        some = alone[at:at + 10_000]
        for word, e in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
            out[word] = struct.pack(f"<{len(e.ids)}{code}", *e.ids)
    return out


def word_ends(tokenizer, path: str) -> frozenset[int]:
    """The ids that stand at the end of a word and nowhere else; none, if the vocabulary does not mark them."""
    with open(path, encoding="utf-8") as f:
        suffix = json.load(f)["model"].get("end_of_word_suffix")
    return frozenset(i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)) if suffix else frozenset()


def placed(table: list[bytes], at: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of the words at the places `at` of a table, one after the other, and where each word's end."""
    all_ids = np.frombuffer(b"".join(table), kind)
    sizes = np.fromiter(map(len, table), np.int64, len(table)) // np.dtype(kind).itemsize
    starts = np.cumsum(sizes) - sizes
    own = sizes[at]
    ends = np.cumsum(own)
    where = np.repeat(starts[at] - ends + own, own)
    where += np.arange(len(where))
    return all_ids[where], ends


def tokenise(docs: DataFrame, path: str, end: int | None, kind: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary, n long): ids as little-endian integers of the given type, `end` appended.

    A block of documents has each of its different words encoded once, or not at all if its worker still knows the word.
    """
    code = {"<u2": "H", "<u4": "I"}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, last = kept_in_worker(("bare", path), lambda: (t := loaded(path), word_ends(t, path)))
        known: dict[str, bytes] = kept_in_worker(("words", path, kind), dict)
        tail = b"" if end is None else struct.pack(f"<{code}", end)
        for _, names, texts in cut(batches, BLOCK_CHARS):
            flat = [bare(t) if t else "" for t in texts]
            n_words = np.array([t.count(" ") + 1 if t else 0 for t in flat], np.int64)
            joined = pa.array([" ".join(t for t in flat if t)], pa.large_string())
            found = pc.list_flatten(pc.split_pattern(joined, " ")).dictionary_encode()
            words = found.dictionary.to_pylist()
            new = [w for w in words if w not in known]
            if len(known) + len(new) > KNOWN_WORDS:
                kept = set(words)
                for w in [w for w in known if w not in kept]:
                    del known[w]
            known.update(encoded_words(tokenizer, new, code, last))
            all_ids, ends = placed([known[w] for w in words], found.indices.to_numpy(), kind)
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])].tolist()
            ids = [all_ids[a:b].tobytes() + tail for a, b in zip(bounds, bounds[1:])]
            yield pd.DataFrame({"doc_id": pd.array(names, "Int64"), "ids": ids, "n": [len(x) // np.dtype(kind).itemsize for x in ids]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, ids binary, n long")


def frequencies(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; tasks send one row per id, at most the vocabulary's size each."""
    kind = _kind(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["ids"]), kind), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    counts = tokens.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary, np.int64)
    out[counts["id"].to_numpy()] = counts["n"].to_numpy()
    return out


def _record(body: bytes) -> bytes:
    return struct.pack(HEAD, MAGIC, len(body), zlib.crc32(body)) + body


def table_record(table: Table, part: int) -> bytes:
    return _record(struct.pack("<BQII", 0, part, table.bits, len(table.freq)) + table.freq.astype("<u4").tobytes())


def block_record(table: Table, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    lengths = np.array([len(x) for x in ids], "<u4")
    tokens = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    words, states, offsets = encode(tokens, table)
    names = np.array([0 if x is None else x for x in doc_ids], "<i8")
    known = np.array([x is not None for x in doc_ids], "u1")
    head = struct.pack("<BIIQ", 1, len(ids), len(offsets), len(words))
    return _record(head + b"".join(x.tobytes() for x in (
        names, known, lengths, offsets.astype("<i8"), states.astype("<u8"), words.astype("<u2"))))


def records(content: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(content):
        magic, size, crc = struct.unpack_from(HEAD, content, at)
        body = content[at + struct.calcsize(HEAD):at + struct.calcsize(HEAD) + size]
        if magic != MAGIC or len(body) != size or zlib.crc32(body) != crc:
            raise ValueError("a damaged record")
        yield body
        at += struct.calcsize(HEAD) + size


def read_table(body: bytes) -> tuple[int, Table]:
    kind, part, bits, size = struct.unpack_from("<BQII", body)
    if kind != 0:
        raise ValueError("a file begins with its table")
    return part, Table(np.frombuffer(body, "<u4", size, struct.calcsize("<BQII")).astype(np.int64), bits)


def read_block(body: bytes, table: Table) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a block."""
    kind, docs, segments, size = struct.unpack_from("<BIIQ", body)
    if kind != 1:
        raise ValueError("not a block")
    at, out = struct.calcsize("<BIIQ"), []
    for dtype, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<i8", segments), ("<u8", segments * LANES), ("<u2", size)):
        out.append(np.frombuffer(body, dtype, n, at))
        at += n * np.dtype(dtype).itemsize
    names, known, lengths, offsets, states, words = out
    ends = np.cumsum(lengths.astype(np.int64))
    ids = decode(words, states.reshape(segments, LANES), offsets, int(ends[-1]) if docs else 0, table)
    for name, sure, end, n in zip(names.tolist(), known.tolist(), ends.tolist(), lengths.tolist(), strict=True):
        yield (name if sure else None), ids[end - n:end]


def write_files(tokens: DataFrame, folder: str, counts: np.ndarray) -> DataFrame:
    """Write tokens (doc_id, ids, n) in ascending doc_id order (null first; equal ids by a hash of their tokens) to `folder`.

    Returns (part, path, docs, ids, bytes), one row per file. A task writes under a name of its own attempt
    and renames at the end, so a repeated or speculative task leaves the same file.
    """
    vocabulary, table = len(counts), Table.of_counts(counts)
    freq, bits = table.freq.astype(np.int64), table.bits
    kind = _kind(vocabulary)
    spark = tokens.sparkSession
    files = max(1, -(-int(counts.sum()) // FILE_IDS), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, part = Table(freq, bits), TaskContext.get().partitionId()
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        place, work = posixpath.join(base, f"{part:08d}.rtok"), posixpath.join(base, f"_{part:08d}-{uuid.uuid4().hex}")
        docs = total = size = 0
        with fs.open_output_stream(work) as out:
            size += out.write(table_record(table, part))
            names, parts, held = [], [], 0
            for batch in batches:
                for name, raw in zip(batch["doc_id"].tolist(), batch["ids"].tolist(), strict=True):
                    names.append(None if pd.isna(name) else int(name))
                    parts.append(np.frombuffer(raw, kind))
                    held, docs = held + len(parts[-1]), docs + 1
                    if held >= BLOCK_IDS:
                        size += out.write(block_record(table, names, parts))
                        names, parts, held, total = [], [], 0, total + held
            if names:
                size += out.write(block_record(table, names, parts))
                total += held
        if docs:
            fs.move(work, place)
            yield pd.DataFrame({"part": [part], "path": [place], "docs": [docs], "ids": [total], "bytes": [size]})
        else:
            fs.delete_file(work)

    keyed = tokens.select("doc_id", F.xxhash64("ids").alias("h"), "ids")  # the range sample holds keys, not ids
    ordered = keyed.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids")
    manifest = ordered.select("doc_id", "ids").mapInPandas(run, "part long, path string, docs long, ids long, bytes long")
    return written(manifest, "manifest")


def read_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids array<long>) of every document of the files, start counted over all files."""
    so_far = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = written(manifest.select("part", (so_far - F.col("ids")).alias("before")), "starts")  # a row per file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                bodies = records(content)
                part, table = read_table(next(bodies))
                at = 0
                for body in bodies:
                    found = list(read_block(body, table))
                    size = np.array([len(ids) for _, ids in found], np.int64)
                    start = at + np.cumsum(size) - size
                    at += int(size.sum())
                    for a in range(0, len(found), 1024):
                        some = found[a:a + 1024]
                        yield pd.DataFrame({"part": part, "doc_id": pd.array([x for x, _ in some], "Int64"), "at": start[a:a + 1024],
                                            "raw": [x.astype("<u4").tobytes() for _, x in some]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rtok").load(folder).select("content")
    rows = files.mapInPandas(run, "part long, doc_id long, at long, raw binary")
    return rows.join(before, "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "raw")


def token_files(docs: DataFrame, path: str, end: int | None, folder: str | None = None, doc_id: str = "doc_id",
                text: str = "text") -> tuple[str, DataFrame]:
    """Encode documents with a vocabulary and write them as token files; returns the folder and its manifest.

    A null text has no ids but the end id. Rows of a null or repeated id are kept, null first. The vocabulary must drop white
    space and case.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    vocabulary = max(Tokenizer.from_file(path).get_vocab_size(), 0 if end is None else end + 1)
    tokens = written(tokenise(docs, path, end, _kind(vocabulary), doc_id, text), "token_rows")
    return folder, write_files(tokens, folder, frequencies(tokens, vocabulary))
