"""Token ids against the library, files against their bytes, top-k against a full product."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import bpe, rans, tokenfile, topk

ODD = ["", None, " ", "\n\n", "a  b", " lead", "trail ", "tab\tx", "don't we'll", "x.,y ..z , .", "<|endoftext|> a<|endoftext|>b", "É é ñ 日本 語。", "1,000.5 2²",
       "nul\0in text", "a b c", "é ́x", "!\x1cb \x1c \x1d", "🙂🙃, ok", "<|startoftext|>x", "ΑΣ Σ.", "w" * 30_000, "it's. \n New"]


def loaded(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(1)
    parts = [x for x in ODD if x] + ["the", "of", ",", ".", " ", "\n", "Word", "123"]
    return ODD + ["".join(rng.choices(parts[:20] + parts[21:], k=rng.randint(1, 8))) for _ in range(300)]


def test_bpe_is_the_librarys(spark, documents):
    texts, lib = odd_texts(), loaded("byte_bpe_50k.json")
    ids = [None, 4, 4, *range(10, len(texts) + 7)]
    got = bpe.encode_decode(documents(texts, ids, decoded="clash", word=1), public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == sorted(
        (str(i), w, lib.decode(w, skip_special_tokens=False)) for i, w in zip(ids, want, strict=True))
    assert bpe.encode_decode(documents([]), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    told = bpe.encode_decode(documents(texts, ids), public_tokenizers.path("byte_bpe_50k.json"), digest=True).collect()
    assert sorted(r["decoded_sha256"] for r in told) == sorted(hashlib.sha256(r["decoded"].encode()).hexdigest() for r in got)


def test_words_cover_a_text():
    for t in odd_texts():
        assert "".join(bpe.words_of(t or "")) == (t or "")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 40))
def test_rans_round_trip(ids, times):
    ids = np.array(ids * times, np.uint32)
    counts = np.bincount(ids, minlength=301)
    table = rans.Table.of_counts(counts)
    assert len(ids) == 0 or int(table.freq.sum()) == 1 << table.bits
    assert (rans.decode(*rans.encode(ids, table), len(ids), table) == ids).all()


def test_many_rare_ids_keep_a_slot():
    counts = np.ones(60_000, np.int64)
    counts[:3] = 10**9
    table = rans.Table.of_counts(counts)
    assert int(table.freq.min()) >= 1 and int(table.freq.sum()) == 1 << table.bits
    with pytest.raises(ValueError, match="without frequency"):
        rans.encode(np.array([1]), rans.Table.of_counts(np.array([5, 0])))


def test_token_files(spark, documents, monkeypatch):
    texts, lib = odd_texts(), loaded("word_bpe_49k.json")
    ids = [None, *range(len(texts), 1, -1)]
    path = public_tokenizers.path("word_bpe_49k.json")
    for block in (1 << 20, 50):
        monkeypatch.setattr(tokenfile, "BLOCK_IDS", block)
        folder, manifest = tokenfile.token_files(documents(texts, ids, n="x", part=1), path, end=2)
        got = tokenfile.read_files(spark, folder, manifest).collect()
        want, start = [], 0
        for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)):
            tokens = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((str(i), start, tokens))
            start += len(tokens)
        assert sorted((str(r["doc_id"]), r["start"], np.frombuffer(r["raw"], "<u4").tolist()) for r in got) == sorted(want)
    folder, manifest = tokenfile.token_files(documents([]), path, end=2)
    assert manifest.count() == 0


def test_words_of_letters_are_encoded_together():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, rng = loaded("word_bpe_49k.json"), random.Random(3)
    words = list(dict.fromkeys("".join(rng.choices("abcdefghéàöÿ", k=rng.randint(1, 9))) for _ in range(2500)))
    words += ["don't", ",", "straße", "µm", "12a", "a\tb", "ΑΣ", "日本", "x" * 5000, "\0"]
    want = {w: lib.encode(w, add_special_tokens=False).ids for w in words}
    asked = []

    class Counted:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return lib.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    last = tokenfile.word_ends(lib, path)
    got = tokenfile.encoded_words(Counted(), words, "H", last)
    assert {w: np.frombuffer(b, "<u2").tolist() for w, b in got.items()} == want
    assert len(asked) < 20
    # where the marked ids do not tell the words apart, each is encoded alone
    got = tokenfile.encoded_words(Counted(), words, "H", last - {want["a"][-1]} if "a" in want else frozenset())
    assert {w: np.frombuffer(b, "<u2").tolist() for w, b in got.items()} == want


def test_damage_is_noticed(spark, documents):
    from pathlib import Path

    folder, manifest = tokenfile.token_files(documents(["some words here"] * 5), public_tokenizers.path("word_bpe_49k.json"), end=2)
    file = Path(manifest.first()["path"])
    raw = file.read_bytes()
    assert sum(len(b) for b in tokenfile.records(raw)) < len(raw)
    at = len(raw) - 3
    with pytest.raises(ValueError, match="damaged"):
        list(tokenfile.records(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1:]))
    with pytest.raises(ValueError, match="damaged"):
        list(tokenfile.records(raw[:-1]))
    assert zlib.crc32(raw) != 0


def plain_top(rows, k):
    ok = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asks = {}
    for i, v in ok:
        if i % 20 == 0:
            asks[i] = min(asks.get(i, v), v)
    out = []
    for q, v in asks.items():
        best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.25, 0.5, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(150, 190)]  # ties
    rows += [(40, rows[3][1]), (41, rows[41][1]), (None, [1.0] * 6), (200, None), (201, [1.0, None]), (202, [float("nan")] * 6),
             (220, [float("inf")] * 6), (203, []), (240, [1e9, 2.0, 3.0, -1e9, 5e8, 1.0]), (241, [1e9, 1.0, 1.0, 1e9, 1.0, 1.0])]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    for shard, block in ((8192, 2048), (16, 3)):
        monkeypatch.setattr(topk, "SHARD", shard)
        monkeypatch.setattr(topk, "QUERY_BLOCK", block)
        monkeypatch.setattr(topk, "FAN", 3)
        got = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=7).collect()
        assert sorted(map(tuple, got)) == plain_top(rows, 7)
    assert topk.top_k(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = frame.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, F.col("vec_id") % 20 == 0).count() == 2
