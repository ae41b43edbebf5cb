"""Cross-tokenizer alignment against plain Python over all token pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from palimpsest.llm import galloping

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    return galloping.Sides(A, B)


def plain_alignment(texts, sides):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per text, token by token, whole texts encoded at once."""
    linked, out = [], []
    for t in texts:
        a = sides.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sides.b.encode(t) if t else []
        raw = (" " + (t or "")).encode()
        if not t or b"".join(sides.a_bytes[i] for i in a) != raw or b"".join(sides.b_bytes[i] for i in b) != raw:
            linked.append([])
            out.append((0, 0, 0, ""))
            continue
        spans = []
        for ids, table in ((a, sides.a_bytes), (b, sides.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(table[i])))
                at += len(table[i])
            spans.append(own)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, own, strict=True) if s >= start and e <= end) for ids, own in zip((a, b), spans, strict=True)))
            start = end
        linked.append([(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (u, v) in zip(b, spans[1], strict=True) if s < v and u < e])
        out.append((len(a), len(b), len(ends), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for pairs in linked for p in set(pairs))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    return [(*o[:3], len(p), sum(count[x] == best[x[0]] for x in p), sum(count[x] for x in p), o[3]) for o, p in zip(out, linked, strict=True)]


def test_gallop():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 400), (300, 7), (1000, 1000), (0, 3)):
        long = np.sort(rng.choice(5000, m, replace=False))
        short = np.sort(rng.choice(int(long[-1]) + 1, min(n, int(long[-1]) + 1), replace=False))
        first = np.maximum(np.searchsorted(long, short) - rng.integers(0, 50, len(short)), 0)
        assert galloping.galloped(short, long, first).tolist() == np.searchsorted(long, short).tolist()


def odd_texts(n):
    rng = random.Random(7)
    bits = ["the", " ", "  ", "\n", "über", "naïve ", "Straße", "日本", "😀", "▁", "<s>", "<|endoftext|>", "</s>", "<unk>", "<0x0A>", "\t", "don't", "123", "...", "\r\n", "\x00", "é", " "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_whole_result(spark, documents, sides):
    """Odd texts, nulls, equal rows and ids, and long texts, in blocks of a few documents."""
    long = "der Zug fährt  um 7, und\nnobody knows; " * 6000
    texts = [None, "", " ", "a", "same text", "same text", "▁x", " lead", "x" * 3000, long, "end\n", *odd_texts(150)]
    ids = [*range(len(texts) - 2), None, 4]
    table = documents(texts, ids, pairs=1, block=2)
    got = galloping.align(table, A, B, chars=2000)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    short = plain_alignment(texts[:9] + texts[10:], sides)  # all pairs of the long text would be too many
    rows = {(str(r[0]), r["groups_sha256"]): tuple(r)[1:] for r in got.collect()}
    assert got.count() == len(texts)
    names = [str(i) for i in ids[:9] + ids[10:]]
    for name, want in zip(names, short, strict=True):  # counts depend on the long text, so without them
        assert rows[name, want[6]][:4] == want[:4]
    again = galloping.align(documents(texts[:9] + texts[10:], ids[:9] + ids[10:]), A, B, chars=300)
    assert sorted(map(str, (tuple(r) for r in again.collect()))) == sorted(str((None if n == "None" else int(n), *w)) for n, w in zip(names, short, strict=True))
    r = next(tuple(r) for r in got.collect() if r["doc_id"] == 9)
    a, b = sides.a.encode(" " + long, add_special_tokens=False).ids, sides.b.encode(long)
    assert r[1] == len(a) and r[2] == len(b) and r[4] == r[1] + r[2] - r[3]
    assert galloping.align(documents([]), A, B).count() == 0


def test_words_are_encoded_as_a_whole_text(sides, monkeypatch):
    """Cut at words, with words forgotten and long ones not kept, ids are those of whole texts."""
    texts = [*odd_texts(400), "a" * 200 + " b " + "c" * 200, "two  spaces", "trailing ", "\0 zero", "tab\tx y"]
    for known in (0, 10, 200_000):
        monkeypatch.setattr(galloping, "KNOWN", known)
        a, b = sides.encode(texts)
        for t, x, y in zip(texts, a, b, strict=True):
            whole_a, whole_b = sides.a.encode(" " + t, add_special_tokens=False).ids, sides.b.encode(t)
            raw = (" " + t).encode()
            good = b"".join(sides.a_bytes[i] for i in whole_a) == raw == b"".join(sides.b_bytes[i] for i in whole_b)
            assert (x.tolist(), y.tolist()) == ((whole_a, whole_b) if good else ([], []))
