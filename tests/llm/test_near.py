"""Fingerprints, BK-trees, components and near copies against brute force."""

import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import simhash
from palimpsest.llm.bktree import Forest
from palimpsest.llm.components import components


def plain_print(text, k=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_groups(prints, ids, radius):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least.get(root(i)) for i in range(len(prints))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**12 - 1)), min_size=1, max_size=60, unique=True), st.integers(0, 6))
def test_forest_finds_what_is_near(rows, radius):
    tree, prints = (np.array(x) for x in zip(*rows, strict=True))
    prints = prints.astype(np.uint64) * np.uint64(0x1111111111111)
    q, n, d = Forest(tree, prints).search(tree, prints, radius)
    want = {(i, j) for i in range(len(rows)) for j in range(len(rows))
            if tree[i] == tree[j] and int(prints[i] ^ prints[j]).bit_count() <= radius}
    assert set(zip(q.tolist(), n.tolist(), strict=True)) == want
    assert all(int(prints[a] ^ prints[b]).bit_count() == c for a, b, c in zip(q, n, d, strict=True))


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (3, 2), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts(seed=5):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "new%d" % rng.randrange(99)
            texts.append(" ".join(copy))
    return [*texts, texts[0], texts[0].upper(), "", None, " \t\n", "One", "two words", "x" * 100_000 + " É é É", "a b c d e"]


def test_fingerprints_and_groups(spark, documents, monkeypatch):
    texts = near_texts()
    ids = [*range(len(texts) - 3), None, 5, 5]
    want = plain_groups([plain_print(t) for t in texts], ids, 4)
    for chunk in (1024, 4):  # small chunks split every shard
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = simhash.simhash_groups(documents(texts, ids, fingerprint="clash", component_id=1)).collect()
        assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == sorted(
            (str(i), f"{plain_print(t):016x}", w) for i, t, w in zip(ids, texts, want, strict=True))
    assert simhash.simhash_groups(documents([])).count() == 0


def plain_near(texts, ids, k=5, least=0.8):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return (tuple(w), frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())

    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if sets[i][0] == sets[j][0] or (a and b and len(a & b) >= least * len(a | b)):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    first = {}
    for i in sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, i)):
        first.setdefault(root(i), i)
    return sorted(str(ids[i]) for i in first.values())


def test_one_row_of_near_copies_stays(spark, documents, monkeypatch):
    texts = near_texts(9)
    ids = [None if i % 17 == 3 else 1000 - i for i in range(len(texts))]
    table = documents(texts, ids, key=1, hashes="x", node=2.5)
    for chunk in (1024, 4):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        kept = simhash.keep_one(table)
        assert kept.columns == table.columns
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == plain_near(texts, ids)
        assert kept.exceptAll(table).count() == 0
    assert simhash.keep_one(documents([])).count() == 0


def test_near_copies_whose_fingerprints_are_far_apart(spark, documents):
    """Equal sets with other repeats, and 4 of 5 shingles in common."""
    rng = random.Random(2)
    texts = []
    for n in range(20):
        own, line = " ".join(f"r{n}x{rng.randrange(10**6)}" for _ in range(200)), " ".join(f"l{n}x{i}" for i in range(8))
        texts += [f"{own} {line} {line}", own + f" {line}" * 30]
    for n in range(200):
        own = [f"s{n}x{rng.randrange(10**6)}" for _ in range(9)]
        texts += [" ".join(own[:8]), " ".join(own)]
    kept = sorted(str(r["doc_id"]) for r in simhash.keep_one(documents(texts)).collect())
    assert kept == plain_near(texts, list(range(len(texts)))) == sorted(str(2 * n) for n in range(220))
