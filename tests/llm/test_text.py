"""Lines, repeated runs and language: brute force, reversal and held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import langid, substrings
from palimpsest.llm.cuckoo import Filter
from palimpsest.llm.lines import LineStore

WHITE = " \t\n\x0b\x0c\r"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 400)), max_size=900))
def test_filter_misses_nothing_it_holds(steps):
    one, held = Filter(), set()
    mix = [(x * 0x9E3779B97F4A7C15 + 1) % 2**64 for x in range(401)]
    for enters, x in steps:
        if enters and x not in held:
            one.insert(mix[x])
            held.add(x)
        elif not enters and x in held:
            assert one.delete(mix[x])
            held.remove(x)
    one = Filter.from_bytes(one.to_bytes())
    found = one.contains(np.array(mix, np.uint64))
    assert all(found[x] for x in held)
    assert sum(found) <= len(held) + 5


def plain_lines(texts, least, min_chars=1):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))

    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(key(x)) >= min_chars and counts[key(x)] >= least and key(x))]
        out.append(("\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return out


def line_texts():
    rng = random.Random(3)
    pool = ["Same Line", " same line\t", "É", "é", "", "  ", "x", "long " * 2000] + ["own %d" % i for i in range(60)]
    return ["\n".join(rng.choices(pool, k=rng.randint(1, 6))) for _ in range(80)] + ["", None, "same line", "same line\n\n", "same line"]


def test_lines(spark, documents):
    texts = line_texts()
    ids = [*range(len(texts) - 2), None, 3]
    table = documents(texts, ids, n_lines="old", h1=1)
    for least, chars in ((10, 1), (3, 3)):
        store = LineStore.empty(spark, 4, least, chars).insert(table)
        got = store.clean(table)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "h1", "n_lines", "n_dropped"]
        assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == sorted(
            (str(i), *w) for i, w in zip(ids, plain_lines(texts, least, chars), strict=True))
    assert LineStore.empty(spark, 4).insert(documents([])).clean(documents([])).count() == 0


def test_lines_are_reversible(spark, documents):
    texts = line_texts()
    one, two = documents(texts[:50]), documents(texts[50:])
    first = LineStore.empty(spark, 4, 5).insert(one)
    both = first.insert(two)
    again = both.delete(two)
    assert sorted(again.counts.collect()) == sorted(first.counts.collect())
    assert sorted(map(tuple, again.clean(one).collect())) == sorted(map(tuple, first.clean(one).collect()))
    whole = LineStore.empty(spark, 4, 5).insert(documents(texts))
    assert sorted(both.counts.collect()) == sorted(whole.counts.collect())
    assert both.delete(one).delete(two).counts.count() == 0
    with pytest.raises(Exception, match="more often than inserted"):
        first.delete(two).counts.count()


def plain_runs(texts, ids, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    place = [(i is None, i or 0) for i in ids]
    first = {}
    for w, p in zip(words, place, strict=True):
        for i in range(len(w) - n + 1):
            k = tuple(w[i:i + n])
            first[k] = min(first.get(k, (p, i)), (p, i))
    out = []
    for w, p in zip(words, place, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < (p, i):
                gone[i:i + n] = [True] * n
        out.append((" ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone)))
    return out


@pytest.mark.parametrize("window", [2, 5, 20])
def test_repeated_runs(spark, documents, window, monkeypatch):
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randint(10, 70))] for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages)[rng.randrange(5):] if rng.random() < 0.5 else ["u%d" % rng.randrange(9**6) for _ in range(rng.randint(1, 40))]
                 for _ in range(rng.randint(1, 4))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(x for p in parts for x in p))
    texts += ["a " * 300, "a b " * 40, "", None, texts[0], "b " + "a " * 25, texts[1], "É" * 50_000 + " é"]
    ids = [*range(5, len(texts) + 1), None, 7, 9, 2]
    want = sorted((str(i), *w) for i, w in zip(ids, plain_runs(texts, ids, window), strict=True))
    for chars in (8 << 20, 700):
        monkeypatch.setattr(substrings, "BLOCK_CHARS", chars)
        got = substrings.duplicate_spans(documents(texts, ids, spans=1, run=2), window).collect()
        assert sorted((str(r["doc_id"]), r["text"], r["n_words"], r["n_removed"]) for r in got) == want
    for r in got:
        for s in r["spans"]:
            assert s["length"] >= window and s["start"] + s["length"] <= r["n_words"]
    assert substrings.duplicate_spans(documents([])).count() == 0


def test_language(spark, documents):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    content = langid.learn(docs.where(~langid.held_out()))
    assert sorted(content) == ["de", "en", "es", "fr"]
    assert all(len(v) <= langid.PIECES * (langid.PIECE_CHARS * 2 + 1) for v in content.values())
    held = langid.identify(docs.where(langid.held_out()), content)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd = langid.identify(documents(["", None, "12 34 !", "\n", "the and of this that with for was " * 9000], lang_pred="old", source="s"), content)
    got = {r["doc_id"]: r for r in odd.collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["und"] * 4 + ["en"]
    assert [got[i]["lang_rejected"] for i in range(5)] == [True] * 4 + [False]
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    assert langid.identify(documents(["some text"]), {}).first()["lang_pred"] == "und"
    assert langid.learn(documents([])) == {}
    assert langid.identify(documents([]), content).count() == 0


def test_language_of_long_texts(spark, documents):
    """A text of several MB is told as its parts are, with a like margin."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    content = langid.learn(docs.where(~langid.held_out()))
    rng = random.Random(8)
    texts = []
    for name in content:
        words = [w for r in docs.where((docs["lang"] == name) & langid.held_out()).collect() for w in (r["text"] or "").split()]
        texts += [" ".join(rng.choices(words, k=k)) for k in (9_000, 1_500_000)]
    got = [(r["lang_pred"], r["lang_score"], r["lang_rejected"]) for r in langid.identify(documents(texts), content).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == [name for name in content for _ in range(2)]
    for part, whole in zip(got[::2], got[1::2], strict=True):
        assert not part[2] and not whole[2]
        assert 0.8 < whole[1] / part[1] < 1.25


@pytest.mark.parametrize("last_first", [False, True])
def test_deleting_many_keys_loses_no_other(spark, documents, last_first):
    """Filters of 20,000 keys; half of them leave in either order, in one table and where tables had to be built anew."""
    import random

    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(20_000)]
    gone = values[10_000:][::-1] if last_first else values[:10_000]
    kept = sorted(set(values) - set(gone))
    one = Filter.of(values)
    assert one.deletable
    for v in gone:
        assert one.delete(v)
    grown = Filter()
    for v in values:
        grown.insert(v)
    assert not grown.deletable
    with pytest.raises(ValueError, match="anew"):
        grown.delete(gone[0])
    for f in (one, Filter.of(kept), Filter.from_bytes(one.to_bytes())):
        assert f.contains(np.array(kept, np.uint64)).all()


def test_a_store_with_many_lines_is_reversible(spark, documents):
    """Some 3,000 lines become frequent and half of them rare again; what is still frequent goes from the texts."""
    texts = ["\n".join(f"line {i}" for i in range(3000))] * 2 + ["\n".join(f"line {i}" for i in range(0, 3000, 2))]
    store = LineStore.empty(spark, 2, min_docs=2).insert(documents(texts[:2])).insert(documents(texts[2:]))
    back = store.delete(documents(texts[:1]))
    got = back.clean(documents(texts[:1])).first()
    assert got["n_dropped"] == 1500 and got["text"] == "\n".join(f"line {i}" for i in range(1, 3000, 2))
    again = back.insert(documents(texts[:1])).clean(documents(texts[:1])).first()
    assert again["n_dropped"] == 3000
