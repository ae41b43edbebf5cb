"""Orchard search and product codes against plain search over all entries."""

import hashlib
import math

import numpy as np
import pytest

from palimpsest.llm import lookup, orchard


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """{(vec_id, code, error)}, errors by label and codebooks of (vec_id, vector, label) by Python integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    n = len(kept[0][1]) // parts

    def pieces(v):
        return [v[p * n:(p + 1) * n] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    books = [[pieces(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[near(pieces(v)[p], books[p])[1]].append(pieces(v)[p])
            books[p] = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)]
    out = []
    for i, v, g in kept:
        found = [near(x, b) for x, b in zip(pieces(v), books, strict=True)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), g))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by = {}
    for _, _, d, g in out:
        by[g] = by.get(g, 0) + d
    return [(i, c, d, by[g], digest) for i, c, d, g in out], books


@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_with_ties(kind):
    rng = np.random.default_rng(3)
    for spread in (2, 3, 20, 1000):
        for n in (1, 2, 7, 16):
            book = rng.integers(-spread, spread, (n, 3)).astype(kind)
            rows = rng.integers(-spread, spread, (300, 3)).astype(kind)
            code, far = orchard.nearest(rows, book)
            all_of = ((rows[:, None, :] - book[None]) ** 2).sum(2)
            assert code.tolist() == [min(range(n), key=lambda j, r=r: (r[j], j)) for r in all_of.tolist()]
            assert far.tolist() == all_of.min(1).tolist()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_codes(spark):
    rng = np.random.default_rng(5)
    rows = [(i * 7 % 400, [float(x) for x in rng.normal(0, 1, 16).round(3)], None if i % 9 == 0 else i % 3) for i in range(400)]
    rows += [(401, None, 1), (402, [None] * 16, 1), (403, [math.nan] + [0.0] * 15, 2), (404, [math.inf] * 16, None)]
    rows += [(5, rows[0][1], 7), (5, rows[0][1], 7), (None, rows[3][1], None), (None, [0.0] * 16, 1), (-3, [1e-5] * 16, 0)]
    frame = vectors(spark, rows)
    from pyspark.sql import functions as F

    got = orchard.digests(orchard.codes(frame.withColumn("code", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("n", F.lit(1))))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want, _ = plain_codes(rows)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_few_wide_and_equal_vectors(spark):
    for rows in ([(3, [0.5] * 8, 1)], [(i, [1.0] * 8, None) for i in range(40)],
                 [(i, [1e30 * (i % 3), -1.5, 0.0, 7.0, 1.0, 2.0, 3.0, float(i)], 1) for i in range(20)][:1],
                 [(i, [3e4 * (i % 5 + i / 7), -1.5, 0.0, 7.0, 1.0, 2.0, 3.0, float(i)], 1) for i in range(30)]):
        want, _ = plain_codes(rows)
        assert sorted(tuple(r) for r in orchard.digests(orchard.codes(vectors(spark, rows))).collect()) == sorted(want)
    assert orchard.codes(vectors(spark, [])).count() == 0
    with pytest.raises(ValueError, match="length"):
        orchard.codes(vectors(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)]))


def test_lookup_of_hot_keys(spark):
    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end k", "id")
    table = rows.groupBy("k").count().selectExpr("k", "count n", "coalesce(k, -1) * 2 twice")
    got = lookup.looked_up(rows, table, "k", "n", 3000)
    assert got.columns == ["k", "id", "twice"]
    assert sorted((r["id"], r["twice"]) for r in got.collect()) == [(i, -2 if i % 3 == 0 else 14 if i % 3 == 1 else 2 * i) for i in range(3000)]
