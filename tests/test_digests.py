"""Digest comparison against the plain joins, and what it leaves out."""

import random

import pytest

from palimpsest.operators import audit, digests, fragments
from palimpsest.sources.report import golden_diff
from tests.conftest import rows

ROWS = "k int, page int, content string"


def versions(n, seed):
    rng = random.Random(seed)
    before = [(i % 7 if i % 11 else None, i, rng.choice(["a", "b", None, "long " * 50])) for i in range(n)]
    after = [(k, p, c + "!" if c and i % 40 == 3 else c) for i, (k, p, c) in enumerate(before) if i % 60 != 5]
    return before, [*after, (9, 10_000, "new"), (None, 10_001, "new")]


@pytest.mark.parametrize("buckets", [1, 16, 1 << 16])
def test_the_plain_results(spark, buckets):
    before, after = versions(400, 1)
    b, a = spark.createDataFrame(before, ROWS), spark.createDataFrame(after, ROWS)
    selected = spark.createDataFrame([r for r in before[::9] if r[0] is not None], ROWS)
    got = digests.unchanged_by_digest(b, a, selected, ["k", "page"], "content", buckets)
    assert rows(got) == rows(fragments.unchanged(b, a, selected, ["k", "page"], "content"))
    assert rows(digests.key_diff_by_digest(b, a, ["k"], buckets)) == rows(audit.key_diff(b, a, ["k"]))
    assert rows(digests.key_diff_by_digest(b, a, ["k", "page"], buckets)) == rows(audit.key_diff(b, a, ["k", "page"]))
    copies = a.unionByName(a.where("page % 3 = 0"))
    assert rows(digests.golden_diff_by_digest(copies, b, ["page"], buckets)) == rows(golden_diff(copies, b))


def test_only_differing_buckets_are_joined(spark):
    base = spark.range(20_000).selectExpr("id AS page", "concat('text ', id) AS content")
    for changes in (0, 1, 20):
        after = base.selectExpr("page", f"if(page % {20_000 // max(changes, 1)} = 0 AND {changes} > 0, 'other', content) AS content")
        noisy = digests.differing(base, after, ["page"], ["content"], 1 << 12)
        assert noisy.count() <= changes
        assert digests.within(base, noisy, ["page"], 1 << 12).count() <= changes * 20
        plan = digests.unchanged_by_digest(base, after, base.limit(0), ["page"], "content", 1 << 12)
        assert plan.where("status <> 'UNCHANGED'").count() == changes and plan.count() == 20_000
    empty = base.where("false")
    assert digests.differing(empty, empty, ["page"], ["content"]).count() == 0
    assert digests.differing(base, empty, ["page"], ["content"], 8).count() == 8


def test_digest_ignores_order_and_counts_copies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (1, "y"), (1, "x"), (1, "y")], "k int, v string")
    assert digests.differing(a, b, ["k"], ["v"], 4).count() == 0
    for other in ([(1, "x"), (1, "x"), (1, "y"), (2, None)], [(1, "x"), (1, "y"), (1, "y"), (2, "")], [(1, "x"), (1, "y"), (2, None)]):
        assert digests.differing(a, spark.createDataFrame(other, "k int, v string"), ["k"], ["v"], 4).count() == 1
