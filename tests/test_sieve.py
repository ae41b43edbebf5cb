"""The sieve lets through all that stands on two pages, and little else."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import fragments, sieve
from tests.conftest import rows

USES = "asset int, page int, ref string"


@pytest.mark.parametrize("slots", [1, 50, 1 << 16, 1 << 26])
def test_nothing_that_repeats_is_lost(spark, slots):
    data = [(i % 3, i % 17, f"o{i % 40}") for i in range(400)] + [(0, 5, None), (0, 6, None), (1, 5, "once"), (1, 5, "once"), (None, 1, "n"), (2, None, "x"), (2, 3, "x")]
    uses = spark.createDataFrame(data, USES)
    pages = {}
    for a, p, r in data:
        pages.setdefault((a, r), set()).add(p)
    several = {k for k, v in pages.items() if len(v) > 1}
    got = {(r["asset"], r["ref"]) for r in sieve.passing(uses, ["asset", "ref"], ["page"], slots).collect()}
    assert several <= got
    if slots >= 1 << 16:
        assert got == several
    known = uses.dropna()
    assert rows(fragments.repeated_objects(known, "asset", "page", "ref", slots=slots)) == rows(fragments.repeated_objects(known, "asset", "page", "ref"))


def test_hot_and_all_distinct_inputs(spark):
    hot = spark.range(20_000).selectExpr("cast(id % 5 as int) AS asset", "cast(id as int) AS page", "'the same' AS ref")
    assert sieve.passing(hot, ["asset", "ref"], ["page"]).count() == 20_000
    different = spark.range(20_000).selectExpr("1 AS asset", "cast(id as int) AS page", "concat('o', id) AS ref")
    assert sieve.passing(different, ["asset", "ref"], ["page"]).count() < 20
    assert sieve.seen_twice(hot, ["asset", "ref"], ["page"]).agg(F.sum(F.bitmap_count("bits"))).first()[0] == 5
    assert sieve.passing(hot.where("false"), ["asset", "ref"], ["page"]).count() == 0
    with pytest.raises(ValueError, match="slots"):
        sieve.seen_twice(hot, ["asset"], ["page"], 1 << 31)


@pytest.mark.parametrize("scope,target", [("document", None), ("corpus", None), ("document", "gh")])
def test_repeated_text_with_a_sieve(spark, scope, target):
    docs = spark.createDataFrame([(i % 4, i, "Header\n" + "\n".join(f"line {i * 3 + k}" for k in range(5)) + ("\nnight" if i % 5 else "\nDay  x")) for i in range(60)],
                                 "asset int, page int, text string")
    lines = fragments.fragments(docs, "text", ["asset", "page"])
    plain, fast = [fragments.repeated_text(lines, docs, "asset", "page", min_share=0.1, scope=scope, target=target, slots=s) for s in (None, 1 << 20)]
    assert rows(fast) == rows(plain) and plain.count() > 0
