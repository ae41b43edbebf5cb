"""Helpers for large groups must give what a plain window, join or sort gives."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import quantile
from palimpsest.operators.identity import number_copies
from palimpsest.operators.masks import merge_intervals
from palimpsest.operators.prefix import chunk_of, numbered, running
from palimpsest.operators.skew import spread
from tests.conftest import rows


def hot_rows(n=3000, seed=3):
    """A third of all rows belong to key 0."""
    rng = random.Random(seed)
    return [(0 if i % 3 == 0 else rng.randrange(1, 40), i, rng.randrange(-50, 50)) for i in range(n)]


def test_running_equals_window_for_any_chunk(spark):
    df = spark.createDataFrame(hot_rows(), "k int, pos int, v int")
    for inclusive in (True, False):
        w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        plain = rows(df.select("k", "pos", "v", F.coalesce(F.sum("v").over(w), F.lit(0)), F.max("v").over(w), F.min("v").over(w)))
        for size in (7, 500, 10**6):
            spec = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))}
            got = running(df, ["k"], [F.col("pos")], chunk_of(F.col("pos"), size), spec, inclusive)
            assert rows(got) == plain


def test_running_follows_the_data_without_a_rule(spark):
    """Range partitions are the chunks: a hot key is shared by many of them."""
    df = spark.createDataFrame(hot_rows(6000), "k int, pos int, v int").repartition(4)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    got = running(df, ["k"], [F.col("pos")], None, {"s": ("sum", F.col("v")), "_n": ("sum", F.lit(1))})
    assert rows(got) == rows(df.select("k", "pos", "v", F.sum("v").over(w), F.count("*").over(w)))
    down = numbered(df, ["k"], [F.desc("pos")], None, "n")
    assert rows(down) == rows(df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("pos"))) - 1))
    ranged = df.repartitionByRange(8, "k", "pos").withColumn("chunk", F.spark_partition_id())
    assert ranged.filter("k = 0").groupBy("chunk").count().agg(F.max("count")).first()[0] < 2000


def test_copies_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([("a",)] * 25_000 + [("b",)] * 3, "v string")
    got = number_copies(df, ["v"]).groupBy("v").agg(F.count("*"), F.min("copy"), F.max("copy"), F.countDistinct("copy"))
    assert rows(got) == [("a", 25_000, 0, 24_999, 25_000), ("b", 3, 0, 2, 3)]


def test_spread_keeps_every_pair_of_a_hot_key(spark):
    left = spark.createDataFrame([(0, i) for i in range(500)] + [(1, 1)], "k int, a int")
    right = spark.createDataFrame([(0, i) for i in range(20)] + [(1, 5), (2, 7)], "k int, b int")
    salted_left, salted_right = spread(left, right, ["k"], block=10)
    assert salted_left.filter("k = 0").select("_ls", "_rs").distinct().count() > 50
    got = salted_left.join(salted_right, ["k", "_ls", "_rs"]).select("k", "a", "b")
    assert rows(got) == rows(left.join(right, "k"))


def test_percentile_equals_numpy_in_both_branches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = {"one": rng.normal(size=4000), "two": rng.integers(0, 6, size=2001).astype(float), "few": np.array([3.0, 1.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double").cache()
    for small in (50_000, 100):
        monkeypatch.setattr(quantile, "SMALL_GROUP", small)
        monkeypatch.setattr(quantile, "MARGIN", 0.02)
        for p in (0.5, 0.9):
            got = dict(rows(quantile.exact_percentiles(df, ["k"], {"m": F.col("v")}, p)))
            for k, vs in data.items():
                assert abs(got[k] - float(np.percentile(vs, p * 100))) < 1e-12


def test_merge_intervals_touching_join_and_chunks_do_not_matter(spark):
    rng = random.Random(1)
    spans = [(rng.randrange(3), s, s + rng.randrange(1, 9)) for s in (rng.randrange(2000) for _ in range(400))] + [(9, 0, 5), (9, 5, 7), (9, 8, 9)]
    df = spark.createDataFrame(spans, "k int, start int, end int").withColumn("n", F.lit(1))
    wanted = []
    for k in {s[0] for s in spans}:
        current = None
        for _, a, b in sorted(s for s in spans if s[0] == k):
            if current and a <= current[1]:
                current[1], current[2] = max(current[1], b), current[2] + 1
            else:
                current = [a, b, 1]
                wanted.append((k, current))
    wanted = sorted((k, c[0], c[1], c[2]) for k, c in wanted)
    for width in (10.0, 300.0, 1e6):
        assert rows(merge_intervals(df, ["k"], chunk_width=width, sums=("n",))) == wanted
    assert (9, 0, 7, 2) in wanted


def test_small_keys_are_numbered_by_a_plain_window(spark):
    from palimpsest.operators.prefix import running

    data = [(k, i * 7 % n, i) for k, n in (("a", 40), ("b", 3), (None, 5), ("c", 25)) for i in range(n)]
    df = spark.createDataFrame(data, "k string, o int, v int")
    want = {}
    for k in {d[0] for d in data}:
        so_far, most = 0, None
        for _, o, v in sorted((d for d in data if d[0] == k), key=lambda d: d[1:]):
            want[k, o, v] = (so_far, most)
            so_far, most = so_far + v, v if most is None else max(most, v)
    values = {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}
    for whole in (65_536, 10):
        got = running(df, ["k"], [F.col("o"), F.col("v")], None, values, inclusive=False, whole=whole)
        assert {(r["k"], r["o"], r["v"]): (r["s"], r["m"]) for r in got.collect()} == want
    plan = running(df, ["k"], [F.col("o")], None, values)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_shuffles_have_room_for_the_rows(spark):
    from palimpsest.operators.regions import redaction_status
    from palimpsest.session import room_for

    name, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set(name, "2")
        assert room_for(spark.range(900)).count() == 900 and spark.conf.get(name) == "2"
        room_for(spark.range(901), 100)
        assert spark.conf.get(name) == "10"
        room_for(spark.range(5), 1)
        assert spark.conf.get(name) == "10"
        spark.conf.set(name, "2")
        regions = spark.range(2_500_000).selectExpr("id AS page", "0 AS x0", "0 AS y0", "1 AS x1", "1 AS y1")
        redaction_status(regions, spark.range(1).selectExpr("id AS page", "5 AS width", "5 AS height"), ["page"])
        assert spark.conf.get(name) == "3"
    finally:
        spark.conf.set(name, before)


def test_matching_asks_for_room_for_its_lines(spark, monkeypatch):
    from types import SimpleNamespace

    from palimpsest.plans import spatial_queries

    class Asked(Exception):
        pass

    def ask(df):
        raise Asked(df.count())

    monkeypatch.setattr(spatial_queries, "room_for", ask, raising=False)
    try:
        spatial_queries.matched(SimpleNamespace(lineitem=spark.range(7)))
    except Asked as asked:
        assert asked.args == (7,)
    else:
        raise AssertionError("no room asked for")
