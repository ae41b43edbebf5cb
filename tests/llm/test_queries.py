"""Every operator query against its SQL, and the pipeline against plain Python, on the smallest tables."""

import zlib

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from palimpsest.llm.oracles import ORACLES
from palimpsest.llm.queries import QUERIES
from tests.llm.test_near import plain_near
from tests.llm.test_text import plain_lines
from tools.compare import TABLES, plain

FOLDER = "/root/testdata/sf0.001"


def test_the_driver_sees_them():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontamination", "tokens"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    frame = con.sql(ORACLES[name])
    assert sorted(frame.columns) == columns
    index = [frame.columns.index(c) for c in columns]
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    assert got == sorted(tuple(plain(row[i]) for i in index) for row in frame.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_over_whole_tables(spark, name):
    table = {"op2_site_tree": "pages", "op8_quotes": "conversations"}.get(name, "documents")
    df = QUERIES[name](spark, FOLDER)
    assert df.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_folds():
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(4)].count(True) in range(5)


def test_pipeline(spark, tmp_path):
    """Each stage against plain Python on its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, FOLDER)
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        old, new = before.orderBy("doc_id").collect(), after.orderBy("doc_id").collect()
        if name != "tokens":
            assert after.columns == docs.columns
        if name == "language":
            gone = {r["doc_id"] for r in old} - {r["doc_id"] for r in new}
            assert len(gone) <= len(old) // 50
        elif name == "line_dedup":
            assert [r["text"] for r in new] == [t for t, _, _ in plain_lines([r["text"] for r in old], 10)]
        elif name == "near_dedup":
            assert sorted(str(r["doc_id"]) for r in new) == plain_near([r["text"] for r in old], [r["doc_id"] for r in old])
        elif name == "decontamination":
            import re

            items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            runs = {tuple(w[i:i + 8]) for w in items for i in range(len(w) - 7)}
            left = {r["doc_id"] for r in new}
            for r in old:
                words = re.findall(r"\w+", r["text"].lower())
                n = sum(tuple(words[i:i + 8]) in runs for i in range(len(words) - 7))
                assert (r["doc_id"] in left) == (n == 0) or 0 < n < 8
        else:
            import hashlib

            assert [hashlib.sha256(r["text"].encode()).hexdigest() for r in old] == [r["decoded_sha256"] for r in new]
        before = after
