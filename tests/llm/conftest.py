import pytest

from tests.conftest import rows, spark  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):  # noqa: F811
    """A table of files from texts; ids count from 0 unless given. Files, because block operators read their input twice."""
    import tempfile

    def make(texts, ids=None, **more):
        ids = list(range(len(texts))) if ids is None else ids
        data = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
        folder = tempfile.mkdtemp(prefix="spark-test-", dir="/tmp")
        frame = spark.createDataFrame(data, SCHEMA)
        for name, value in more.items():
            from pyspark.sql import functions as F

            frame = frame.withColumn(name, F.lit(value))
        frame.coalesce(2).write.mode("overwrite").parquet(folder)
        return spark.read.parquet(folder)

    return make
