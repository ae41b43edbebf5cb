"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

KEPT = 2  # objects a Python worker keeps; no operator needs more in one task


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only for local masters without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-llm-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table once and read it back: later readers neither recompute it nor depend on lost executors. It is removed
    when the driver ends."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)  # only what is there can be marked for removal
    files.deleteOnExit(place)
    df.write.option("compression", codec).parquet(f"{folder}/rows")
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def kept_in_worker(key: Any, make: Callable[[], Any]) -> Any:
    """An object made once per Python worker and key, such as a loaded vocabulary. A worker keeps the KEPT it used last,
    so what one operator leaves behind does not stay beside the next one's."""
    box = sys.__dict__.setdefault("_llm_objects", {})
    new = key not in box
    box[key] = make() if new else box.pop(key)
    while len(box) > KEPT:
        del box[next(iter(box))]
    if new:
        give_back()
    return box[key]


def give_back() -> None:
    """Return memory that a Python worker has freed to the system. Workers live on from stage to stage, and what
    an earlier operator needed at its peak would otherwise stay with them."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only the GNU library has it
        pass


def document_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of this session hold no more than `rows` rows: 10,000, the default, are too many whole documents
    for a worker that holds a batch as Arrow, as pandas and as Python strings at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
