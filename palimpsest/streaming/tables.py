"""Running a stream over a folder and reading back what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import working_folder


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state with timers needs; the session's setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def read_folder(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The files of a table as a stream, with the schema of the stored files."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    # A pattern instead of the bare name, because a stream reads folders or patterns.
    pattern = f"{folder}/{table[:-1]}[{table[-1]}].parquet"
    return spark.readStream.schema(schema).parquet(pattern)


def latest(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an update-mode stream over all present input and return the last version of each row.

    Every micro-batch writes its changed rows with its number; a batch that is run
    again after a failure replaces its own folder.
    """
    spark = stream.sparkSession
    root = working_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/{number}")

    with state_store(spark):
        query = (stream.writeStream.outputMode("update").foreachBatch(write)
                 .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/out")
    values = [c for c in rows.columns if c not in keys and c != "_batch"]
    return rows.groupBy(*keys).agg(F.max(F.struct("_batch", *values)).alias("_v")).select(*keys, *[f"_v.{c}" for c in values])


def appended(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream over all present input and return its rows."""
    spark = stream.sparkSession
    root = working_folder(spark, name)
    with state_store(spark):
        query = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
                 .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def in_turns(arrivals: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The rows of an append-mode stream to which tables of one schema arrive one after the other.

    The stream starts anew from its checkpoint for each of them, as after a restart, and its watermark moves on in between.
    """
    spark = arrivals[0].sparkSession
    root = working_folder(spark, name)
    stream = build(spark.readStream.schema(arrivals[0].schema).parquet(f"{root}/in/*"))
    for number, rows in enumerate(arrivals):
        rows.write.mode("overwrite").parquet(f"{root}/in/{number}")
        with state_store(spark):
            query = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
                     .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
