"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "palimpsest", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Partition counts are left to adaptive execution: the shuffle starts wide
    and is coalesced from measured sizes, so one setting serves 1 GB and 100 TB.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only local masters may do without: executors
    elsewhere would each see another local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='spark-palimpsest-', dir='/tmp')}"
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared location, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)  # only what is there can be marked for removal
    files.deleteOnExit(place)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a result once as parquet to the shared folder and read it back: lost executors and later readers
    neither recompute it nor see a different version of it, and later reads take only the columns they need."""
    path = working_folder(df.sparkSession, "step") + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def room_for(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Let shuffles of this session have a partition for each `rows` rows of a table at least. Adaptive execution joins those that turn out
    small; without it a task's memory grows with the table where a session is set to few partitions."""
    conf, name = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    needed = -(-df.count() // rows)
    if int(conf.get(name)) < needed:
        conf.set(name, str(needed))
    return df
