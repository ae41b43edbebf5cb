"""Recovery of stored tasks after a restart, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.lifecycle import recover


def recover_stream(tasks: DataFrame, out: str, state: str) -> StreamingQuery:
    """Write the recovered version of every task row that arrives; a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        recover(batch).write.mode("overwrite").parquet(f"{out}/{number}")

    return tasks.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
