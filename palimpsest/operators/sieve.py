"""A sieve that lets through what may stand on several pages, before anything is counted exactly.

Values are hashed to slots. A slot whose rows have two different page hashes is a set bit in a table of bitmaps, which is broadcast: its size
is `slots` / 8 bytes whatever the input. What stands on two pages passes, unless the pages agree in two hashes of 96 bits together; a
value of one page passes only where another value shares its slot. Nothing but whole numbers is shuffled for it, combined by slot inside
the tasks, and rows that do not pass are neither counted nor joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import cut_lineage

SLOTS = 1 << 26  # 8 MB of bitmaps; some eight slots per different value keep seven of eight single ones out
LARGEST = 1 << 30  # 128 MB are the most that is sent to every task


def slot(value: list[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*value), F.lit(slots))


def seen_twice(rows: DataFrame, value: list[str], page: list[str], slots: int = SLOTS) -> DataFrame:
    """(bucket, bits): bitmaps of the slots whose values stand on two pages or more. Written once."""
    if not 0 < slots <= LARGEST:
        raise ValueError(f"slots must be between 1 and {LARGEST}")
    ends = rows.select(slot(value, slots).alias("slot"), F.xxhash64(*page).alias("p"), F.hash(*page).alias("q")).groupBy("slot").agg(
        F.min(F.col("p")).alias("p0"), F.max(F.col("p")).alias("p1"), F.min(F.col("q")).alias("q0"), F.max(F.col("q")).alias("q1"))
    twice = ends.where("p0 <> p1 OR q0 <> q1").select("slot")
    place = twice.select(F.bitmap_bucket_number("slot").alias("bucket"), F.bitmap_bit_position("slot").alias("position"))
    return cut_lineage(place.groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bits")))


def marked(rows: DataFrame, value: list[str], sieve: DataFrame, name: str, slots: int = SLOTS) -> DataFrame:
    """`rows` with a flag that is true for what may stand on two pages, and for all that do."""
    place = slot(value, slots)
    byte = F.expr("substring(_bits, cast(_position div 8 as int) + 1, 1)")
    found = rows.withColumn("_position", F.bitmap_bit_position(place)).join(
        F.broadcast(sieve.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))), F.bitmap_bucket_number(place) == F.col("_bucket"), "left")
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (F.col("_position") % 8).cast("int"))
    return found.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("_position", "_bucket", "_bits")


def passing(rows: DataFrame, value: list[str], page: list[str], slots: int = SLOTS) -> DataFrame:
    """The rows whose value may stand on two pages or more, all that do among them."""
    return marked(rows, value, seen_twice(rows, value, page, slots), "_passes", slots).where("_passes").drop("_passes")
