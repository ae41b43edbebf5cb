"""How the given tables stand in for boxes, frames and masks, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.identity import number_copies
from palimpsest.plans.registry import Tables


def cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def boxes(t: Tables, *extra: str | Column) -> DataFrame:
    """Line items as boxes on the page of their order."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    x0, y0 = part % 40, supp % 30
    return t.lineitem.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 4 + supp % 16).alias("x1"), (y0 + 4 + part % 12).alias("y1"), *extra)


BOXES = """
boxes AS (SELECT l_orderkey AS page, l_linenumber AS line, l_partkey % 40 AS x0, l_suppkey % 30 AS y0,
  l_partkey % 40 + 4 + l_suppkey % 16 AS x1, l_suppkey % 30 + 4 + l_partkey % 12 AS y1, * FROM lineitem)
"""


def placed(rows: DataFrame) -> DataFrame:
    """Line items with their box added."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    x0, y0 = part % 40, supp % 30
    return rows.withColumns({"page": F.col("l_orderkey"), "x0": x0, "y0": y0, "x1": x0 + 4 + supp % 16, "y1": y0 + 4 + part % 12})


def identified(rows: DataFrame) -> DataFrame:
    """Placed line items with an identity: the row's own values and a number among equal rows."""
    known = number_copies(rows, rows.columns)
    key = F.concat_ws("-", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), cents("l_quantity"),
                      cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), F.col("l_returnflag"),
                      F.col("l_linestatus"), F.date_format("l_shipdate", "yyyyMMdd"), F.col("copy"))
    return known.select("page", "x0", "y0", "x1", "y1", key.alias("row_id"), cents("l_extendedprice").alias("price"),
                        (cents("l_discount") / 10).alias("confidence"))


KNOWN = BOXES + """,
known AS (SELECT page, line, x0, y0, x1, y1, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
  CAST(round(l_discount * 100) AS BIGINT) / 10 AS confidence,
  concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity * 100) AS BIGINT),
   CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
   l_returnflag, l_linestatus, strftime(l_shipdate, '%Y%m%d'),
   row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
     l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1) AS row_id FROM boxes)
"""


def frames(t: Tables, *extra: str | Column) -> DataFrame:
    """Orders as page frames."""
    return t.orders.select(F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 8 + 50).alias("width"),
                           (F.col("o_custkey") % 6 + 38).alias("height"), *extra)


FRAMES = """
frames AS (SELECT o_orderkey AS page, o_custkey % 8 + 50 AS width, o_custkey % 6 + 38 AS height, * FROM orders)
"""


def candidates(t: Tables, *extra: str | Column) -> DataFrame:
    """One candidate box per order."""
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    x0, y0 = cust % 40, cust % 30
    return t.orders.select(order.alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 4 + order % 16).alias("x1"),
                           (y0 + 4 + order % 12).alias("y1"), *extra)


CANDIDATES = """
cands AS (SELECT o_orderkey AS page, o_custkey % 40 AS x0, o_custkey % 30 AS y0, o_custkey % 40 + 4 + o_orderkey % 16 AS x1,
  o_custkey % 30 + 4 + o_orderkey % 12 AS y1, * FROM orders)
"""

PAIR_AREA = ("greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * "
             "greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))")
PAIR_OVERLAP = "a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0"
PAIR_IOU = (f"({PAIR_AREA}) / ((a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) - ({PAIR_AREA}))")
