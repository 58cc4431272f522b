"""Places of rows in one order of a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.session import materialize


def numbered(rows: DataFrame, order: list[str | Column], name: str, weight: Column | None = None) -> DataFrame:
    """Adds ``name``: how many rows (or how much ``weight``) come before the row in ``order``, which should have no ties.

    Rows are dealt out by ranges of the order; each range is summed by itself, and the sums of the ranges before it,
    one row for each task, are added.
    """
    step = F.lit(1).cast("long") if weight is None else weight.cast("long")
    held = rows.withColumn("_w", step).repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialize(held.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)), "ordered")
    sums = held.groupBy("_p").agg(F.sum("_w").alias("_s"))
    before = sums.withColumn("_b", F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")  # one row for each range
    inner = F.coalesce(F.sum("_w").over(W.partitionBy("_p").orderBy("_m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("_i", inner).join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_w", "_m", "_p", "_b", "_i")
