"""Numbers of rows in an order, without a sort of all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.session import parts_of, stored


def positions(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with pos from 0 in an order that leaves no ties (by key, if none is given).

    Rows are dealt by ranges of the order and kept, so that ranges do not change; each range is numbered on its own,
    from an offset summed over the ranges' counts, a row each.
    """
    order = order or ("key",)
    n = parts_of(rows)
    dealt = stored(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("__part").orderBy(*order)
    return dealt.withColumn("__r", F.row_number().over(inside)).join(F.broadcast(offsets), "__part").withColumn("pos", F.col("__o") + F.col("__r") - 1).select(*rows.columns, "pos")
