"""Total orders over whole tables without one task that sorts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def in_order(df: DataFrame, *order: Column, name: str = "nth") -> DataFrame:
    """Adds each row's place in ``order``, from 1; rows that tie are numbered in any order.

    Rows are laid out by ranges of the order and numbered within each range; how many
    come before a range is added from a table of ranges, as long as there are partitions.
    """
    laid = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = laid.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))  # a row per partition
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return laid.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__range", "__own", "__before")
