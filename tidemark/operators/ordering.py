"""Positions in a total order over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scratch import written


def numbered(df: DataFrame, order: list[Column | str], out: str = "no", parts: int | None = None) -> DataFrame:
    """Add out: 1, 2, ... in the given order, which must be total.

    Rows are dealt into ranges of the order, numbered there, and moved on by the rows of the ranges before (one
    count a range). The ranges are written, since a second sampling might deal them otherwise.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(bases), "_range").withColumn(out, (F.col("_base") + within).cast("long")).drop("_range", "_base")
