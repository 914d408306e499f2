"""What the corpus operators share: scratch tables, worker code shipped by value, the held-out rule, prefix sums."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.scratch import clear_scratch, scratch_path, shared_dir, written

__all__ = ["checkpointed", "clear_scratch", "documents", "fold", "materialise", "ordered_offsets", "scratch_path", "shared_dir", "ship_by_value", "small_table"]

#: Write a table to the shared folder and read it back.
materialise = written


def ship_by_value(module: str) -> None:
    """Pickle the module's functions whole, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Small tables are broadcast up to this many rows; they are counted before.
BROADCAST_ROWS = 100_000


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows the driver holds, marked for broadcast where they are at most BROADCAST_ROWS; beyond, Spark joins as usual."""
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= BROADCAST_ROWS else made


def fold(id_col: Column | str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % folds


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ordered_offsets(df: DataFrame, order: list[str], size: str, out: str, parts: int | None = None) -> DataFrame:
    """Add out: the sum of size over all rows before this one in the total order of the given columns.

    Rows are range-partitioned and written once; the partitions' totals (one row each) are summed in
    order and joined back, so no task sees more than its own range. order must be unique by row.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum(size).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    return (
        ranged.join(F.broadcast(bases), "_range")  # one row for each of at most `parts` ranges
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(size).over(within), F.lit(0)))
        .drop("_range", "_base")
    )


ship_by_value(__name__)
