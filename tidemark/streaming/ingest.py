"""Incremental ingest: files that arrive are merged by key into a table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.schemas import Table
from tidemark.sources.store import Resolver, load, upsert


def merge_stream(spark: SparkSession, source: str, target: str, checkpoint: str, table: Table, resolve: Resolver | None = None, order: str | None = None, buckets: int = 16) -> StreamingQuery:
    """Merge the Parquet files that arrive under source into target, all there are now, then stop.

    Within a batch the last row of a key by `order` counts. The merge is idempotent, so a batch that is
    delivered again after a failure changes nothing. A batch rewrites the buckets of the target that its keys fall in.
    """

    def put(batch: DataFrame, _: int) -> None:
        upsert(spark, target, table, last_of_each(batch.select(*table.schema.names), list(table.key), order), resolve, buckets=buckets)

    stream = spark.readStream.schema(table.schema).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_of_each(rows: DataFrame, key: list[str], order: str | None) -> DataFrame:
    """One row a key: the greatest by order, ties by all columns."""
    first = [F.desc_nulls_last(order)] if order else []
    w = Window.partitionBy(*key).orderBy(*first, *[F.asc(c) for c in rows.columns])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def affected_history(history: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """The whole timelines of the entities that changed rows touch: late data is handled by recomputing these."""
    return history.join(changed.select(*key).distinct(), key, "left_semi")


def current(spark: SparkSession, target: str, table: Table) -> DataFrame:
    return load(spark, target, table)
