"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v), each linked couple once with u > v. Hangs neighbours below the least one."""
    if large:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return moved.where("u > v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of orderable ids -> (id, root), root the least id reachable; ids without a link do not appear.

    Self links and nulls are ignored. A round only hangs ids below lesser ones, so the rounds end (after about the
    square of the logarithm of the longest chain); one that changes nothing is the last. Every round is checkpointed to the shared folder; minima are
    pre-aggregated on the map side, so a hub with many neighbours does not meet in one task.
    """
    pairs = pairs.where("a is not null and b is not null and a <> b")
    pairs = checkpointed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        pairs = checkpointed(_star(_star(pairs, large=True), large=False))
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
                pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
        state = now
