"""Joins with checked keys, outer arithmetic, precedence unions, pages and ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import numbered
from tidemark.schemas import assert_columns


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unique(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """df, after an error where its key repeats."""
    if not duplicate_keys(assert_columns(df, key, label), key).isEmpty():
        raise ValueError(f"{label}: {', '.join(key)} repeats")
    return df


def validated_left_join(left: DataFrame, right: DataFrame, on: list[str], label: str = "right") -> DataFrame:
    """Left join whose right key must be unique, so the rows of left stay as many."""
    return left.join(unique(right, on, label), on, "left")


def flagged_outer_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join with a column side: both, left_only or right_only."""
    joined = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), on, "full_outer")
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return joined.withColumn("side", side).drop("_l", "_r")


def outer_difference(a: DataFrame, b: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """a - b for each value over the union of their keys, a missing side as 0."""
    joined = a.select(*on, *[F.col(v).alias(f"_a_{v}") for v in values]).join(b.select(*on, *[F.col(v).alias(f"_b_{v}") for v in values]), on, "full_outer")
    return joined.select(*on, *[(F.coalesce(f"_a_{v}", F.lit(0)) - F.coalesce(f"_b_{v}", F.lit(0))).alias(v) for v in values])


def latest(df: DataFrame, key: list[str], order: list[Column | str], values: list[str]) -> DataFrame:
    """Each key's values in the last row of a total order; nulls of a value are skipped, nulls of the order come last."""
    ranked = F.struct(*[F.struct((F.col(o) if isinstance(o, str) else o).isNull().alias("_n"), (F.col(o) if isinstance(o, str) else o).alias("_v")) for o in order])
    return df.groupBy(*key).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), ranked)).alias(v) for v in values])


def first_by_precedence(parts: list[DataFrame], key: list[str], ties: list[str]) -> DataFrame:
    """UNION ALL of the parts; of rows with equal key the one of the earliest part stays, then the first by ties."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    first = Window.partitionBy(*key).orderBy("_part", *ties)
    return every.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "_part")


def latest_row(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def ranked(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Position in the whole order, which must be total, whatever page is cut later."""
    return numbered(df, order, out)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit of the order, each with the total before paging."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # total: one row


def capped_top(df: DataFrame, group: str, order: list[Column], per_group: int, limit: int) -> DataFrame:
    """The greedy choice of limit rows in order with at most per_group of a group: group ranks first, then the top."""
    within = df.withColumn("_g", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_g") <= per_group)
    return within.drop("_g").orderBy(*order).limit(limit)


def lineup_total(picks: DataFrame, order: list[Column], value: str, starters: int = 6) -> DataFrame:
    """Total of the picks: the first counts twice, the other starters once, the bench half."""
    place = F.row_number().over(Window.orderBy(*order))  # a line-up of ten
    weight = F.when(F.col("_p") == 1, 2.0).when(F.col("_p") <= starters, 1.0).otherwise(0.5)
    return picks.withColumn("_p", place).agg(F.sum(F.col(value) * weight).alias("total"), F.count("*").alias("picks"))


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): the sum of the rows' md5 prefixes modulo 2^64, whatever their order.

    A value is led by its length, a null is a bare tilde, so no two rows read alike.
    """
    text = F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~")) for c in columns])
    hashed = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.pmod(F.sum(hashed), F.expr("cast(18446744073709551616 as decimal(38,0))")).cast("decimal(38,0)").cast("string").alias("digest"))


def fast_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """As content_digest, by xxhash64."""
    hashed = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.pmod(F.sum(hashed), F.expr("cast(18446744073709551616 as decimal(38,0))")).cast("string").alias("digest"))
