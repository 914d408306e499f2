"""Dealing rows out by ranges of an integer id, without a second run of what made them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ship_by_value

#: Stands for a null id in the order, before all others.
LEAST = -(1 << 63)


def long_ids(df: DataFrame, id_col: str):
    """The id as a long; a table whose ids are not integers is refused, so that no row is lost by a cast."""
    if not isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col}: ids must be integers, found {df.schema[id_col].dataType.simpleString()}")
    return F.col(f"`{id_col}`").cast("long")


def range_count(df: DataFrame, text_col: str, range_bytes: int) -> int:
    """As many ranges as hold about range_bytes of text each, two for each shuffle partition at least."""
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    return max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / range_bytes))


def range_bounds(df: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most parts - 1 ascending bounds that deal the ids out about evenly; range k holds bounds[k-1] <= id < bounds[k].

    Reads the id column alone; the sketch has 8 * parts entries at most whatever the input. Nulls go to range 0.
    """
    ids = df.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    if parts < 2:
        return []
    found = ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 8 * parts)).first()[0]
    return sorted(set(found or []))


def keys_of(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(LEAST).to_numpy(zero_copy_only=False)


def range_of(ids: np.ndarray, bounds: list[int]) -> np.ndarray:
    return np.searchsorted(np.array(bounds, np.int64), ids, side="right").astype(np.int32)


ship_by_value(__name__)
