"""Exact quantiles of many columns by counting: the values' bits are told apart 16 at a time, so no buffer holds a column."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 16


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; -0.0 is 0.0, NaN the greatest."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).astype(np.float64).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_bits(key: int) -> float:
    bits = key & (1 << 63) - 1 if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def _counter(wanted: list[tuple[int, int]], level: int):
    """wanted: (column, leading bits). Counts of the next digit of the values that begin so, a row for each that occurs."""

    def run(batches):
        counts = [np.zeros(1 << DIGIT, dtype=np.int64) for _ in wanted]
        for batch in batches:
            keys: dict[int, np.ndarray] = {}
            for k, (column, head) in enumerate(wanted):
                if column not in keys:
                    keys[column] = ordered_bits(batch.column(column).drop_null().to_numpy(zero_copy_only=False))
                found = keys[column]
                if level:
                    found = found[found >> np.uint64(64 - DIGIT * level) == np.uint64(head)]
                digits = found >> np.uint64(64 - DIGIT * (level + 1)) & np.uint64((1 << DIGIT) - 1)
                counts[k] += np.bincount(digits.astype(np.int64), minlength=1 << DIGIT)
        for k, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(c[at])], names=["k", "digit", "n"])

    return run


def exact_quantiles(df: DataFrame, columns: list[str], share: float = 0.5) -> dict[str, float | None]:
    """The quantile of each numeric column as percentile() gives it, between the two values beside its place; null where all are null.

    One pass counts, then four passes each settle 16 bits of the values at the wanted ranks. A task holds counts of
    65,536 digits for each rank, and the driver gets one row for each.
    """
    source = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sizes = source.agg(*[F.count(c) for c in source.columns]).first() if columns else ()
    ranks = []  # (column, rank)
    for i, n in enumerate(sizes):
        if n:
            ranks += [(i, r) for r in sorted({math.floor(share * (n - 1)), math.ceil(share * (n - 1))})]
    left, heads = [r for _, r in ranks], [0] * len(ranks)
    for level in range(64 // DIGIT if ranks else 0):
        wanted = sorted({(i, h) for (i, _), h in zip(ranks, heads)})
        counts = source.mapInArrow(_counter(wanted, level), "k long, digit long, n long").groupBy("k", "digit").agg(F.sum("n").alias("n"))
        places = {w: k for k, w in enumerate(wanted)}
        asked = df.sparkSession.createDataFrame([(j, places[i, h], r) for j, ((i, _), h, r) in enumerate(zip(ranks, heads, left))], "j long, k long, rank long")
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("digit"))  # at most 65,536 rows
        found = counts.withColumn("upto", upto).join(F.broadcast(asked), "k").where("upto > rank and upto - n <= rank").select("j", "digit", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
        for j, digit, rank in found.collect():  # one row for each rank
            heads[j], left[j] = heads[j] << DIGIT | digit, rank
    out: dict[str, float | None] = dict.fromkeys(columns)
    for i, c in enumerate(columns):
        ends = [from_bits(h) for (k, _), h in zip(ranks, heads) if k == i]
        if ends:
            place = share * (sizes[i] - 1)
            out[c] = ends[0] if len(ends) == 1 else ends[0] * (math.ceil(place) - place) + ends[1] * (place - math.floor(place))
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
