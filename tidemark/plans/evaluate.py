"""Regression metrics, segments, cluster bootstraps and the evaluation of recorded predictions."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.parsing import bucket as bucketed
from tidemark.operators.scratch import written


def metrics(rows: DataFrame, predicted: str, target: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mae, rmse, r2 (null where the target does not vary) and bias."""
    d, y = F.col(predicted) - F.col(target), F.col(target)
    spread = F.var_pop(y)
    return rows.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), (1 - F.try_divide(F.avg(d * d), F.when(spread > 0, spread))).alias("r2"), F.avg(d).alias("bias"))


def segment_labels() -> dict[str, Column]:
    return {
        "minutes": bucketed("minutes", [(10, "<10"), (20.0000001, "10-20")], ">20", "none"),
        "prior": bucketed("games_played_total", [(5, "<5")], ">=5", "none"),
        "phase": F.when(F.col("phase").isNull(), "unknown").when(F.col("phase") == "RS", "RS").otherwise("other"),
    }


def segments(rows: DataFrame, predictors: list[str], target: str, labels: dict[str, Column] | None = None) -> DataFrame:
    """(segment, label, n, mae of each predictor), the segmentations in one pass."""
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), v.alias("label")) for k, v in (labels or segment_labels()).items()]))
    spread = rows.select(target, *predictors, made.alias("s")).select(target, *predictors, "s.*")
    return spread.groupBy("segment", "label").agg(F.count("*").alias("n"), *[F.avg(F.abs(F.col(p) - F.col(target))).alias(f"mae_{p}") for p in predictors])


def comparison(parts: dict[str, DataFrame], predictors: list[str], target: str) -> DataFrame:
    """(split, predictor, mae) of every predictor in every split."""
    stacked = [df.select(F.lit(k).alias("split"), F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.abs(F.col(p) - F.col(target)).alias("e")) for p in predictors])).alias("x")) for k, df in parts.items()]
    return reduce(DataFrame.unionByName, stacked).groupBy("split", "x.predictor").agg(F.avg("x.e").alias("mae"))


def drawn_from(bucket: int, sizes: list[int], rounds: int, seed: int) -> np.ndarray:
    """How many of each round's draws fall on a bucket, when as many as there are clusters are drawn evenly with
    replacement: the draws are split binomially down a tree of buckets, whose nodes have generators of their own, so
    every task finds its own number and all of a round's numbers add up."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    low, high, node, left = 0, len(sizes), 1, np.full(rounds, upto[-1], dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        whole = upto[high] - upto[low]
        first = np.random.default_rng([seed, 1, node]).binomial(left, (upto[middle] - upto[low]) / whole if whole else 0.0)
        left, low, high, node = (first, low, middle, 2 * node) if bucket < middle else (left - first, middle, high, 2 * node + 1)
    return left


def _drawn(sizes: list[int], rounds: int, seed: int):
    """A bucket's clusters -> their share of every round: (round, drawn, sum, number)."""

    def run(clusters: pd.DataFrame) -> pd.DataFrame:
        bucket = int(clusters["_bucket"].iloc[0])
        clusters = clusters.sort_values("_key", kind="stable")
        s, n, size = clusters["s"].to_numpy(float), clusters["n"].to_numpy(float), len(clusters)
        draws = drawn_from(bucket, sizes, rounds, seed)
        rng = np.random.default_rng([seed, 0, bucket])
        sums = np.zeros((rounds, 2))
        for i, k in enumerate(draws):
            picks = rng.integers(0, size, k)
            sums[i] = s[picks].sum(), n[picks].sum()
        return pd.DataFrame({"i": np.arange(rounds), "drawn": draws, "s": sums[:, 0], "n": sums[:, 1]})

    return run


#: Clusters of a bucket, about: one task holds them.
BUCKET = 20_000


def bootstrap_rounds(rows: DataFrame, value: Column, cluster: list[str], rounds: int = 1000, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """(i, drawn, s, n): each round's draws of whole clusters, evenly and with replacement, as many as there are; the sum
    and number of the values drawn. Clusters are summed first and dealt into buckets by hash; a bucket's part of every
    round is drawn in one task, and no draw is listed."""
    sums = rows.where(value.isNotNull()).groupBy(*cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    key = F.xxhash64(*cluster)
    sums = written(sums.select(key.alias("_key"), F.col("s").cast("double").alias("s"), "n"), "clusters")
    buckets = max(1, -(-sums.count() // bucket))
    sums = sums.withColumn("_bucket", F.pmod("_key", F.lit(buckets)).cast("int"))
    found = dict(sums.groupBy("_bucket").count().collect())  # one row for each bucket
    sizes = [found.get(b, 0) for b in range(buckets)]
    parts = sums.groupBy("_bucket").applyInPandas(_drawn(sizes, rounds, seed), "i int, drawn long, s double, n double")
    return parts.groupBy("i").agg(F.sum("drawn").alias("drawn"), F.sum("s").alias("s"), F.sum("n").alias("n"))


def cluster_bootstrap(rows: DataFrame, value: Column, cluster: list[str], rounds: int = 1000, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """(mean, low, high, share_below): the mean of value, and what it is with clusters drawn with replacement."""
    per_round = bootstrap_rounds(rows, value, cluster, rounds, seed, bucket).select(F.try_divide("s", "n").alias("m"))
    whole = rows.agg(F.avg(value).alias("mean"))
    spread = per_round.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), (F.count_if(F.col("m") < 0) / F.count("*")).alias("share_below"))
    return whole.crossJoin(spread)  # one row each


def mae_difference(rows: DataFrame, a: str, b: str, target: str, cluster: list[str], **options) -> DataFrame:
    """Paired: the error of a less that of b."""
    return cluster_bootstrap(rows, F.abs(F.col(a) - F.col(target)) - F.abs(F.col(b) - F.col(target)), cluster, **options)


def recorded(predictions: DataFrame, games: DataFrame, player_games: DataFrame, version: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Each recorded prediction with its status: pending, appeared, dnp or not_in_boxscore (first match wins)."""
    if version:
        predictions = predictions.where(F.col("model_version") == version)
    if since:
        predictions = predictions.where(F.col("as_of") >= F.lit(since).cast("date"))
    if until:
        predictions = predictions.where(F.col("as_of") <= F.lit(until).cast("date"))
    actual = player_games.select("season", "gamecode", "player_id", F.col("fantasy_score").alias("actual_fantasy"), "dnp", "minutes")
    joined = predictions.join(games.select("season", "gamecode", "game_date", "played"), ["season", "gamecode"]).join(actual, ["season", "gamecode", "player_id"], "left")
    status = F.when(~F.col("played"), "pending").when(F.col("dnp").isNull(), "not_in_boxscore").when(F.col("dnp") | (F.col("minutes") <= 0), "dnp").otherwise("appeared")
    return joined.withColumn("status", status)


def summary(evaluated: DataFrame, by: tuple[str, ...] = ("model_version",)) -> DataFrame:
    d = F.col("predicted_fantasy") - F.col("actual_fantasy")
    of = lambda s, x: F.when(F.col("status").isin(*s), x)
    return evaluated.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "appeared", "dnp", "not_in_boxscore")],
        F.avg(of(["appeared"], F.abs(d))).alias("mae"),
        F.avg(of(["appeared"], d)).alias("bias"),
        F.avg(of(["appeared", "dnp"], F.abs(d))).alias("mae_with_dnp"),
    )


def latest_of_each(predictions: DataFrame) -> DataFrame:
    """The last recorded prediction for each player, game and version."""
    w = Window.partitionBy("player_id", "season", "gamecode", "model_version").orderBy(F.desc("as_of"), F.desc("created_at"))
    return predictions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
