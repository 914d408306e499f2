"""Mixing sources to target weights: temperature, bisected, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, small_table


@dataclass(frozen=True)
class Mixture:
    """exponent: 1 keeps the sources' token shares, 0 makes them equal. budget: tokens to emit in all."""

    exponent: float
    weights: dict[str | None, float]
    tokens: dict[str | None, int]
    budget: int


def tempered(tokens: dict[str | None, int], exponent: float) -> dict[str | None, float]:
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent for s, n in tokens.items() if n > 0}
    norm = sum(raised.values())
    return {s: x / norm for s, x in raised.items()}


def entropy(weights: dict[str | None, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def repetition(tokens: dict[str | None, int], weights: dict[str | None, float], budget: float) -> float:
    """The most often any source's tokens are used."""
    return max(budget * w / tokens[s] for s, w in weights.items())


def solve(tokens: dict[str | None, int], target_entropy: float | None = 0.95, max_repetition: float | None = 4.0, budget: int | None = None, steps: int = 60) -> Mixture:
    """The exponent in [0, 1] by bisection; tokens by source.

    target_entropy: as a share of the entropy of equal weights (the exponent 1 where the sources have it
    anyway). max_repetition: a limit on how often a source's tokens are used, met by raising the exponent.
    budget: tokens in all; None: the least with which no source loses a token, so that every document
    appears at least once. Entropy falls and the least repetition rises as the exponent falls.
    """
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens:
        return Mixture(1.0, {}, {}, 0)

    def spent(weights):
        return budget if budget is not None else max(tokens[s] / w for s, w in weights.items())

    def bisect(fits):  # the least exponent that fits; 1 fits or nothing does
        if fits(0.0):
            return 0.0
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fits(mid) else (mid, hi)
        return hi

    exponent = 1.0
    if target_entropy is not None:
        goal = target_entropy * math.log(len(tokens))
        over = bisect(lambda a: entropy(tempered(tokens, a)) <= goal)  # the exponent at which entropy falls to the goal
        exponent = 1.0 if entropy(tempered(tokens, 1.0)) >= goal else over
    if max_repetition is not None:
        within = lambda a: repetition(tokens, tempered(tokens, a), spent(tempered(tokens, a))) <= max_repetition + 1e-9
        if not within(exponent):
            exponent = max(exponent, bisect(within))
    weights = tempered(tokens, exponent)
    return Mixture(exponent, weights, tokens, math.ceil(spent(weights) - 1e-6))


def count_tokens(text_col: str = "text"):
    """Words of the text (ASCII white space apart), at least 1, so that an empty text can be drawn too."""
    return F.greatest(F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(1).cast("long"))


def token_shares(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> dict[str | None, int]:
    """One entry a source; null is a source of its own."""
    rows = docs.select(F.col(source_col).cast("string").alias("s"), count_tokens(text_col).alias("n")).groupBy("s").agg(F.sum("n").alias("n"))
    return {r["s"]: int(r["n"]) for r in rows.collect()}


def _quota(wanted: float, total: int) -> float:
    """Whole uses of all tokens where wanted lies within rounding of them, so that no row is used once more for a part of a token."""
    uses = round(wanted / total)
    return float(uses * total) if uses and abs(wanted - uses * total) < 1 + 1e-8 * wanted else float(wanted)


def draw(docs: DataFrame, mixture: Mixture, seed: int = 42, block_tokens: int = 2_000_000, bins: int = 256, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row, id_col, source_col, n_tokens, epoch, block, position): one row for each use of a row of docs.

    Source s gets weights[s] * budget tokens. Its rows are permuted anew in every epoch by a hash of (seed,
    epoch, id, row); whole epochs come first, then the rows of the last epoch's permutation that start within
    what is left. A source's stream is spread evenly over the blocks of the mixture (its share of every block
    is its weight, but for one document), and position orders a block by another hash.

    Prefix sums follow the permutation's leading bits: each source and epoch has `bins` bins of random rows,
    whose sums (bins rows a source) are added up first, so a hot source is never in one task. Rows that share
    an id, also with the same text, are drawn each by itself. A source without weight is not drawn. row_col: a
    unique number of each row that docs has already; else rows are numbered as they lie.
    """
    spark = docs.sparkSession
    rows = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), id_col, source_col, count_tokens(text_col).alias("n_tokens"))
    rows = materialise(rows.withColumn("s", F.col(source_col).cast("string")), "mixing-rows")
    quotas = [(s, _quota(w * mixture.budget, mixture.tokens[s]), mixture.tokens[s]) for s, w in mixture.weights.items()]
    quota = small_table(spark, quotas, "q_s string, quota double, total long")
    blocks = max(1, math.ceil(mixture.budget / block_tokens))
    most = rows.groupBy("s").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bins = max(bins, math.ceil(most / 100_000))
    used = rows.join(quota, F.col("s").eqNullSafe(F.col("q_s")))  # one row a source
    epochs = F.ceil(F.col("quota") / F.col("total") - 1e-12)
    used = used.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(epochs - 1, F.lit(0)))))
    used = used.withColumn("h", F.xxhash64(F.lit(seed), "epoch", id_col, "row")).withColumn("bin", F.pmod(F.shiftright("h", 20), F.lit(bins)))
    sums = used.groupBy("s", "epoch", "bin").agg(F.sum("n_tokens").alias("sum"))
    ahead = Window.partitionBy("s").orderBy("epoch", "bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("s").alias("b_s"), F.col("epoch").alias("b_e"), F.col("bin").alias("b_b"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("s", "epoch", "bin").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = used.join(bases, F.col("s").eqNullSafe(F.col("b_s")) & (F.col("epoch") == F.col("b_e")) & (F.col("bin") == F.col("b_b")))
    placed = placed.withColumn("at", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    drawn = placed.where(F.col("at") < F.col("quota") - 1e-6)
    block = F.least(F.floor(F.col("at") / F.col("quota") * blocks), F.lit(blocks - 1)).cast("long")
    return drawn.select("row", id_col, source_col, "n_tokens", "epoch", block.alias("block"), F.xxhash64(F.lit(seed + 1), "epoch", id_col, "row").alias("position"))


def mix(
    docs: DataFrame, target_entropy: float | None = 0.95, max_repetition: float | None = 4.0, budget: int | None = None, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", places: bool = False
) -> DataFrame:
    """docs with each row repeated as often as it is drawn, all its columns and no others. Empty tables stay empty.

    places: with a column `place` too, the struct (epoch, block, position) of draw, by which a reader can order the
    repeated rows; a clash with a column of that name is an error.
    """
    if places and "place" in docs.columns:
        raise ValueError("docs has a column place already")
    mixture = solve(token_shares(docs, source_col, text_col), target_entropy, max_repetition, budget)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.monotonically_increasing_id().alias("row"))
    if not mixture.weights:
        return docs.withColumn("place", F.lit(None).cast("struct<epoch:bigint,block:bigint,position:bigint>")) if places else docs
    whole = materialise(whole, "mixing-docs")
    flat = whole.select("row", F.col(f"d.`{id_col}`").alias("k"), F.col(f"d.`{source_col}`").alias("s_"), F.col(f"d.`{text_col}`").alias("t"))
    drawn = draw(flat, mixture, seed, id_col="k", source_col="s_", text_col="t", row_col="row")
    uses = drawn.groupBy("row").agg(F.collect_list(F.struct("epoch", "block", "position")).alias("uses"))  # one entry an epoch
    return whole.join(uses, "row").select("d", F.explode("uses").alias("place")).select("d.*", *["place"] * places)
