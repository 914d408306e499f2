"""Gradient boosting over binned features: histograms of gradient and curvature are summed in Spark, split on the driver."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scratch import discard, written

#: The bin of nulls; other bins are at most as many.
MISSING = 255
#: After so many rounds the margins are written anew, so that a pass evaluates few trees.
REWRITE = 10


@dataclass(frozen=True)
class Settings:
    """loss: "pseudo_huber" (slope is where it turns from square to straight) or "squared". penalty and min_weight weigh curvature; shares are of rows and columns, drawn anew each round."""

    loss: str = "pseudo_huber"
    slope: float = 5.0
    step: float = 0.1
    depth: int = 4
    rounds: int = 200
    patience: int = 30
    min_weight: float = 20.0
    penalty: float = 5.0
    share_rows: float = 0.8
    share_columns: float = 0.8
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """A complete binary tree by heap index; feature -1 ends. Bins up to cut go left, nulls where missing_left says."""

    feature: list[int]
    cut: list[int]
    missing_left: list[bool]
    value: list[float]

    def leaves(self, binned: np.ndarray, depth: int) -> np.ndarray:
        at, rows = np.zeros(len(binned), dtype=np.int64), np.arange(len(binned))
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.missing_left)
        for _ in range(depth):
            f = feature[at]
            b = binned[rows, np.maximum(f, 0)]
            goes_left = np.where(b == MISSING, left[at], b <= cut[at])
            at = np.where(f < 0, at, 2 * at + 2 - goes_left)
        return at

    def margins(self, binned: np.ndarray, depth: int) -> np.ndarray:
        return np.array(self.value)[self.leaves(binned, depth)]


@dataclass
class Boosted:
    """The sum of a base and the trees' values."""

    columns: list[str]
    base: float
    edges: list[list[float]]
    trees: list[Tree]
    depth: int

    def predict_binned(self, binned: np.ndarray) -> np.ndarray:
        return self.base + sum((t.margins(binned, self.depth) for t in self.trees), np.zeros(len(binned)))

    def column(self) -> Column:
        """The prediction from the columns of a row."""

        @F.pandas_udf("double")
        def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for rows in batches:
                yield pd.Series(self.predict_binned(bin_values(rows.to_numpy(dtype=float), self.edges)))

        return predicted(F.struct(*[F.col(c).cast("double").alias(c) for c in self.columns]))

    def gains(self) -> np.ndarray:
        """How often each column splits."""
        return np.bincount([f for t in self.trees for f in t.feature if f >= 0], minlength=len(self.columns)).astype(float)

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(told: dict) -> Boosted:
        return Boosted(told["columns"], told["base"], told["edges"], [Tree(**t) for t in told["trees"]], told["depth"])


def bin_values(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The number of edges below each value; nulls and NaN have a bin of their own."""
    out = np.empty(values.shape, dtype=np.uint8)
    for k, e in enumerate(edges):
        out[:, k] = np.where(np.isnan(values[:, k]), MISSING, np.searchsorted(e, values[:, k], side="left"))
    return out


def gradients(margin: np.ndarray, y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, curvature and loss of each row."""
    z = margin - y
    if s.loss == "squared":
        return z, np.ones_like(z), z * z / 2
    if s.loss != "pseudo_huber":
        raise ValueError(f"unknown loss {s.loss}")
    bend = 1 + (z / s.slope) ** 2
    return z / np.sqrt(bend), 1 / (bend * np.sqrt(bend)), s.slope**2 * (np.sqrt(bend) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A uniform number in [0, 1) from each unsigned integer."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ x >> np.uint64(33)) >> np.uint64(11)).astype(float) / 2**53


def drawn_rows(ids: np.ndarray, s: Settings, number: int) -> np.ndarray:
    """Whether each row takes part in round `number`: it hangs on the row's id alone."""
    return _mixed(ids.astype(np.int64).view(np.uint64) + np.uint64((s.seed * 1_000_003 + number) * 0x9E3779B97F4A7C15 % 2**64)) < s.share_rows


def drawn_columns(n: int, s: Settings, number: int) -> np.ndarray:
    return np.sort(np.random.default_rng([s.seed, number]).permutation(n)[: max(1, round(n * s.share_columns))])


def _read(batch, width: int) -> tuple[np.ndarray, ...]:
    binned = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, width)
    y, margin, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "margin", "id"))
    return binned, y, margin, ids, batch.column("held").to_numpy(zero_copy_only=False).astype(bool)


def _histograms(recent: list[Tree], growing: Tree, level: int, columns: np.ndarray, width: int, s: Settings, number: int):
    """(key, g, h) of one level of the growing tree: key is (node, column, bin). At the root also key -1, the error and
    number of the held rows, and -2, the loss and number of the others, after the trees so far."""

    def run(batches):
        size, first = MISSING + 1, 2**level - 1
        g_sum, h_sum = (np.zeros((first + 1) * len(columns) * size) for _ in "gh")
        told = np.zeros((2, 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            binned, y, margin, ids, held = _read(batch, width)
            for t in recent:
                margin = margin + t.margins(binned, s.depth)
            if not level:
                _, _, loss = gradients(margin[~held], y[~held], s)
                told += [[np.abs(margin - y)[held].sum(), held.sum()], [loss.sum(), (~held).sum()]]
            used = ~held & drawn_rows(ids, s, number)
            binned, y, margin = binned[used], y[used], margin[used]
            node = growing.leaves(binned, level) - first if level else np.zeros(len(y), dtype=np.int64)
            inside = node >= 0  # rows of nodes that ended above
            g, h, _ = gradients(margin, y, s)
            for j, c in enumerate(columns):
                key = (node[inside] * len(columns) + j) * size + binned[inside, c]
                g_sum += np.bincount(key, g[inside], len(g_sum))
                h_sum += np.bincount(key, h[inside], len(h_sum))
        at = np.flatnonzero(h_sum)
        keys, gs, hs = [at], [g_sum[at]], [h_sum[at]]
        if not level:
            keys, gs, hs = [*keys, np.array([-1, -2])], [*gs, told[:, 0]], [*hs, told[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(gs)), pa.array(np.concatenate(hs))], names=["key", "g", "h"])

    return run


def best_split(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[float, int, int, bool, tuple[float, float], tuple[float, float]] | None:
    """(gain, column, bin, nulls go left, sums left, sums right) of a node's [column, bin] sums; of equal gains the first."""
    total_g, total_h = g[0].sum(), h[0].sum()
    best = None
    for j in range(len(g)):
        for missing_left in (True, False):
            extra = (g[j, MISSING], h[j, MISSING]) if missing_left else (0.0, 0.0)
            gl, hl = np.cumsum(g[j, :MISSING]) + extra[0], np.cumsum(h[j, :MISSING]) + extra[1]
            gr, hr = total_g - gl, total_h - hl
            gain = gl**2 / (hl + s.penalty) + gr**2 / (hr + s.penalty) - total_g**2 / (total_h + s.penalty)
            gain[(hl < s.min_weight) | (hr < s.min_weight)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-9):
                best = (float(gain[k]), j, k, missing_left, (float(gl[k]), float(hl[k])), (float(gr[k]), float(hr[k])))
    return best


def split_level(tree: Tree, level: int, g: np.ndarray, h: np.ndarray, columns: np.ndarray, s: Settings) -> bool:
    """Split the nodes of a level by their [node, column, bin] sums; whether any was split."""
    first, any_split = 2**level - 1, False
    for node in range(2**level):
        at = first + node
        if level == 0:
            tree.value[0] = -s.step * g[0, 0].sum() / (h[0, 0].sum() + s.penalty)
        found = best_split(g[node], h[node], s) if h[node].any() else None
        if found:
            _, j, cut, missing_left, *sums = found
            tree.feature[at], tree.cut[at], tree.missing_left[at] = int(columns[j]), cut, missing_left
            for child, (gs, hs) in zip((2 * at + 1, 2 * at + 2), sums):
                tree.value[child] = -s.step * gs / (hs + s.penalty)
            any_split = True
    return any_split


def empty_tree(depth: int) -> Tree:
    n = 2 ** (depth + 1) - 1
    return Tree([-1] * n, [0] * n, [True] * n, [0.0] * n)


def _moved(trees: list[Tree], width: int, depth: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                binned, _, margin, *_ = _read(batch, width)
                for t in trees:
                    margin = margin + t.margins(binned, depth)
                yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    return run


def _binned(edges: list[list[float]], base: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[3:]], axis=1)
                packed = [r.tobytes() for r in bin_values(values, edges)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary()), pa.array(np.full(batch.num_rows, base))], names=["y", "held", "id", "bins", "margin"])

    return run


def fit_boosted(train: DataFrame, validation: DataFrame | None, columns: list[str], target: str, key: list[str], settings: Settings = Settings()) -> tuple[Boosted, list[dict]]:
    """(model, what each round found: the loss on train and the mean absolute error on validation before it).

    Bins come from approximate quantiles of train. Each level of a tree is one pass over the binned rows, whose tasks send
    sums by node, column and bin, so what meets the driver is bounded by the bins. With validation rows, rounds end after
    `patience` without a smaller error and the trees of the best round stay. Rows take part by a hash of key, so a
    task that runs again does the same. The target must not be null.
    """
    s = settings
    shares = [k / s.bins for k in range(1, s.bins)]
    edges = [sorted(set(q)) for q in train.approxQuantile(columns, shares, 0.0005)]
    base = float(train.agg(F.avg(target)).first()[0])
    rows = train.withColumn("_held", F.lit(False))
    if validation is not None:
        rows = rows.unionByName(validation.withColumn("_held", F.lit(True)))
    narrow = rows.select(F.col(target).cast("double").alias("y"), F.col("_held").alias("held"), F.xxhash64(*key).alias("id"), *[F.col(c).cast("double") for c in columns])
    state = written(narrow.mapInArrow(_binned(edges, base), "y double, held boolean, id long, bins binary, margin double"), "boosting")
    trees: list[Tree] = []
    recent: list[Tree] = []
    history: list[dict] = []
    best = (float("inf"), 0)

    def level_sums(tree: Tree, level: int, chosen: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, dict]:
        found = state.mapInArrow(_histograms(recent, tree, level, chosen, len(columns), s, number), "key long, g double, h double").groupBy("key").agg(F.sum("g"), F.sum("h")).collect()
        g, h = (np.zeros(2**level * len(chosen) * (MISSING + 1)) for _ in "gh")
        for k, gs, hs in found:
            if k >= 0:
                g[k], h[k] = gs, hs
        shape = (2**level, len(chosen), MISSING + 1)
        return g.reshape(shape), h.reshape(shape), {k: (gs, hs) for k, gs, hs in found if k < 0}

    for number in range(s.rounds + 1):
        chosen, tree = drawn_columns(len(columns), s, number), empty_tree(s.depth)
        g, h, told = level_sums(tree, 0, chosen, number)
        history.append({"rounds": number, "loss": told[-2][0] / max(told[-2][1], 1), "mae": told[-1][0] / told[-1][1] if told[-1][1] else None})
        if validation is not None:
            if history[-1]["mae"] < best[0]:
                best = (history[-1]["mae"], number)
            elif number - best[1] >= s.patience:
                break
        if number == s.rounds:
            break
        for level in range(s.depth):
            if level:
                g, h, _ = level_sums(tree, level, chosen, number)
            if not split_level(tree, level, g, h, chosen, s):
                break
        trees.append(tree)
        recent.append(tree)
        if len(recent) == REWRITE:
            old, state = state, written(state.mapInArrow(_moved(recent, len(columns), s.depth), state.schema), "boosting")
            discard(old)
            recent = []
    discard(state)
    return Boosted(list(columns), base, edges, trees[: best[1]] if validation is not None else trees, s.depth), history


cloudpickle.register_pickle_by_value(sys.modules[__name__])
