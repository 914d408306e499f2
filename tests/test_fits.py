"""Exact quantiles, boosting by histograms, ridge by one pass, cluster draws and model artifacts against slow versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_plans import league, parts  # noqa: F401 - fixtures
from tidemark.operators import quantiles
from tidemark.plans import boosting, evaluate, model
from tidemark.plans import features as ft
from tidemark.sources import store


def test_quantiles_equal_percentile(spark):
    rnd = random.Random(3)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 0.1, -0.1]
    rows = [(rnd.choice(odd), rnd.gauss(0, 10), float(rnd.randrange(5)), None if i % 3 else rnd.random(), None, i) for i in range(1001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f long").repartition(7)
    for share in (0.5, 0.0, 0.975, 1.0):
        got = quantiles.exact_quantiles(df, df.columns, share)
        want = df.agg(*[F.percentile(c, share).alias(c) for c in df.columns]).first().asDict()
        assert got.keys() == want.keys() and all(got[c] == want[c] or math.isclose(got[c], want[c], rel_tol=1e-12) for c in got if c != "e") and got["e"] is None, share
    even = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double")
    assert quantiles.exact_quantiles(even, ["v"]) == {"v": 3.0} and quantiles.exact_quantiles(even.limit(0), ["v"]) == {"v": None}


def slow_boosting(x, y, ids, s, edges, base, rounds):
    """Every split of every node tried row by row."""
    binned, margin, trees = boosting.bin_values(x, edges), np.full(len(y), base), []
    for number in range(rounds):
        used, columns = boosting.drawn_rows(ids, s, number), boosting.drawn_columns(x.shape[1], s, number)
        g, h, _ = boosting.gradients(margin, y, s)

        def weigh(rows):
            return g[rows].sum() ** 2 / (h[rows].sum() + s.penalty)

        def grow(rows, depth):
            best = None
            for c in columns if depth < s.depth else ():
                for left_too in (True, False):
                    for cut in range(boosting.MISSING):
                        b = binned[rows, c]
                        left = np.where(b == boosting.MISSING, left_too, b <= cut)
                        a, z = rows[left], rows[~left]
                        if h[a].sum() < s.min_weight or h[z].sum() < s.min_weight:
                            continue
                        gain = weigh(a) + weigh(z) - weigh(rows)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, c, cut, left_too, a, z)
            if best is None:
                return -s.step * g[rows].sum() / (h[rows].sum() + s.penalty)
            return best[1:4] + (grow(best[4], depth + 1), grow(best[5], depth + 1))

        def told(node, row):
            while isinstance(node, tuple):
                c, cut, left_too, a, z = node
                b = binned[row, c]
                node = a if (left_too if b == boosting.MISSING else b <= cut) else z
            return node

        tree = grow(np.flatnonzero(used), 0)
        margin = margin + np.array([told(tree, r) for r in range(len(y))])
        trees.append(tree)
    return margin


@pytest.mark.parametrize("loss", ["pseudo_huber", "squared"])
def test_boosting_equals_a_slow_one(spark, loss):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    y = np.where(np.isnan(x[:, 0]), 3.0, x[:, 0] * 2) + np.nan_to_num(x[:, 1]) ** 2 + rng.standard_t(2, size=160)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double, y double").repartition(5)
    s = boosting.Settings(loss=loss, slope=2.0, depth=3, rounds=12, min_weight=3.0, penalty=1.0, bins=8, share_rows=0.8, share_columns=0.75)
    made, history = boosting.fit_boosted(df, None, ["a", "b", "c", "d"], "y", ["k"], s)
    ids = np.array([r.h for r in df.select("k", F.xxhash64("k").alias("h")).orderBy("k").collect()])
    want = slow_boosting(x, y, ids, s, made.edges, made.base, 12)
    got = np.array([r.p for r in df.withColumn("p", made.column()).orderBy("k").collect()])
    assert len(made.trees) == 12 and np.allclose(got, want, atol=1e-9)
    losses = [h["loss"] for h in history]
    assert all(b < a for a, b in zip(losses, losses[1:])) and math.isclose(losses[-1], boosting.gradients(want, y, s)[2].mean())


def test_boosting_stops_at_the_best_round(parts):  # noqa: F811
    m = model.fit_boosted(parts["train"], parts["validation"], rounds=40, step=0.3, patience=4, min_weight=5.0)
    told = model.mae(m.predict(parts["validation"]), "predicted")
    every, history = boosting.fit_boosted(parts["train"], parts["validation"], list(ft.FEATURES), "fantasy_score", list(ft.IDS), boosting.Settings(rounds=40, step=0.3, patience=4, min_weight=5.0))
    errors = [h["mae"] for h in history]
    assert m.settings["rounds"] == len(every.trees) == int(np.argmin(errors)) and told == pytest.approx(min(errors)) and len(errors) < 41
    mean, _ = model.fit_values(parts["train"])
    assert told < parts["validation"].agg(F.avg(F.abs(F.col("fantasy_score") - mean))).first()[0]
    assert len(m.importances()) == 15


def test_all_ridges_come_of_one_pass(parts):  # noqa: F811
    alphas = [0.1, 1.0, 10.0, 25.0, 100.0, 400.0]
    p = model.prepare(parts["fit"])
    z = np.array([[float(v) for v in r] for r in parts["fit"].select(*[((v - p.means[k]) / p.deviations[k]) for k, v in p.filled().items()]).collect()])
    y = np.array([r[0] for r in parts["fit"].select("fantasy_score").collect()])
    for m, alpha in zip(model.fit_ridges(parts["fit"], alphas, preparation=p), alphas):
        w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
        assert np.allclose(m.regressor.coefficients.toArray(), w, atol=1e-6) and m.settings == {"alpha": alpha}


def test_cluster_draws(spark):
    rng = np.random.default_rng(9)
    data = [(int(c), float(v)) for c, v in zip(rng.integers(0, 300, 4000), rng.normal(1.0, 3.0, 4000))]
    df = spark.createDataFrame([(c, v + c % 7) for c, v in data], "c long, v double").repartition(6)
    clusters = len({c for c, _ in data})
    rounds = evaluate.bootstrap_rounds(df, F.col("v"), ["c"], rounds=400, bucket=37).collect()
    assert len(rounds) == 400 and {r.drawn for r in rounds} == {clusters}
    again = evaluate.bootstrap_rounds(df.repartition(2), F.col("v"), ["c"], rounds=400, bucket=37).collect()
    assert sorted((r.i, r.n) for r in rounds) == sorted((r.i, r.n) for r in again)
    # against draws of an index list
    sums = {}
    for c, v in data:
        s = sums.setdefault(c, [0.0, 0])
        s[0] += v + c % 7
        s[1] += 1
    table = np.array(list(sums.values()))
    picks = rng.integers(0, clusters, size=(20_000, clusters))
    slow = table[picks, 0].sum(axis=1) / table[picks, 1].sum(axis=1)
    got = evaluate.cluster_bootstrap(df, F.col("v"), ["c"], rounds=4000, bucket=37).first()
    width = np.percentile(slow, 97.5) - np.percentile(slow, 2.5)
    assert abs(got.low - np.percentile(slow, 2.5)) < 0.05 * width and abs(got.high - np.percentile(slow, 97.5)) < 0.05 * width
    assert got["mean"] == pytest.approx(sum(s for s, _ in sums.values()) / sum(n for _, n in sums.values()))
    sizes = [3, 0, 5, 1, 0, 8]
    assert (sum(evaluate.drawn_from(b, sizes, 50, 1) for b in range(6)) == 17).all() and not evaluate.drawn_from(1, sizes, 50, 1).any()


def test_a_failed_save_leaves_the_old_model(spark, parts, tmp_path, monkeypatch):  # noqa: F811
    path = f"{tmp_path}/m"
    first, second = model.fit_ridges(parts["fit"], [1.0, 400.0])
    with pytest.raises(FileNotFoundError):
        model.load_model(spark, path)
    first.save(spark, path)
    monkeypatch.setattr(store, "publish", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        second.save(spark, path)
    monkeypatch.undo()
    assert model.load_model(spark, path).settings == {"alpha": 1.0}
    boosted = model.fit_boosted(parts["train"], None, rounds=3, depth=2)
    boosted.save(spark, path)
    again = model.load_model(spark, path)
    a, b = (m.predict(parts["test"], "p").agg(F.sum("p")).first()[0] for m in (boosted, again))
    assert again.kind == "boosted" and a == pytest.approx(b)
    monkeypatch.setattr(model, "versions", lambda: {"spark": "0", "numpy": "0"})
    with pytest.warns(UserWarning, match="saved with spark"):
        model.load_model(spark, path)
    monkeypatch.undo()
    monkeypatch.setattr(model.Model, "probed", lambda self, spark: [0.0, 0.0, 1.0])
    with pytest.raises(ValueError, match="probe"):
        model.load_model(spark, path)
