"""Splits, baselines, ridge and boosted trees over the feature frame; the gate before a model is kept."""

from __future__ import annotations

import json
import math
import sys
import uuid
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans import boosting
from tidemark.plans.features import FEATURES, IDS
from tidemark.sources import store


class GateError(RuntimeError):
    """The test error does not lie under the threshold."""


def splits(features: DataFrame, train: tuple[int, int], validation: int, test: int, target: str = "fantasy_score") -> dict[str, DataFrame]:
    """By season: train, validation, test, and fit (train with validation); rows without a target are left out."""
    rows = features.where(F.col(target).isNotNull())
    out = {
        "train": rows.where(F.col("season").between(*train)),
        "validation": rows.where(F.col("season") == validation),
        "test": rows.where(F.col("season") == test),
        "fit": rows.where(F.col("season").between(train[0], validation)),
    }
    for name, df in out.items():
        if df.isEmpty():
            raise ValueError(f"the {name} split is empty")
    return out


def fit_values(fit: DataFrame, target: str = "fantasy_score") -> tuple[float, float]:
    """Mean and exact median of the target."""
    return fit.agg(F.avg(target)).first()[0], exact_quantiles(fit, [target])[target]


def baselines(rows: DataFrame, mean: float, median: float, short: str = "fantasy_mean_5", season: str = "fantasy_season_mean") -> DataFrame:
    """baseline_* columns; a missing rolling mean falls back on the season's, then on the global mean, and the other way round."""
    return rows.withColumns(
        {
            "baseline_global_mean": F.lit(mean),
            "baseline_global_median": F.lit(median),
            "baseline_naive_rolling5": F.coalesce(short, season, F.lit(mean)),
            "baseline_naive_season_mean": F.coalesce(season, short, F.lit(mean)),
        }
    )


@dataclass(frozen=True)
class Preparation:
    """Medians of the features, those with nulls (they get an indicator), and population means and deviations."""

    medians: dict[str, float]
    flagged: tuple[str, ...]
    means: dict[str, float]
    deviations: dict[str, float]

    @property
    def names(self) -> list[str]:
        return [*FEATURES, *[f"missing_{c}" for c in self.flagged]]

    def filled(self) -> dict[str, Column]:
        out = {c: F.coalesce(F.col(c), F.lit(self.medians[c])) for c in FEATURES}
        return out | {f"missing_{c}": F.col(c).isNull().cast("double") for c in self.flagged}

    def scaled(self, rows: DataFrame, standardise: bool) -> DataFrame:
        columns = self.filled()
        if standardise:
            columns = {k: (v - self.means[k]) / self.deviations[k] for k, v in columns.items()}
        made = rows.withColumns({f"x_{k}": v for k, v in columns.items()})
        return VectorAssembler(inputCols=[f"x_{k}" for k in self.names], outputCol="features").transform(made).drop(*[f"x_{k}" for k in self.names])


def prepare(fit: DataFrame) -> Preparation:
    """Exact medians (Imputer's are approximate) by counting, indicators where the fit rows have nulls, z-scores."""
    first = fit.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in FEATURES]).first()
    medians = {c: 0.0 if v is None else v for c, v in exact_quantiles(fit, list(FEATURES)).items()}
    flagged = tuple(c for c in FEATURES if first[f"n_{c}"])
    bare = Preparation(medians, flagged, {}, {})
    columns = bare.filled()
    second = fit.select(*[v.alias(k) for k, v in columns.items()]).agg(*[F.avg(k).alias(f"m_{k}") for k in columns], *[F.stddev_pop(k).alias(f"s_{k}") for k in columns]).first()
    return Preparation(medians, flagged, {k: second[f"m_{k}"] for k in columns}, {k: second[f"s_{k}"] or 1.0 for k in columns})


@dataclass
class Linear:
    """intercept + coefficients * standardised columns."""

    coefficients: DenseVector
    intercept: float


@dataclass
class Model:
    """A fitted regressor with what prepares its rows. kind: ridge, trees (Spark's) or boosted (histograms)."""

    kind: str
    target: str
    preparation: Preparation | None
    regressor: Linear | GBTRegressionModel | boosting.Boosted
    settings: dict = field(default_factory=dict)

    def predict(self, rows: DataFrame, out: str = "predicted") -> DataFrame:
        if self.kind == "boosted":  # nulls have bins of their own
            return rows.withColumn(out, self.regressor.column())
        if self.kind == "ridge":
            p, total = self.preparation, F.lit(float(self.regressor.intercept))
            for (k, v), w in zip(p.filled().items(), self.regressor.coefficients.toArray().tolist()):
                total = total + (v - p.means[k]) / p.deviations[k] * w
            return rows.withColumn(out, total)
        return self.regressor.transform(self.preparation.scaled(rows, False)).withColumnRenamed("prediction", out).drop("features")

    def importances(self, top: int = 15) -> list[tuple[str, float]]:
        raw = np.abs(self.regressor.coefficients.toArray()) if self.kind == "ridge" else self.regressor.gains() if self.kind == "boosted" else self.regressor.featureImportances.toArray()
        share = raw / (raw.sum() or 1.0)
        names = self.regressor.columns if self.kind == "boosted" else self.preparation.names
        return sorted(zip(names, share.tolist()), key=lambda x: (-x[1], x[0]))[:top]

    def probed(self, spark: SparkSession) -> list[float]:
        """Predictions for a row of nulls, one of noughts and one of ones."""
        rows = [spark.range(1).select(F.lit(k).alias("_k"), *[F.lit(v).cast("double").alias(c) for c in FEATURES]) for k, v in enumerate((None, 0.0, 1.0))]
        return [r["predicted"] for r in self.predict(store.union_all(rows)).orderBy("_k").collect()]

    def save(self, spark: SparkSession, path: str) -> None:
        """All of it into a new directory, then one rename points the path at that: a failure before leaves the old model."""
        new, p = f"model.{uuid.uuid4().hex}", self.preparation
        manifest = {"kind": self.kind, "target": self.target, "settings": self.settings, "features": FEATURES, "versions": versions(), "probe": self.probed(spark)}
        if p:
            manifest |= {"medians": p.medians, "flagged": p.flagged, "means": p.means, "deviations": p.deviations}
        if self.kind == "ridge":
            manifest["linear"] = {"coefficients": self.regressor.coefficients.toArray().tolist(), "intercept": float(self.regressor.intercept)}
        elif self.kind == "boosted":
            manifest["boosted"] = self.regressor.to_json()
        else:
            self.regressor.write().save(f"{path}/{new}/regressor")
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/{new}/manifest")
        store.publish(spark, path, {"model": {"": new}})


def versions() -> dict[str, str]:
    return {"spark": pyspark.__version__, "numpy": np.__version__}


def load_model(spark: SparkSession, path: str) -> Model:
    """As saved: the probe rows must give what they gave then. Other versions of Spark or numpy warn."""
    current = store.pointers(spark, path)["tables"].get("model")
    if not current:
        raise FileNotFoundError(f"no model in {path}")
    path = f"{path}/{current['']}"
    m = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if tuple(m["features"]) != FEATURES:
        raise ValueError("the model was fitted on other features")
    for name, v in versions().items():
        if m["versions"].get(name) != v:
            warnings.warn(f"the model was saved with {name} {m['versions'].get(name)}, this is {v}", stacklevel=2)
    prepared = Preparation(m["medians"], tuple(m["flagged"]), m["means"], m["deviations"]) if "medians" in m else None
    if m["kind"] == "ridge":
        regressor = Linear(Vectors.dense(m["linear"]["coefficients"]), m["linear"]["intercept"])
    else:
        regressor = boosting.Boosted.from_json(m["boosted"]) if m["kind"] == "boosted" else GBTRegressionModel.load(f"{path}/regressor")
    model = Model(m["kind"], m["target"], prepared, regressor, m["settings"])
    found = model.probed(spark)
    if not all(math.isfinite(x) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9) for x, y in zip(found, m["probe"])):
        raise ValueError(f"the model's probe rows give {found}, they gave {m['probe']}")
    return model


def _products(width: int):
    """Sums of x_i * x_j over a task's rows, a row for each pair."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    return run


def fit_ridges(fit: DataFrame, alphas: list[float], target: str = "fantasy_score", preparation: Preparation | None = None) -> list[Model]:
    """Least squares with the penalty alpha * |w|^2 on standardised columns, the intercept free: one model for each alpha.

    One pass sums the products of all columns; the driver gets one number for each pair of them and solves for every alpha.
    """
    p = preparation or prepare(fit)
    scaled = [((v - p.means[k]) / p.deviations[k]).alias(f"z{i}") for i, (k, v) in enumerate(p.filled().items())]
    columns = [F.lit(1.0).alias("one"), *scaled, F.col(target).cast("double").alias("y")]
    width = len(columns)
    sums = fit.where(F.col(target).isNotNull()).select(*columns).mapInArrow(_products(width), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    g = np.zeros((width, width))
    for i, j, v in sums:
        g[i, j] = g[j, i] = v
    n, zs, ys = g[0, 0], g[0, 1:-1] / g[0, 0], g[0, -1] / g[0, 0]
    zz, zy = g[1:-1, 1:-1] - n * np.outer(zs, zs), g[1:-1, -1] - n * zs * ys
    out = []
    for alpha in alphas:
        w = np.linalg.solve(zz + alpha * np.eye(len(zy)), zy)
        out.append(Model("ridge", target, p, Linear(Vectors.dense(w), float(ys - zs @ w)), {"alpha": alpha}))
    return out


def fit_ridge(fit: DataFrame, alpha: float, target: str = "fantasy_score", preparation: Preparation | None = None) -> Model:
    return fit_ridges(fit, [alpha], target, preparation)[0]


def fit_boosted(train: DataFrame, validation: DataFrame | None, target: str = "fantasy_score", **settings) -> Model:
    """Boosted trees by histograms, pseudo-Huber unless another loss is set; with validation rows the best round's trees stay."""
    s = boosting.Settings(**settings)
    made, history = boosting.fit_boosted(train, validation, list(FEATURES), target, list(IDS), s)
    return Model("boosted", target, None, made, settings | {"loss": s.loss, "rounds": len(made.trees), "loss_by_round": [h["loss"] for h in history]})


def fit_trees(train: DataFrame, validation: DataFrame | None, target: str = "fantasy_score", loss: str = "absolute", rounds: int = 60, depth: int = 4, step: float = 0.1, seed: int = 42, preparation: Preparation | None = None) -> Model:
    """Boosted trees; with validation rows the rounds stop early on them. Nulls get the median and an indicator."""
    p = preparation or prepare(train)
    stop = {} if validation is None else {"validationIndicatorCol": "held", "validationTol": 0.001}
    gbt = GBTRegressor(lossType=loss, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.8, minInstancesPerNode=10, seed=seed, **stop)
    rows = train.withColumn("held", F.lit(False))
    if validation is not None:
        rows = rows.unionByName(validation.withColumn("held", F.lit(True)))
    model = gbt.fit(p.scaled(rows, False).withColumn("label", F.col(target).cast("double")))
    return Model("trees", target, p, model, {"loss": loss, "rounds": model.getNumTrees, "depth": depth, "step": step})


def mae(rows: DataFrame, predicted: str, target: str = "fantasy_score") -> float:
    return rows.agg(F.avg(F.abs(F.col(predicted) - F.col(target)))).first()[0]


def gate(error: float, threshold: float) -> None:
    if not error < threshold:
        raise GateError(f"test error {error:.6f} is not under {threshold}")


def hold_out(rows: DataFrame, mean: float, median: float) -> DataFrame:
    """The test rows with float features and the baselines, to be judged elsewhere."""
    made = baselines(rows, mean, median)
    return made.select(*IDS, "fantasy_score", "pir", *[F.col(c).cast("float").alias(c) for c in FEATURES], *[c for c in made.columns if c.startswith("baseline_")])


def data_version(history: DataFrame) -> str:
    """Twelve hex digits of the row count and the order-insensitive digest."""
    digest = F.sum(F.xxhash64(*sorted(history.columns)).cast("decimal(38,0)")).cast("string")
    return history.agg(F.substring(F.sha2(F.concat_ws(":", F.count("*").cast("string"), digest), 256), 1, 12)).first()[0]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
