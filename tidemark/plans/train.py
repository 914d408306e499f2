"""Seeded search over ridge and boosted candidates, two targets, a gate before the model is kept, hold-out files."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import model as m
from tidemark.plans.features import FEATURES

ALPHAS = (0.1, 1.0, 10.0, 25.0, 100.0, 400.0)
#: What boosted candidates are drawn from.
GRID = {"depth": (3, 4, 5, 6), "step": (0.03, 0.05, 0.1), "rounds": (40, 60, 100)}
LOSSES = ("squared", "absolute", "pseudo_huber")
SLOPES = (2.0, 5.0, 10.0)


def finite(value: Column, digits: int = 6) -> Column:
    """Rounded; NaN and infinities as null."""
    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None).cast("double")).otherwise(F.round(v, digits))


def finite_values(value):
    """The same for a report's nested dicts and lists."""
    if isinstance(value, dict):
        return {k: finite_values(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [finite_values(v) for v in value]
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else None
    return value


def candidates(draws: int = 10, seed: int = 42, alphas: tuple[float, ...] = ALPHAS, losses: tuple[str, ...] = LOSSES) -> list[dict]:
    """Ridge for each alpha, then `draws` different points of the grid with every loss; pseudo-Huber with a slope drawn for each."""
    grid = [dict(zip(GRID, (d, s, r))) for d in GRID["depth"] for s in GRID["step"] for r in GRID["rounds"]]
    rnd = random.Random(seed)
    chosen, out = rnd.sample(grid, min(draws, len(grid))), [{"kind": "ridge", "alpha": a} for a in alphas]
    for loss in losses:
        for k, c in enumerate(chosen):
            bent = loss == "pseudo_huber"
            out.append({"kind": "boosted" if bent else "trees", "name": f"{loss}_{k:02d}", "loss": loss, **c} | ({"slope": rnd.choice(SLOPES)} if bent else {}))
    return out


def fitted(c: dict, rows: DataFrame, validation: DataFrame | None, target: str, preparation: m.Preparation | None = None) -> m.Model:
    if c["kind"] == "ridge":
        return m.fit_ridge(rows, c["alpha"], target, preparation)
    if c["kind"] == "boosted":
        return m.fit_boosted(rows, validation, target, **{k: c[k] for k in ("loss", "slope", "step", "depth", "rounds") if k in c})
    return m.fit_trees(rows, validation, target, c["loss"], c["rounds"], c["depth"], c["step"], preparation=preparation)


def search(parts: dict[str, DataFrame], tried: list[dict], target: str = "fantasy_score") -> tuple[dict, list[dict]]:
    """(the candidate of least validation error, ties to the first, with the rounds it stopped at; all with their errors)."""
    p, out = m.prepare(parts["train"]), []
    alphas = [c["alpha"] for c in tried if c["kind"] == "ridge"]
    ridges = dict(zip(alphas, m.fit_ridges(parts["train"], alphas, target, p))) if alphas else {}  # one pass for all
    for c in tried:
        made = ridges[c["alpha"]] if c["kind"] == "ridge" else fitted(c, parts["train"], parts["validation"], target, p)
        out.append(c | {"rounds": made.settings.get("rounds")} | {"validation_mae": m.mae(made.predict(parts["validation"]), "predicted", target)})
    best = min(range(len(out)), key=lambda i: (out[i]["validation_mae"], i))
    return out[best], out


def train(
    spark: SparkSession, parts: dict[str, DataFrame], path: str, threshold: float, tried: list[dict] | None = None, targets: tuple[str, str] = ("fantasy_score", "pir"), later: DataFrame | None = None
) -> dict:
    """Search on the first target, refit on train and validation with fixed rounds, judge on test, write only under the threshold.

    The second target takes the same settings with a round count of its own (early stopping on its validation rows).
    later: rows of a season after the test, in which both models are fitted again before they are written; the report
    then says that its test figures are not out of sample for them. GateError where the test error is too large.
    """
    best, every = search(parts, tried or candidates(), targets[0])
    models, report = {}, {"chosen": best, "candidates": every, "out_of_sample": later is None, "targets": {}}
    for target in targets:
        c = best
        if target != targets[0] and c["kind"] != "ridge":
            c = c | {"rounds": fitted(c, parts["train"], parts["validation"], target).settings["rounds"]}
        models[target] = (c, fitted(c, parts["fit"], None, target))
        report["targets"][target] = {"settings": c, "test_mae": m.mae(models[target][1].predict(parts["test"]), "predicted", target)}
    m.gate(report["targets"][targets[0]]["test_mae"], threshold)
    rows = parts["fit"] if later is None else parts["fit"].unionByName(parts["test"]).unionByName(later)
    report["seasons"] = sorted(r[0] for r in rows.select("season").distinct().collect())  # a few seasons
    for target, (c, made) in models.items():
        (made if later is None else fitted(c, rows, None, target)).save(spark, f"{path}/{target}")
    spark.createDataFrame([(json.dumps(finite_values(report)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    return report


def load_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/report").first()[0])


def predict_both(spark: SparkSession, path: str, rows: DataFrame, targets: tuple[str, str] = ("fantasy_score", "pir")) -> DataFrame:
    """rows with predicted_fantasy_score and predicted_pir as floats."""
    for target in targets:
        rows = m.load_model(spark, f"{path}/{target}").predict(rows, "_p").withColumn(f"predicted_{target}", F.col("_p").cast("float")).drop("_p")
    return rows


def check_out_of_sample(report: dict, season: int) -> None:
    """An error where the model has seen the season that it is to be judged on."""
    if season in report["seasons"]:
        raise ValueError(f"season {season} was trained on; its figures would not be out of sample")


def export_hold_out(spark: SparkSession, rows: DataFrame, mean: float, median: float, path: str, metadata: dict) -> None:
    """Test rows with float features and baselines as zstandard Parquet of level 19, with what they are in a file beside them, written last."""
    m.hold_out(rows, mean, median).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "19").parquet(f"{path}/rows")
    spark.createDataFrame([(json.dumps(metadata | {"features": FEATURES, "rows": rows.count()}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def import_hold_out(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    rows = spark.read.parquet(f"{path}/rows")
    if tuple(metadata["features"]) != FEATURES or rows.count() != metadata["rows"]:
        raise ValueError("the hold-out rows are not those that the metadata tells of")
    return rows, metadata
