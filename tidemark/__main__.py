"""python -m tidemark ingest | verify | features | train | holdout | judge | record | evaluate | copy | availability: the plans over a folder of stored tables.

Exit codes: 0 done, 1 broken rules after a load, 2 bad input or a check that blocks, 3 the training gate.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans import evaluate, features, ingest, model, serve, train
from tidemark.sources import tables
from tidemark.sources.raw_cache import RawCache
from tidemark.sources.store import copy_tables, delete_keys, exists, load, upsert
from tidemark.sources.store import verify as verify_copy


def _ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    return int(bool(ingest.run(spark, RawCache(spark, a.cache), a.root, ingest.season_list(a.seasons), a.reports, ingest.game_keys(a.accepted))))


def _verify(spark: SparkSession, a: argparse.Namespace) -> int:
    broken = ingest.verify(spark, a.root, ingest.season_list(a.seasons), ingest.game_keys(a.accepted))
    for rule, n in sorted(broken.items()):
        print(f"{rule}: {n}")
    return int(bool(broken))


def _built(spark: SparkSession, root: str):
    return features.build_features(tables.history(spark, root), None, tables.games(spark, root))


def _features(spark: SparkSession, a: argparse.Namespace) -> int:
    _built(spark, a.root).write.mode("overwrite").parquet(a.out)
    return 0


def _train(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _built(spark, a.root).persist()
    first, last = a.train.split("-")
    parts = model.splits(rows, (int(first), int(last)), a.validation, a.test)
    try:
        train.train(spark, parts, a.model, a.threshold, train.candidates(a.draws))
    except model.GateError as e:
        print(e, file=sys.stderr)
        return 3
    return 0


def _record(spark: SparkSession, a: argparse.Namespace) -> int:
    made = model.load_model(spark, f"{a.model}/fantasy_score")
    found = serve.predict(tables.history(spark, a.root), tables.games(spark, a.root), a.as_of, made.predict)
    rows = serve.to_record(found, a.version, a.as_of, a.created_at)
    upsert(spark, f"{a.root}/predictions", schemas.PREDICTIONS, rows, update=False)
    return 0


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = load(spark, f"{a.root}/predictions", schemas.PREDICTIONS, must_exist=True)
    judged = evaluate.recorded(evaluate.latest_of_each(rows), tables.games(spark, a.root), load(spark, f"{a.root}/player_games", schemas.PLAYER_GAMES), a.version)
    evaluate.summary(judged).orderBy("model_version").show(truncate=False)
    return 0


def _holdout(spark: SparkSession, a: argparse.Namespace) -> int:
    """Test rows with baselines and what they are, to be judged elsewhere."""
    rows = _built(spark, a.root).persist()
    first, last = a.train.split("-")
    parts = model.splits(rows, (int(first), int(last)), a.validation, a.test)
    mean, median = model.fit_values(parts["fit"])
    train.export_hold_out(spark, parts["test"], mean, median, a.out, {"season": a.test, "data": model.data_version(tables.history(spark, a.root))})
    rows.unpersist()
    return 0


def _judge(spark: SparkSession, a: argparse.Namespace) -> int:
    """The stored model and the baselines on a hold-out; an error where the model has seen its season."""
    rows, told = train.import_hold_out(spark, a.holdout)
    train.check_out_of_sample(train.load_report(spark, a.model), told["season"])
    judged = model.load_model(spark, f"{a.model}/fantasy_score").predict(rows)
    names = ["predicted", *[c for c in judged.columns if c.startswith("baseline_")]]
    evaluate.comparison({"test": judged}, names, "fantasy_score").orderBy("mae").show(truncate=False)
    return 0


def _copy(spark: SparkSession, a: argparse.Namespace) -> int:
    """All tables into another folder, then their metrics on both sides; 1 where these differ."""
    for name, n in copy_tables(spark, a.source, a.target, schemas.TABLES, a.dry_run).items():
        print(f"{name}: {'missing' if n is None else n}")
    apart = []
    if not a.dry_run:
        for t in schemas.TABLES:
            if exists(spark, f"{a.source}/{t.name}"):
                apart += [(t.name, r.metric, r.source, r.target) for r in verify_copy(load(spark, f"{a.source}/{t.name}", t), load(spark, f"{a.target}/{t.name}", t), t).collect()]
    for row in apart:
        print(*row)
    return int(bool(apart))


def _availability(spark: SparkSession, a: argparse.Namespace) -> int:
    """List, set or remove a player's status."""
    path = f"{a.root}/player_availability"
    if a.player and a.remove:
        delete_keys(spark, path, schemas.AVAILABILITY, spark.createDataFrame([(a.player.strip().upper(),)], "player_id string"))
    elif a.player:
        row = spark.createDataFrame([(a.player, a.status, a.source, a.note, a.until)], "player_id string, status string, source string, note string, expected_return string")
        upsert(spark, path, schemas.AVAILABILITY, serve.valid_availability(row).withColumn("updated_at", F.current_timestamp()))
    listed = serve.availability_list(load(spark, path, schemas.AVAILABILITY), tables.players(spark, a.root), None if a.player else a.status)
    for r in listed.collect():  # the players who are out or doubtful
        print(r.player_id, r.name, r.status, r.expected_return or "-", r.note or "", sep="\t")
    return 0


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("tidemark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    options = {
        "ingest": (_ingest, {"--cache": {}, "--root": {}, "--seasons": {}, "--reports": {"required": False}, "--accepted": {"default": ""}}),
        "verify": (_verify, {"--root": {}, "--seasons": {}, "--accepted": {"default": ""}}),
        "features": (_features, {"--root": {}, "--out": {}}),
        "train": (_train, {"--root": {}, "--model": {}, "--train": {}, "--validation": {"type": int}, "--test": {"type": int}, "--threshold": {"type": float, "default": 6.0}, "--draws": {"type": int, "default": 10}}),
        "holdout": (_holdout, {"--root": {}, "--out": {}, "--train": {}, "--validation": {"type": int}, "--test": {"type": int}}),
        "judge": (_judge, {"--model": {}, "--holdout": {}}),
        "copy": (_copy, {"--source": {}, "--target": {}, "--dry-run": {"action": "store_true", "required": False}}),
        "availability": (_availability, {"--root": {}, **{f: {"required": False} for f in ("--player", "--status", "--source", "--note", "--until")}, "--remove": {"action": "store_true", "required": False}}),
        "record": (_record, {"--root": {}, "--model": {}, "--version": {}, "--as-of": {}, "--created-at": {}}),
        "evaluate": (_evaluate, {"--root": {}, "--version": {"required": False}}),
    }
    for name, (run, flags) in options.items():
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for flag, more in flags.items():
            sub.add_argument(flag, **({"required": "default" not in more} | more))
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    try:
        return a.run(spark or SparkSession.builder.appName("tidemark").getOrCreate(), a)
    except (ValueError, FileNotFoundError) as e:  # a failed check among them
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
