"""A Spark data source over a league's web service: one partition a season, with retries inside; failures come back as rows."""

from __future__ import annotations

import importlib
import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators.scratch import discard, written
from tidemark.sources.raw_cache import RateLimiter, RawCache, call, expected_codes

SCHEMA = "season int, gamecode int, payload string, error string"


class SeasonPartition(InputPartition):
    def __init__(self, season: int, codes: list[int]):
        self.season, self.codes = season, codes


class LeagueReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[SeasonPartition]:
        codes = {int(k): v for k, v in json.loads(self.options.get("codes", "{}")).items()}
        return [SeasonPartition(s, codes.get(s, [])) for s in json.loads(self.options["seasons"])]

    def read(self, partition: SeasonPartition) -> Iterator[tuple]:
        module, _, name = self.options["client"].partition(":")
        client = getattr(importlib.import_module(module), name)(**json.loads(self.options.get("arguments", "{}")))
        seasons = len(json.loads(self.options["seasons"]))
        limiter = RateLimiter(float(self.options.get("per_second", "1")) / seasons)  # partitions may run side by side
        kind, attempts, base = self.options["kind"], int(self.options.get("attempts", "4")), float(self.options.get("backoff", "1"))
        for code in partition.codes if kind == "boxscores" else [None]:
            try:
                for row in call(limiter, lambda c=code: client.boxscore(partition.season, c) if c is not None else getattr(client, kind)(partition.season), attempts, base):
                    yield partition.season, code, json.dumps(row), None
            except Exception as e:  # noqa: BLE001 - a gap, for the driver's ledger
                yield partition.season, code, None, f"{type(e).__name__}: {e}"


class League(DataSource):
    """format("league"): options client ("module:class", importable where tasks run), arguments (JSON for it), kind, seasons
    (JSON list), codes (JSON, games by season, for box scores), per_second (in all), attempts, backoff."""

    @classmethod
    def name(cls) -> str:
        return "league"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LeagueReader:
        return LeagueReader(dict(self.options))


class FolderClient:
    """The service's stand-in without a network: path/results_2023.json, schedule_2023.json, boxscores_2023.json, each a list of rows."""

    def __init__(self, path: str):
        self.path = path

    def _rows(self, kind: str, season: int) -> list[dict]:
        try:
            with open(f"{self.path}/{kind}_{season}.json") as f:
                return json.load(f)
        except FileNotFoundError:
            return []

    def results(self, season: int) -> list[dict]:
        return self._rows("results", season)

    def schedule(self, season: int) -> list[dict]:
        return self._rows("schedule", season)

    def boxscore(self, season: int, gamecode: int) -> list[dict]:
        return [r for r in self._rows("boxscores", season) if r["Gamecode"] == gamecode]


def read(spark: SparkSession, kind: str, seasons: list[int], client: str, codes: dict[int, list[int]] | None = None, **options) -> DataFrame:
    """(season, gamecode, payload, error): the service's rows as JSON, and what could not be had."""
    spark.dataSource.register(League)
    told = {"kind": kind, "seasons": json.dumps(seasons), "client": client, "codes": json.dumps(codes or {})} | {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}
    return spark.read.format("league").options(**told).load()


def fetch(cache: RawCache, seasons: list[int], client: str, schemas: dict[str, str], refresh: bool = False, **options) -> dict[int, list[int]]:
    """Fill the raw cache of all seasons at once: what is expected and not cached, each season in a task of its own; the
    gaps by season, which the cache's ledger keeps. schemas: the columns of each kind as DDL."""
    spark = cache.spark
    for kind in ("results", "schedule"):
        wanted = [s for s in seasons if refresh or not cache.has(kind, s)]
        if wanted:
            rows = written(read(spark, kind, wanted, client, **options), kind)
            failed = rows.where("error is not null").select("season", "error").collect()  # one row a season at most
            for s in wanted:
                if s not in {r["season"] for r in failed}:
                    cache.write(kind, s, rows.where(F.col("season") == s).select(F.from_json("payload", schemas[kind]).alias("r")).select("r.*"))
            discard(rows)
    todo = {}
    for s in seasons:
        parts = {k: cache.read(k, s) if cache.has(k, s) else None for k in ("results", "schedule")}
        todo[s] = sorted(expected_codes(**parts) - cache.codes(s))
    wanted = [s for s in seasons if todo[s]]
    gaps: dict[int, list[int]] = {s: [] for s in seasons}
    if wanted:
        rows = written(read(spark, "boxscores", wanted, client, todo, **options), "boxscores")
        for r in rows.where("error is not null").select("season", "gamecode").collect():  # the gaps
            gaps[r["season"]].append(r["gamecode"])
        for s in wanted:
            had = rows.where((F.col("season") == s) & F.col("payload").isNotNull())
            if not had.isEmpty():
                cache.append(s, had.select(F.from_json("payload", schemas["boxscores"]).alias("r")).select("r.*"))
        discard(rows)
    for s in seasons:
        cache.set_gaps(s, gaps[s])
    return gaps


for _name in (__name__, RateLimiter.__module__):
    cloudpickle.register_pickle_by_value(sys.modules[_name])
