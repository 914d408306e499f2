"""Raw data by season: a Parquet cache, the ledger of its gaps, and a polite fetch loop.

Rate and retries are the driver's alone; a source fetches one season's games at a time.
"""

from __future__ import annotations

import email.utils
import time
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.parsing import text_true
from tidemark.sources.store import exists, load, replace, replace_groups, union_all

KINDS = ("results", "schedule", "boxscores")


class Source(Protocol):
    """Rows as dictionaries; an empty list where there are none."""

    def results(self, season: int) -> list[dict]: ...

    def schedule(self, season: int) -> list[dict]: ...

    def boxscore(self, season: int, gamecode: int) -> list[dict]: ...


class EmptyResponse(RuntimeError):
    pass


class RateLimiter:
    """At least 1 / per_second between calls; it only ever gets slower."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.free = 1.0 / per_second, clock, sleep, 0.0

    def slow_to(self, per_second: float) -> None:
        self.gap = max(self.gap, 1.0 / per_second)

    def block(self, seconds: float) -> None:
        self.free = max(self.free, self.clock() + seconds)

    def wait(self) -> None:
        now = self.clock()
        if now < self.free:
            self.sleep(self.free - now)
        self.free = max(now, self.free) + self.gap


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds of a Retry-After header: a number or an HTTP date; null where it is neither."""
    if not value:
        return None
    if value.strip().isdigit():
        return float(value.strip())
    try:
        return max(0.0, email.utils.parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return None


def call(limiter: RateLimiter, f: Callable[[], list[dict]], attempts: int = 4, base: float = 1.0, now: Callable[[], float] = time.time) -> list[dict]:
    """f with exponential back-off: 429 waits as told and halves the rate, 5xx and empty answers are tried again, other errors are raised."""
    for k in range(attempts):
        limiter.wait()
        try:
            rows = f()
            if rows:
                return rows
            error: Exception = EmptyResponse("no rows")
        except Exception as e:  # noqa: BLE001 - told apart by status
            status = getattr(e, "status", None)
            if status != 429 and not (status and 500 <= status < 600):
                raise
            error = e
            if status == 429:
                limiter.slow_to(0.5 / limiter.gap)
                limiter.block(retry_after(getattr(e, "retry_after", None), now()) or base * 2**k)
        if k + 1 < attempts:
            limiter.block(base * 2**k)
    raise error


class RawCache:
    """path/kind/season=YYYY as Parquet; path/gaps lists games that could not be had."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def where(self, kind: str, season: int) -> str:
        return f"{self.path}/{kind}/season={season}"

    def has(self, kind: str, season: int) -> bool:
        return exists(self.spark, self.where(kind, season))

    def read(self, kind: str, season: int) -> DataFrame:
        return load(self.spark, self.where(kind, season)).withColumn("Season", F.lit(season))

    def write(self, kind: str, season: int, rows: DataFrame) -> None:
        replace(rows.drop("Season"), self.where(kind, season))

    def append(self, season: int, rows: DataFrame, group: str = "Gamecode") -> None:
        """Box scores of some games, in place of what was cached of them."""
        if self.has("boxscores", season):
            rows = replace_groups(load(self.spark, self.where("boxscores", season)), rows.drop("Season"), [group])
        self.write("boxscores", season, rows.orderBy(group))

    def codes(self, season: int) -> set[int]:
        if not self.has("boxscores", season):
            return set()
        return {r[0] for r in self.read("boxscores", season).select("Gamecode").distinct().collect()}  # a season's games

    def gaps(self) -> dict[int, list[int]]:
        if not exists(self.spark, f"{self.path}/gaps"):
            return {}
        return {r["season"]: sorted(r["codes"]) for r in load(self.spark, f"{self.path}/gaps").collect()}

    def set_gaps(self, season: int, codes: Iterable[int]) -> None:
        every = self.gaps() | {season: sorted(codes)}
        rows = [(s, c) for s, c in sorted(every.items()) if c]
        replace(self.spark.createDataFrame(rows, "season int, codes array<int>").coalesce(1), f"{self.path}/gaps")

    def load(self, kind: str, seasons: list[int]) -> DataFrame | None:
        parts = [self.read(kind, s) for s in seasons if self.has(kind, s)]
        return union_all(parts) if parts else None

    def load_all(self, seasons: list[int]) -> dict[str, DataFrame | None]:
        """Seasons with neither results nor schedule are left out; without any box score there is nothing to load."""
        known = [s for s in seasons if self.has("results", s) or self.has("schedule", s)]
        out = {k: self.load(k, known) for k in KINDS}
        if out["boxscores"] is None:
            raise FileNotFoundError("no box scores are cached for these seasons")
        return out


def expected_codes(results: DataFrame | None, schedule: DataFrame | None) -> set[int]:
    """Games that were played: by the results (both scores above 0) or by the schedule's own flag."""
    out: set[int] = set()
    if results is not None:
        out |= {int(r[0]) for r in results.where("homescore > 0 and awayscore > 0").select("gameCode").distinct().collect()}
    if schedule is not None:
        out |= {int(r[0]) for r in schedule.where(text_true("played")).select("game").distinct().collect()}
    return out


def fetch_season(cache: RawCache, source: Source, limiter: RateLimiter, season: int, refresh: bool = False, every: int = 20, attempts: int = 4) -> list[int]:
    """Fetch what is expected and not cached, storing after each `every` games, failures once more at the end; returns the gaps."""
    spark = cache.spark
    for kind in ("results", "schedule"):
        if refresh or not cache.has(kind, season):
            cache.write(kind, season, spark.createDataFrame(call(limiter, lambda k=kind: getattr(source, k)(season), attempts)))
    todo = sorted(expected_codes(cache.read("results", season), cache.read("schedule", season)) - cache.codes(season))
    for _ in range(2):
        held, missing = [], []
        for i, code in enumerate(todo):
            try:
                held += call(limiter, lambda c=code: source.boxscore(season, c), attempts)
            except Exception:  # noqa: BLE001 - a gap, reported
                missing.append(code)
            if held and ((i + 1) % every == 0 or i + 1 == len(todo)):
                cache.append(season, spark.createDataFrame(held))
                held = []
        todo = missing
        if not todo:
            break
    cache.set_gaps(season, todo)
    return todo
