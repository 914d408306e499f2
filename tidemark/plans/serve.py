"""Next games, active players, predictions, rankings, search and availability."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.parsing import canonical_id, contains_words, round2, search_key, search_text
from tidemark.operators.league import two_sided
from tidemark.operators.relational import latest_row, page, ranked
from tidemark.operators.timeline import effective_time, micros
from tidemark.plans.features import FEATURES, build_features
from tidemark.plans.model import load_model
from tidemark.sources import store, tables

ACTIVE_DAYS = 45


def next_games(games: DataFrame, as_of: str) -> DataFrame:
    """Each team's first game that is not played and not before as_of (games never held lie in the past)."""
    open_ = games.where(~F.col("played") & (F.col("game_date") >= F.lit(as_of).cast("date"))).withColumn("t_us", micros(effective_time("tipoff_utc", "game_date")))
    sides = two_sided(open_.withColumns({"home_score": F.lit(None).cast("double"), "away_score": F.lit(None).cast("double")}), ("season", "gamecode", "game_date", "tipoff_utc", "phase", "t_us"))
    return latest_row(sides, ["team"], [F.asc("t_us"), F.asc("game_date"), F.asc("season"), F.asc("gamecode")]).drop("own_score", "opp_score")


def current_teams(history: DataFrame, as_of: str) -> DataFrame:
    """(player_id, team_code): of each player's last roster row up to as_of."""
    past = history.where(F.col("game_date") <= F.lit(as_of).cast("date")).withColumn("t_us", micros(effective_time("tipoff_utc", "game_date")))
    return past.groupBy("player_id").agg(F.max_by("team_code", F.struct("t_us", "season", "gamecode")).alias("team_code"))


def reference_season(history: DataFrame, as_of: str) -> DataFrame:
    """One row: the newest season begun by as_of, else the newest."""
    starts = history.groupBy("season").agg(F.min("game_date").alias("starts"))
    return starts.agg(F.coalesce(F.max(F.when(F.col("starts") <= F.lit(as_of).cast("date"), F.col("season"))), F.max("season")).alias("reference"))


def active_players(history: DataFrame, as_of: str) -> DataFrame:
    """Players with a row in the reference season up to as_of or in the last 45 days; if none, of the newest season; if none, all."""
    day = F.lit(as_of).cast("date")
    rows = history.crossJoin(F.broadcast(reference_season(history, as_of)))  # one row
    past = F.col("game_date") <= day
    active = rows.where(past & ((F.col("season") == F.col("reference")) | (F.col("game_date") >= F.date_sub(day, ACTIVE_DAYS)))).select("player_id").distinct()
    if active.isEmpty():
        active = rows.where(F.col("season") == F.col("reference")).select("player_id").distinct()
    return history.select("player_id").distinct() if active.isEmpty() else active


def upcoming_rows(history: DataFrame, games: DataFrame, as_of: str) -> DataFrame:
    """A row to predict for every player: the team's next game, or a neutral row the day after as_of."""
    n = next_games(games, as_of).withColumnRenamed("team", "team_code")
    joined = current_teams(history, as_of).join(n, "team_code", "left").crossJoin(F.broadcast(reference_season(history, as_of)))  # one row
    known = F.col("opp").isNotNull()
    after = F.date_add(F.lit(as_of).cast("date"), 1)
    return joined.select(
        "player_id", F.coalesce("season", "reference").alias("season"), F.coalesce(F.col("gamecode").cast("long"), F.lit(-1).cast("long")).alias("gamecode"), "team_code", F.col("opp").alias("opp_code"), F.col("home"),
        F.coalesce("game_date", after).alias("game_date"), F.when(known, F.col("tipoff_utc")).otherwise(after.cast("timestamp_ntz")).alias("tipoff_utc"), "phase",
    )


def predict(history: DataFrame, games: DataFrame, as_of: str, model: Callable[[DataFrame], DataFrame], active_only: bool = True) -> DataFrame:
    """A prediction for every player as known at as_of: history up to it, one path with the batch features."""
    past = history.where(F.col("game_date") < F.lit(as_of).cast("date"))
    features = build_features(past, upcoming_rows(past, games, as_of), games).where("is_upcoming")
    out = model(features)
    active = active_players(past, as_of).withColumn("active", F.lit(True))
    out = out.join(active, "player_id", "left").withColumn("active", F.coalesce("active", F.lit(False)))
    return out.where("active") if active_only else out


def predict_player(history: DataFrame, games: DataFrame, player_id: str, as_of: str, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The prediction for one player, active or not; no row for an unknown one. Team and league features still come from all rows."""
    return predict(history, games, as_of, model, active_only=False).where(F.col("player_id") == canonical_id(F.lit(player_id)))


class Loaded:
    """History and games of a folder of stored tables, persisted until refreshed; predictions are kept by day.

    Kept predictions lie in the folder, under a digest of the tables' and the model's current directories: any
    process that asks for the same day reads them, and none does once a table or the model has been replaced.
    """

    def __init__(self, spark: SparkSession, root: str, model: str | None = None):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self._read()

    def _read(self) -> None:
        self.history, self.games = tables.history(self.spark, self.root).persist(), tables.games(self.spark, self.root).persist()
        self.latest = self.history.agg(F.max("game_date")).first()[0]
        self.state = self._state()

    def _state(self) -> str:
        now = {n: d for n, d in store.pointers(self.spark, self.root)["tables"].items() if n in ("games", "player_games")}
        told = [now, store.pointers(self.spark, self.model)["tables"] if self.model else None]
        return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:16]

    def refresh(self) -> tuple:
        """Read the tables again and drop kept predictions; the latest played day before and after."""
        old, before = (self.history, self.games), self.latest
        self._read()
        for df in old:
            df.unpersist()
        store.delete_folder(self.spark, f"{self.root}/kept")
        return before, self.latest

    def predictions(self, as_of: str, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """predict() for every player, active or not, from what is kept or else made now. model: what is loaded from the path unless given."""
        if self._state() != self.state:
            self.refresh()
        path = f"{self.root}/kept/{self.state}/{as_of}"
        if not store.exists(self.spark, path):
            made = model or load_model(self.spark, self.model).predict
            store.replace(predict(self.history, self.games, as_of, made, active_only=False), path)
        return store.load(self.spark, path)

    def served(self, player_id: str, as_of: str, model: Callable[[DataFrame], DataFrame] | None = None, with_features: bool = False) -> DataFrame:
        """One row for the player (none for an unknown one): names, next game, the model's value and what is left of it by
        availability, notes, and if wanted all features to four places."""
        root, wanted = self.root, canonical_id(F.lit(player_id))
        availability = store.load(self.spark, f"{root}/player_availability", schemas.AVAILABILITY)
        rows = with_availability(self.predictions(as_of, model).where(F.col("player_id") == wanted), availability, as_of)
        teams = F.broadcast(store.load(self.spark, f"{root}/teams", schemas.TEAMS))  # a league's teams
        for side in ("team", "opp"):
            rows = rows.join(teams.select(F.col("team_code").alias(f"{side}_code"), F.col("name").alias(f"{side}_name")), f"{side}_code", "left")
        rows = rows.join(tables.players(self.spark, root).select("player_id", "name"), "player_id", "left")
        appeared = self.history.where((F.col("player_id") == wanted) & ~F.col("dnp") & (F.col("minutes") > 0) & (F.col("game_date") < F.lit(as_of).cast("date")))
        rows = rows.crossJoin(appeared.agg(F.max("game_date").alias("last_appearance")))  # one row
        game = F.when(F.col("gamecode") >= 0, F.struct("season", "gamecode", "game_date", "tipoff_utc", F.col("opp_code").alias("opponent_code"), F.coalesce("opp_name", "opp_code").alias("opponent_name"), (F.col("home") == 1).alias("home")))
        inactive = F.array(F.when(~F.col("active"), "not on a current roster"))
        out = [
            "player_id", "name", "team_code", F.coalesce("team_name", "team_code").alias("team_name"), "active", game.alias("next_game"), round2("effective").alias("predicted_fantasy"), round2("predicted").alias("model_predicted_fantasy"),
            F.when(F.col("status").isNotNull(), F.struct("status", "expected_return")).alias("availability"), F.coalesce("games_played_total", F.lit(0.0)).cast("long").alias("n_prior_appearances"), "last_appearance", F.array_compact(F.concat("notes", inactive)).alias("notes"),
        ]
        if with_features:
            out.append(F.map_from_arrays(F.array(*[F.lit(c) for c in FEATURES]), F.array(*[F.round(c, 4) for c in FEATURES])).alias("features"))
        return rows.select(*out)


def with_availability(predictions: DataFrame, availability: DataFrame, today: str | None = None) -> DataFrame:
    """effective: 0 for players who are out. notes: status, and a return date that has passed (only where today is given)."""
    joined = predictions.join(availability.select("player_id", "status", "expected_return"), "player_id", "left")
    stale = F.lit(False) if today is None else (F.col("status") != "available") & (F.col("expected_return") < F.lit(today).cast("date"))
    notes = [F.when(F.col("status") == "out", "out"), F.when(F.col("status") == "doubtful", "doubtful"), F.when(stale, "expected return has passed"), F.when(F.col("gamecode") == -1, "no game scheduled"), F.when(F.coalesce("games_played_total", F.lit(0)) == 0, "no appearances").when(F.col("games_played_total") < 5, F.concat(F.col("games_played_total").cast("int").cast("string"), F.when(F.col("games_played_total") == 1, " appearance").otherwise(" appearances")))]
    return joined.withColumns({"effective": F.when(F.col("status") == "out", F.lit(0.0)).otherwise(F.col("predicted")), "is_out": F.coalesce(F.col("status") == "out", F.lit(False)), "notes": F.array_compact(F.array(*notes))})


def known_team(teams: DataFrame, code: str) -> str:
    wanted = code.strip().upper()
    codes = sorted(r["team_code"] for r in teams.select("team_code").collect())  # a league's teams
    if wanted not in codes:
        raise ValueError(f"unknown team {wanted}: {', '.join(codes)}")
    return wanted


def rankings(predictions: DataFrame, limit: int = 50, offset: int = 0, team: str | None = None, include_unavailable: bool = False) -> DataFrame:
    """A page of predictions with availability; ranks count from the first of the filtered list, players who are out come last."""
    if not (1 <= limit <= 500 and offset >= 0):
        raise ValueError("limit: 1 to 500; offset: 0 or more")
    rows = predictions if include_unavailable else predictions.where("not is_out")
    if team:
        rows = rows.where(F.col("team_code") == team.strip().upper())
    order = [F.asc("is_out"), F.desc("effective"), F.desc("predicted"), F.asc("player_id")]
    placed = ranked(rows, order).withColumns({"predicted": round2("predicted"), "effective": round2("effective")})
    return page(placed, [F.asc("rank")], offset, limit)


def search_players(players: DataFrame, query: str, limit: int = 20, team: str | None = None) -> DataFrame:
    """Players whose normalised name has every word of the query; active ones first, then by name; total before the limit."""
    if len(query) > 100 or not 1 <= limit <= 100:
        raise ValueError("query: up to 100 characters; limit: 1 to 100")
    rows = players.withColumn("key", search_key(F.col("name")))
    rows = rows.where(contains_words("key", F.lit(search_text(query))))
    if team:
        rows = rows.where(F.col("team_code") == team.strip().upper())
    return page(rows, [F.desc("active"), F.asc("name"), F.asc("player_id")], 0, limit)


def availability_list(availability: DataFrame, players: DataFrame, status: str | None = None) -> DataFrame:
    """With names, the most severe first."""
    rows = availability.join(players.select("player_id", "name"), "player_id")
    if status:
        rows = rows.where(F.col("status") == status)
    severity = F.when(F.col("status") == "out", 0).when(F.col("status") == "doubtful", 1).otherwise(2)
    return rows.orderBy(severity, "name", "player_id")


def valid_availability(rows: DataFrame) -> DataFrame:
    """Canonical ids and statuses; over-long texts and unknown statuses raise when read."""
    fail = lambda c, text: F.when(c, F.raise_error(F.lit(text)).cast("string"))
    status = F.lower(F.trim("status"))
    return rows.withColumns(
        {
            "player_id": canonical_id("player_id"),
            "status": F.coalesce(fail(~status.isin("out", "doubtful", "available"), "status"), status),
            "source": F.coalesce(fail(F.length("source") > 100, "source over 100 characters"), F.trim("source")),
            "note": F.coalesce(fail(F.length("note") > 500, "note over 500 characters"), F.trim("note")),
        }
    )


def health(games: DataFrame, player_games: DataFrame, as_of: str) -> DataFrame:
    """One row: counts, the latest played and next scheduled day, the age of the data in days."""
    day = F.lit(as_of).cast("date")
    g = games.agg(F.count("*").alias("games"), F.count_if("played").alias("played"), F.max(F.when(F.col("played"), F.col("game_date"))).alias("latest_played"), F.min(F.when(~F.col("played") & (F.col("game_date") >= day), F.col("game_date"))).alias("next_scheduled"))
    rows = player_games.agg(F.count("*").alias("player_rows"), F.count_distinct("player_id").alias("players"))
    return g.crossJoin(rows).withColumn("age_days", F.datediff(day, "latest_played"))  # one row each


def to_record(predictions: DataFrame, version: str, as_of: str, created_at: str) -> DataFrame:
    """Rows for the predictions table: players with a next game and a finite prediction."""
    rows = predictions.where((F.col("gamecode") >= 0) & F.col("predicted").isNotNull() & ~F.isnan("predicted") & (F.abs("predicted") < float("1e300")))
    return rows.select("player_id", F.col("season").cast("int"), F.col("gamecode").cast("int"), F.lit(version).alias("model_version"), F.lit(as_of).cast("date").alias("as_of"), F.col("predicted").alias("predicted_fantasy"), F.lit(None).cast("double").alias("predicted_pir"), F.lit(created_at).cast("timestamp").alias("created_at"))

