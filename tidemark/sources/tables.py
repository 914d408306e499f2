"""The stored tables as the plans read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources.store import load


def history(spark: SparkSession, root: str) -> DataFrame:
    """Player rows of played games with both teams' scores from the player's side: the feature plan's columns, phase and won."""
    rows, games = load(spark, f"{root}/player_games", schemas.PLAYER_GAMES), load(spark, f"{root}/games", schemas.GAMES)
    joined = rows.join(games.where("played").select("season", "gamecode", "game_date", "tipoff_utc", "phase", "home_code", "home_score", "away_score"), ["season", "gamecode"])
    at_home = F.col("team_code") == F.col("home_code")
    side = lambda a, b: F.when(at_home, F.col(a)).otherwise(F.col(b)).cast("double")
    return joined.select(
        "season", "gamecode", "player_id", "team_code", "opp_code", "home", "game_date", "tipoff_utc", "is_starter", "minutes", "dnp", "pir", "fantasy_score", side("home_score", "away_score").alias("team_score"), side("away_score", "home_score").alias("opp_score"), "phase", "won",
    )


def games(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, f"{root}/games", schemas.GAMES)


def played_games(spark: SparkSession, root: str) -> DataFrame:
    """Games that were played, those without player rows too; scores as doubles."""
    g = games(spark, root).where("played")
    return g.select("season", "gamecode", "game_date", "tipoff_utc", "phase", "home_code", "away_code", F.col("home_score").cast("double").alias("home_score"), F.col("away_score").cast("double").alias("away_score"))


def schedule(spark: SparkSession, root: str) -> DataFrame:
    """Games still to be played."""
    return games(spark, root).where("not played").select("season", "gamecode", "phase", "round", "game_date", "tipoff_utc", "home_code", "away_code")


def players(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, f"{root}/players", schemas.PLAYERS).select("player_id", "name", "first_season", "last_season")
