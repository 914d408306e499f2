"""Raw box scores, results and schedules to the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import local_to_utc, minutes_played, month_day_year, text_true
from tidemark.functions.scoring import bonus_score, rating
from tidemark.operators import quality
from tidemark.operators.relational import flagged_outer_join, latest, unique
from tidemark.operators.scratch import discard, written
from tidemark.schemas import COUNTERS, assert_columns
from tidemark.sources.store import union_all

#: The source's names of COUNTERS, in their order, then of the rest.
RAW_COUNTERS = ("Points", "FieldGoalsMade2", "FieldGoalsAttempted2", "FieldGoalsMade3", "FieldGoalsAttempted3", "FreeThrowsMade", "FreeThrowsAttempted", "OffensiveRebounds", "DefensiveRebounds", "TotalRebounds", "Assistances", "Steals", "Turnovers", "BlocksFavour", "BlocksAgainst", "FoulsCommited", "FoulsReceived")
SENTINELS = ("TEAM", "TOTAL")
RAW_BOX = ("Season", "Gamecode", "Home", "Player_ID", "IsStarter", "Team", "Player", "Minutes", *RAW_COUNTERS, "Valuation")


@dataclass(frozen=True)
class Clean:
    teams: DataFrame
    players: DataFrame
    games: DataFrame
    player_games: DataFrame
    issues: DataFrame
    written: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Delete the scratch tables; the frames above can't be read any more."""
        for df in self.written:
            discard(df)


def split_rows(box: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(players, team rows, totals), told apart by the trimmed id."""
    assert_columns(box, RAW_BOX, "box scores")
    rows = box.withColumn("Player_ID", F.trim("Player_ID"))
    kind = F.upper("Player_ID")
    return rows.where(~kind.isin(*SENTINELS)), rows.where(kind == "TEAM"), rows.where(kind == "TOTAL")


def player_rows(rows: DataFrame) -> DataFrame:
    m = minutes_played("Minutes")
    plus = F.col("Plusminus").cast("int") if "Plusminus" in rows.columns else F.lit(None).cast("int")
    return rows.select(
        F.col("Season").cast("int").alias("season"), F.col("Gamecode").cast("int").alias("gamecode"), F.col("Player_ID").alias("player_id"), F.trim("Player").alias("name"), F.trim("Team").alias("team_code"),
        (F.col("Home") == 1).alias("home"), F.coalesce(F.col("IsStarter") == 1, F.lit(False)).alias("is_starter"), m["minutes"].alias("minutes"), m["dnp"].alias("dnp"),
        *[F.col(r).cast("int").alias(c) for r, c in zip(RAW_COUNTERS, COUNTERS)], plus.alias("plus_minus"), F.col("Valuation").cast("int").alias("valuation"),
    )


def results_rows(results: DataFrame) -> DataFrame:
    rows = results.withColumn("_d", month_day_year("date"))
    return rows.select(F.col("season").cast("int"), F.col("gameCode").cast("int").alias("gamecode"), F.col("Phase").alias("phase"), F.col("Round").cast("int").alias("round"), F.col("_d").alias("game_date"), local_to_utc("_d", "time").alias("tipoff_utc"), F.trim("homecode").alias("home_code"), F.trim("awaycode").alias("away_code"), F.trim("hometeam").alias("home_name"), F.trim("awayteam").alias("away_name"), F.col("homescore").cast("int").alias("home_score"), F.col("awayscore").cast("int").alias("away_score"), ((F.col("homescore") > 0) & (F.col("awayscore") > 0)).alias("played"))


def schedule_rows(schedule: DataFrame) -> DataFrame:
    rows = schedule.withColumn("_d", month_day_year("date"))
    return rows.select(F.col("season").cast("int"), F.col("game").cast("int").alias("gamecode"), F.col("round").alias("phase"), F.col("gameday").cast("int").alias("round"), F.col("_d").alias("game_date"), local_to_utc("_d", "startime").alias("tipoff_utc"), F.trim("homecode").alias("home_code"), F.trim("awaycode").alias("away_code"), F.trim("hometeam").alias("home_name"), F.trim("awayteam").alias("away_name"), text_true("played").alias("played"))


def game_rows(results: DataFrame, schedule: DataFrame, totals: DataFrame) -> DataFrame:
    """Results first, the schedule for what they lack; a missing score from the box totals where both sides have one."""
    key = ["season", "gamecode"]
    a = unique(results, key, "results").select(*key, *[F.col(c).alias(f"a_{c}") for c in results.columns if c not in key])
    b = unique(schedule, key, "schedule").select(*key, *[F.col(c).alias(f"b_{c}") for c in schedule.columns if c not in key])
    joined = flagged_outer_join(a, b, key)
    either = {c: F.coalesce(f"a_{c}", f"b_{c}") for c in ("phase", "round", "game_date", "tipoff_utc", "home_code", "away_code", "home_name", "away_name")}
    g = joined.select(*key, *[v.alias(k) for k, v in either.items()], F.col("a_home_score").alias("home_score"), F.col("a_away_score").alias("away_score"), (F.coalesce("a_played", F.lit(False)) | F.coalesce("b_played", F.lit(False))).alias("played"))
    t = totals.select("season", "gamecode", "team_code", "points")
    for side in ("home", "away"):
        g = g.join(t.select(*key, F.col("team_code").alias(f"{side}_code"), F.col("points").alias(f"_{side}")).hint("merge"), [*key, f"{side}_code"], "left")
    use = ~((F.col("home_score") > 0) & (F.col("away_score") > 0)) & F.col("_home").isNotNull() & F.col("_away").isNotNull()
    lack = F.coalesce(use, F.col("_home").isNotNull() & F.col("_away").isNotNull() & F.col("home_score").isNull())
    scored = {f"{s}_score": F.when(lack, F.col(f"_{s}")).otherwise(F.when(F.col(f"{s}_score") > 0, F.col(f"{s}_score"))) for s in ("home", "away")}
    g = g.withColumns(scored)
    winner = F.when(F.col("home_score") > F.col("away_score"), F.col("home_code")).when(F.col("away_score") > F.col("home_score"), F.col("away_code"))
    return g.withColumn("winner_code", winner).drop("_home", "_away")


def team_rows(results: DataFrame, schedule: DataFrame) -> DataFrame:
    """The latest name of each team; of equal games the schedule's counts."""
    parts = []
    for order, df in enumerate((results, schedule)):
        for k, side in enumerate(("home", "away")):
            parts.append(df.select("season", "gamecode", F.coalesce("tipoff_utc", F.col("game_date").cast("timestamp_ntz")).alias("t"), F.col(f"{side}_code").alias("team_code"), F.col(f"{side}_name").alias("name"), F.lit(2 * order + k).alias("source")))
    return latest(union_all(parts), ["team_code"], ["season", "t", "gamecode", "source"], ["name"])


def player_table(rows: DataFrame, games: DataFrame) -> DataFrame:
    """Latest name and first and last season; a game without tip-off comes last in its order."""
    timed = rows.join(games.select("season", "gamecode", "game_date", "tipoff_utc"), ["season", "gamecode"], "left")
    names = latest(timed, ["player_id"], ["season", "tipoff_utc", "game_date", "gamecode"], ["name"])
    span = rows.groupBy("player_id").agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"))
    return names.join(span, "player_id")


def attach_context(rows: DataFrame, games: DataFrame) -> DataFrame:
    """Opponent and result from the team codes (home stays as the box score says), rating and score."""
    joined = rows.join(games.select("season", "gamecode", "home_code", "away_code", "winner_code").hint("merge"), ["season", "gamecode"])  # compressed files hide how many games a broadcast would hold
    at_home, away = F.col("team_code") == F.col("home_code"), F.col("team_code") == F.col("away_code")
    joined = joined.withColumn("opp_code", F.when(at_home, F.col("away_code")).when(away, F.col("home_code"))).where("opp_code is not null")
    joined = joined.withColumn("won", F.coalesce(F.col("winner_code") == F.col("team_code"), F.lit(False)))
    return joined.withColumn("pir", rating().cast("int")).withColumn("fantasy_score", bonus_score("pir", "won")).drop("home_code", "away_code", "winner_code", "name")


def clean(box: DataFrame, results: DataFrame, schedule: DataFrame) -> Clean:
    """All tables and all issues; nothing is written and errors do not raise here (see quality.gate).

    Parsed rows, both sources' games and the games are written once, since every table and check reads them again.
    """
    every = player_rows(assert_columns(box, RAW_BOX, "box scores").withColumn("Player_ID", F.trim("Player_ID")))
    kind = F.upper("player_id")
    kinds = every.where("player_id is not null").withColumn("_kind", F.when(kind == SENTINELS[0], 1).when(kind == SENTINELS[1], 2).otherwise(0))  # as split_rows, in one pass
    lines = written(kinds, "box")
    rows, team_part, totals = (lines.where(F.col("_kind") == k).drop("_kind") for k in range(3))
    r, s = written(results_rows(results), "results"), written(schedule_rows(schedule), "schedule")
    games = written(game_rows(r, s, totals), "games")
    found = union_all(
        [
            quality.box_score_issues(rows),
            quality.context_issues(rows, games),
            quality.team_total_issues(rows.unionByName(team_part), totals),
            quality.team_minutes_issues(totals),
            quality.score_issues(games.where("played"), totals),
            quality.conflict_issues(r, s, ["game_date", "home_code", "away_code"]),
        ]
    )
    whole = rows.where(F.size(quality.null_columns(["season", "gamecode", "player_id", "team_code", *COUNTERS])) == 0)
    return Clean(team_rows(r, s), player_table(rows, games), games.drop("home_name", "away_name"), attach_context(whole, games), found, (lines, r, s, games))


def season_summary(player_games: DataFrame, games: DataFrame) -> DataFrame:
    g = games.groupBy("season").agg(F.count("*").alias("games"), F.count_if("played").alias("played"))
    p = player_games.groupBy("season").agg(F.count("*").alias("rows"), F.count_distinct("player_id").alias("players"), F.count_if("dnp").alias("dnp"), F.round(F.avg("fantasy_score"), 2).alias("mean_score"))
    return g.join(p, "season", "full_outer").withColumn("rows_per_game", F.round(F.try_divide("rows", "played"), 2))


def load_checks(player_games: DataFrame, games: DataFrame, accepted: list[tuple[int, int]] = ()) -> DataFrame:
    """(rule, broken) after a load; accepted: games known to have no rows."""
    again, score = rating(), bonus_score("pir", "won")
    rules = {"rating equals the source's": F.col("pir") != F.col("valuation"), "rating as recomputed": F.col("pir") != again, "score rule": F.abs(score - F.col("fantasy_score")) > 1e-9}
    # the rows are read once: each rule's count goes along with its side
    broken = [F.count_if(rule).alias(f"r{i}") for i, rule in enumerate(rules.values())]
    sides = written(player_games.groupBy("season", "gamecode", "team_code").agg(F.max("won").alias("won"), *broken), "sides")
    played = games.where("played").select("season", "gamecode")
    if accepted:
        played = played.join(played.sparkSession.createDataFrame(list(accepted), "season int, gamecode int"), ["season", "gamecode"], "left_anti")
    # sides and games meet in one grouping by game: a join would broadcast every game through the driver
    both = sides.select("season", "gamecode", F.lit(1).alias("_side"), F.col("won").cast("int").alias("_won")).unionByName(played.withColumn("_game", F.lit(1)), allowMissingColumns=True)
    by_game = both.groupBy("season", "gamecode").agg(F.count("_side").alias("teams"), F.sum("_won").alias("winners"), F.count("_game").alias("games"))
    has = F.col("teams") > 0
    bare = F.when(has & F.col("season").isNotNull() & F.col("gamecode").isNotNull(), 0).otherwise(F.col("games"))  # a null key is no game's
    counts = {"one winner": F.count_if(has & (F.col("winners") != 1)), "two teams": F.count_if(has & (F.col("teams") != 2)), "games without rows": F.coalesce(F.sum(bare), F.lit(0))}
    by_row = _listed(sides.agg(*[F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"r{i}") for i in range(len(rules))]), rules)
    parts = [by_row, _listed(by_game.agg(*[n.alias(f"r{i}") for i, n in enumerate(counts.values())]), counts)]
    return union_all(parts)


def _listed(one: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row of counts r0, r1, ... as (rule, broken)."""
    listed = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"r{i}").alias("broken")) for i, k in enumerate(rules)])
    return one.select(F.explode(listed).alias("r")).select("r.*")
