"""Changes of many line-ups at once, each with what stands in its way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE, TEAM_LIMIT = 10, 6


def blockers(picks: DataFrame, wanted: DataFrame, size: int = SIZE, team_limit: int = TEAM_LIMIT) -> DataFrame:
    """wanted (lineup, slot, player_id, team_code), one row a line-up, with blocker: null where the pick may be added.

    picks has the same columns. The first that holds counts: duplicate (the player is in it), full, occupied (the
    slot is taken), team-limit. A line-up without picks has none.
    """
    own = picks.groupBy("lineup").agg(F.collect_set("player_id").alias("_players"), F.collect_set("slot").alias("_slots"), F.collect_list("team_code").alias("_teams"))  # a line-up has ten picks at most
    joined = wanted.join(own, "lineup", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("_players", "_teams")})
    taken = F.coalesce(F.array_contains("_slots", F.col("slot")), F.lit(False))
    of_team = F.size(F.filter("_teams", lambda x: x == F.col("team_code")))
    blocker = (
        F.when(F.array_contains("_players", F.col("player_id")), "duplicate").when(F.size("_teams") >= size, "full").when(taken, "occupied").when(of_team >= team_limit, "team-limit")
    )
    return joined.withColumn("blocker", blocker).drop("_players", "_slots", "_teams")


def add(picks: DataFrame, wanted: DataFrame, **limits: int) -> DataFrame:
    """picks with the wanted ones that nothing blocks."""
    return picks.unionByName(blockers(picks, wanted, **limits).where("blocker is null").drop("blocker"))


def remove(picks: DataFrame, gone: DataFrame) -> DataFrame:
    return picks.join(gone.select("lineup", "player_id").distinct(), ["lineup", "player_id"], "left_anti").select(*picks.columns)


def set_captain(picks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted player (lineup, player_id) moves to slot 0 and the one there to the slot it leaves; others stay, as do line-ups without that player."""
    w = Window.partitionBy("lineup")
    marked = picks.join(wanted.select("lineup", F.col("player_id").alias("_captain")), "lineup", "left")
    marked = marked.withColumn("_from", F.max(F.when(F.col("player_id") == F.col("_captain"), F.col("slot"))).over(w))
    slot = F.when(F.col("_from").isNull(), F.col("slot")).when(F.col("player_id") == F.col("_captain"), F.lit(0)).when(F.col("slot") == 0, F.col("_from")).otherwise(F.col("slot"))
    return marked.withColumn("slot", slot.cast(picks.schema["slot"].dataType)).select(*picks.columns)


def sanitised(picks: DataFrame, players: DataFrame, size: int = SIZE, team_limit: int = TEAM_LIMIT) -> DataFrame:
    """Stored line-ups as the rules allow: unknown players out, then repeated players and slots, then what passes the limits, in slot order."""
    known = picks.join(players.select("player_id").distinct(), "player_id", "left_semi")
    first = lambda *key: F.row_number().over(Window.partitionBy("lineup", *key).orderBy("slot", "player_id"))
    once = known.withColumn("_n", first("player_id")).where("_n = 1").withColumn("_n", first("slot")).where("_n = 1")
    capped = once.withColumn("_n", first("team_code")).where(F.col("_n") <= team_limit)
    return capped.withColumn("_n", first()).where(F.col("_n") <= size).select(*picks.columns)
